"""JSON as models write it, bounded payloads, nested citations and stored indexes."""

import pytest

from leafwright.operators import payloads as p


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n[1, 2]\n```', [1, 2]),
        ('Sure! {"a": [1, 2,], "b": {"c": 3,},} Done.', {"a": [1, 2], "b": {"c": 3}}),
        ('list: [{"a": 1} {"a": 2}]', {"a": 1}),  # objects are looked for first
        ("nothing here", None),
        ("{never closed", None),
        ("", None),
        (None, None),
    ],
)
def test_loose_json(text, want):
    assert p.parse_loose(text) == want


def test_pruning_bounds_everything():
    value = {"x": "y" * 2000, "IMG_Base64": "z", "api_key": "k", "none": None, "list": list(range(20)), "deep": {"a": {"b": {"c": 1}}}, "empty": {"a": [""]}}
    got = p.prune(value)
    assert len(got["x"]) == 1500 and got["x"].endswith("...") and got["list"] == list(range(8)) and set(got) == {"x", "list", "deep"}
    assert p.prune(value, depth=2)["list"] == list(range(8)) and "deep" not in p.prune(value, depth=2)


def test_citations_take_context_from_around():
    value = {"document_id": 4, "page": 2, "hits": [{"snippet": "a"}, {"page": 3, "snippet": "b", "source_anchor": {"snippet": "no"}}], "other": {"snippet": "c", "document_id": 5}}
    assert [(c["document_id"], c["page"], c["snippet"]) for c in p.citations(value)] == [(4, 2, "a"), (4, 3, "b"), (5, 2, "c")]
    assert list(p.citations({"snippet": "whose?"})) == [] and list(p.citations("text")) == []


def test_nested_outline():
    rows = [{"ord": i, "title": t, "page": i + 1, "level": n} for i, (t, n) in enumerate([("a", 1), ("b", 3), ("c", 2), ("d", 1)])]
    got = p.nested(rows)
    assert [n["title"] for n in got] == ["a", "d"] and [n["title"] for n in got[0]["children"]] == ["b", "c"] and got[1]["node_id"] == "0003"
    assert p.nested([]) == []


def test_index_that_is_not_there(spark, tmp_path):
    assert p.load_index(spark, f"{tmp_path}/none", 1) is None
    p.save_index(spark.createDataFrame([(1, 0, "a")], "doc_id long, ord int, title string"), f"{tmp_path}/index")
    assert p.load_index(spark, f"{tmp_path}/index", 1).count() == 1 and p.load_index(spark, f"{tmp_path}/index", 2) is None
