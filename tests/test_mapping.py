"""Titles on pages that are wrapped, misspelt, repeated or out of order, and the mappers."""

import pytest

from leafwright.operators import mapping as m

PAGE = "Quarterly review\nThe harbour lights were lit at dusk\nand the boats came home one after another"


@pytest.mark.parametrize(
    ("title", "text", "low", "high"),
    [
        ("The harbour lights were lit at dusk", PAGE, 0.99, 1.0),
        ("3. The harbour lights were lit at dusk", PAGE, 0.57, 0.95),  # the marker is missing on the line
        ("The harbour lihgts were lit at dusk", PAGE, 0.95, 0.98),  # misspelt
        ("lit at dusk and the boats came home one", PAGE, 0.9, 0.95),  # wrapped over two lines
        ("Harbour lights: boats came home", PAGE.replace("\n", " "), 0.7, 0.95),  # parts apart
        ("Annual report of the museum", PAGE, 0.0, 0.5),
        ("Fog", "Fog\nrolled in", 0.92, 1.0),
        ("Fog", "the fog was thick, foggy days", 0.0, 0.0),
        ("", PAGE, 0.0, 0.0),
        (None, None, 0.0, 0.0),
    ],
)
def test_title_score(title, text, low, high):
    assert low <= m.title_score(title, text) <= high


def test_forms_agree_with_columns(spark):
    from pyspark.sql import functions as F

    titles = ["Chapter 3: The  Old Harbour and its many long piers", "第三章 海港", "12. Ｆｕｌｌ width ﬁne", "plain", "", "1.2.3 Straße—Über alles und noch viel mehr Wörter"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", m.title_form(F.col("t")).alias("f"), m.strip_prefix(F.col("t")).alias("b"), m.title_fragments(F.col("t")).alias("g")).collect()
    for r in rows:
        assert (r.f, r.b, r.g) == (m.normal(r.t), m.bare(r.t), m.fragments(r.t)), r.t


def test_segments_in_and_out_of_order():
    assert m.segments("Part 2: Harbour - Lights") == ["part2", "2", "harbour", "lights"]
    page = m.normal("x1y harbour zz lights")
    assert m.segment_score("Harbour / Lights", page) == 0.9
    assert m.segment_score("Lights / Harbour", page) == 0.78
    assert m.segment_score("Part 2: Harbour - Lights", page) == 0.0  # its marker is nowhere


def test_markers_and_position():
    texts = {1: "Contents", 2: "an aside\nChapter 02 renamed since", 3: "Chapter 2 again"}
    assert m.marker_page("Chapter 2 Old name", texts, 1) == (2, 0.82)
    assert m.marker_page("Chapter 2 Old name", texts, 3) == (3, 0.82)
    assert m.marker_page("No number", texts, 1) is None
    assert m.position("Harbour lights", "top\n\nHarbour lights\nmore") == (2, 5, True)
    assert m.position("Harbour lights", "a\nb\nc\nHarbour lights") == (3, 6, False)
    assert m.position("Harbour lights", "nothing here") is None


def test_mapper_cursor_markers_and_neighbours():
    texts = {1: "Introduction\nwords", 2: "Methods of work\nIntroduction again", 3: "Chapter 3 is here", 4: "Results", 5: "Introduction\nonce more"}
    items = [("Introduction", "main"), ("Methods of work", "main"), ("Chapter 3 Lost title", "main"), ("Nowhere to be seen", "main"), ("Results", "main"), ("Introduction", "main"), ("Introduction", "table"), ("Unseen table", "table")]
    got = m.map_items(items, texts)
    assert [g[0] for g in got] == [1, 2, 3, 3, 4, 5, 1, None]
    assert [g[1] for g in got][2:4] == ["outline_marker", "neighbor_inference"] and got[-1][1] == "unmapped"
    assert m.map_items([("Zzz", "main"), ("Results", "main")], texts)[0][:2] == (4, "neighbor_inference")
    assert m.map_items([], texts) == []


def test_printed_pages_and_skeletons():
    texts = {1: "Contents", 2: "Alpha section", 3: "Beta section", 4: "Gamma section"}
    items = [("Alpha section", "main", 3), ("Beta section", "main", 3), ("Unseen words here", "main", 4), ("Gamma section", "main", None)]
    assert [g[:2] for g in m.override_printed(items, texts)] == [(2, "title_search"), (3, "title_search"), (4, "printed_page_offset"), (4, "title_search")]
    assert m.map_skeleton([("Alpha section", 2), ("Beta section", 3)], texts) == ("existing", 1.0, [2, 3])
    assert m.map_skeleton([("Alpha section", None), ("Gamma section", 9)], texts) == ("title_search", 1.0, [2, 4])
    assert m.map_skeleton([("Unseen", None), ("Not here", None), ("Nor here", None)], texts, 2) == ("uniform_after_toc", 0.35, [2, 3, 4])


def test_position_by_line_then_by_offset():
    """MAP06: the first line that shows the title; blank lines count in the offset, not before the top."""
    assert m.position("The harbour lights were lit at dusk", PAGE) == (1, 17, True)
    assert m.position("The harbour lights were lit at dusk", "one\ntwo\n\n" + PAGE) == (4, 26, False)
    line, at, top = m.position("lit at dusk and the boats came home one", PAGE)
    assert line is None and at > 0 and m.normal(PAGE)[at:].startswith("litatdusk") and top == (at <= 80)
    assert m.position("Annual report of the museum", PAGE) is None
    assert m.position("", PAGE) is None


def test_sections_are_mapped_apart(spark):
    """MAP11: a table's title before the main one's page is found, as each kind has its own cursor."""
    pages = [(1, 1, "Table of tides and harbours"), (1, 2, "nothing here"), (1, 3, "The lighthouse keepers of the north")]
    items = [(1, 0, "The lighthouse keepers of the north", "main_toc"), (1, 1, "Table of tides and harbours", "table_catalog"), (1, 2, "Index of sunken merchant ships", "table_catalog")]
    got = m.map_sections(spark.createDataFrame(items, "doc_id long, ord int, title string, kind string"), spark.createDataFrame(pages, "doc_id long, page int, text string"))
    assert sorted((r.kind, r.ord, r.page, r.source, r.match_rate) for r in got.collect()) == [
        ("main_toc", 0, 3, "title_search", 1.0),
        ("table_catalog", 1, 1, "title_search", 0.5),
        ("table_catalog", 2, None, "unmapped", 0.5),
    ]


def test_children_stay_inside_their_parents(spark):
    """ADD04: a child is looked for on its parent's pages only, and left out if it is on none of them."""
    from leafwright.operators.further import attach_children

    pages = spark.createDataFrame([(1, p, t) for p, t in enumerate(["Ropes and knots of the sailors", "Sails and masts of the schooners", "Ropes and knots of the sailors"], 1)], "doc_id long, page int, text string")
    parents = spark.createDataFrame([(1, 0, 1, 2), (1, 3, 2, 3), (1, 6, 2, 2)], "doc_id long, ord int, start_page int, end_page int")
    kids = [(1, p, p + 1, "Ropes and knots of the sailors") for p in (0, 3, 6)] + [(1, 6, 8, "Sails and masts of the schooners")]
    got = attach_children(parents, spark.createDataFrame(kids, "doc_id long, parent int, ord int, title string"), pages)
    assert sorted((r.parent, r.ord, r.page) for r in got.collect()) == [(0, 1, 1), (3, 4, 3), (6, 8, 2)]


def _plain(title, texts, start):
    """The best score of each page from ``start`` by itself."""
    best = None
    for page in sorted(p for p in texts if p >= start):
        score = m.title_score(title, texts[page])
        if score >= m.FOUND and (best is None or score > best[1]):
            best = page, score
        if score >= m.SURE:
            break
    return best


def _document(n, seed=3):
    """Pages of invented words, of one to four lines, with some that repeat; titles of theirs, with letters changed in some."""
    import random

    r = random.Random(seed)
    words = ["".join(r.choice(("ha", "ro", "bi", "lu", "men", "te", "ción", "s", "中")) for _ in range(r.randint(1, 4))) for _ in range(400)]
    texts = {p: "\n".join(" ".join(r.choices(words, k=r.randint(3, 30))) for _ in range(r.randint(1, 4))) for p in range(1, n + 1)}
    texts |= {p: texts[p - 7] for p in range(10, n + 1, 10)}
    titles = []
    for i, p in enumerate(sorted(r.choices(range(1, n + 1), k=n))):
        title = list(("", "Chapter 4: ", "12. ", "第三章 ")[i % 4] + " ".join(texts[p].split()[: (1, 2, 4, 9)[i // 4 % 4]]))
        for _ in range(i % 3):
            title[r.randrange(len(title))] = r.choice("aeiou 1")
        titles.append("".join(title))
    return texts, titles


@pytest.fixture
def compared(monkeypatch):
    """Strings that were compared."""
    from difflib import SequenceMatcher

    seen = []

    class Counting(SequenceMatcher):
        def ratio(self):
            seen.append((self.a, self.b))
            return super().ratio()

    m.line_score.cache_clear()
    monkeypatch.setattr(m, "SequenceMatcher", Counting)
    return seen


def test_search_is_the_best_of_all_pages(compared):
    """JON12: bounds leave out pages that can have no score, and no others."""
    texts, titles = _document(40)
    got = [m.title_page(t, texts, 1 + i % 5 * 8) for i, t in enumerate(titles)]
    few = len(compared)
    assert got == [_plain(t, texts, 1 + i % 5 * 8) for i, t in enumerate(titles)]
    assert any(got) and few * 20 < len(compared)


def test_unseen_titles_are_compared_with_few_windows(compared):
    """MAP07: titles that are nowhere are not held against every window of every page."""
    texts, titles = _document(60)
    titles = [t[::-1] for t in titles]
    got = m.map_items([(t, "main") for t in titles], texts)
    assert len(compared) < 5 * len(titles) and len(got) == len(titles)


def test_numbered_titles_are_compared_with_lines_that_carry_a_number_only(compared):
    """MAP07: lines without the number do not count, and a line that holds the title is not compared as well."""
    texts = {p: f"Sailors tell of fog at sea and of {'abcdefgh'[p % 8] * 3} boats {p}" for p in range(1, 60)}
    items = [(f"Chapter {p}: {' '.join(texts[p].split()[:9])}", "main") for p in texts]
    assert [r[0] for r in m.map_items(items, texts)] == [p for p in texts] and len(compared) == 0
    assert m.title_page("Chapter 3: Sailors tell of fog at sea", {1: "Sailors tell of fog at seas", 2: "Chapter 3  Sailors tel of fog at sea"}, 1) == _plain("Chapter 3: Sailors tell of fog at sea", {1: "Sailors tell of fog at seas", 2: "Chapter 3  Sailors tel of fog at sea"}, 1)
    for x in ("Ünïted ßtates, 12_3", "ﬁne ２nd – “x”", "İSTANBUL µ", "中文 Part-2\n", "a\x85b\xa0ª²"):
        assert m.normal(x) == "".join(c for c in __import__("unicodedata").normalize("NFKC", x).lower() if c.isalnum())


def test_printed_pages_are_compared_with_few_windows(compared):
    """MAP13: the same of titles with a printed page."""
    texts, titles = _document(60)
    got = m.override_printed([(t[::-1], "main", 1 + i % 60) for i, t in enumerate(titles)], texts)
    assert len(got) == len(titles) and len(compared) < 60 * len(titles)
    compared.clear()
    texts, titles = {1: _document(1)[0][1] + " of harbour lights", 2: "Sailors tell of fog and of lights at sea and of boats " * 4}, ["of harbour lights and foghorns at the quay of the old town"]
    assert m.override_printed([(t, "main", 2) for t in titles], texts)[0][0] in (1, 2) and len(compared) < 24


def test_documents_are_not_dealt_to_pandas_groups(spark):
    """MAP11, ADD04: one row a document in Arrow batches; equal orders, missing pages and documents without pages stay."""
    from leafwright.operators.further import attach_children

    pages = spark.createDataFrame([(1, 1, "Ropes and knots of the sailors"), (1, 2, None), (2, 1, "no items here")], "doc_id long, page int, text string")
    items = spark.createDataFrame([(1, 0, "Ropes and knots of the sailors", "main_toc"), (1, 0, None, "main_toc"), (3, 0, "Sails and masts", "main_toc"), (None, 0, "Sails", "main_toc")], "doc_id long, ord int, title string, kind string")
    got = m.map_sections(items, pages)
    assert sorted((r.doc_id or 0, r.ord, r.page, r.source) for r in got.collect()) == [(0, 0, None, "unmapped"), (1, 0, 1, "neighbor_inference"), (1, 0, 1, "title_search"), (3, 0, None, "unmapped")]
    parents = spark.createDataFrame([(1, 0, 1, 2)], "doc_id long, ord int, start_page int, end_page int")
    kids = attach_children(parents, items.selectExpr("doc_id", "0 as parent", "ord", "title"), pages)
    assert [(r.parent, r.ord, r.page) for r in kids.collect()] == [(0, 0, 1)]
    assert not any("InPandas" in d._jdf.queryExecution().toString() for d in (got, kids))


def test_texts_of_pages_move_once(spark, tmp_path):
    """MAP07, MAP11, ADD04: items and pages meet in one grouping; titles of repeated ids come as the join gave them."""
    import re

    from leafwright.plans.catalogue import QUERIES
    from leafwright.sources.derived import page_text, toc_items

    rows = [(1, "Ropes and knots of the sailors\nb\nc\nFog and boats"), (1, "Sails and masts\nb"), (None, "no id at all"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    old = toc_items(spark, str(tmp_path)).drop("title").join(page_text(spark, str(tmp_path)), ["doc_id", "page"])
    got = m.long_titles(spark, str(tmp_path))
    assert sorted((r.doc_id, r.page, r.ord, r.text) for r in got.collect()) == sorted((r.doc_id, r.page, r.ord, r.text) for r in old.collect())
    for name, most in (("map07_mapper", 2), ("map11_sections", 1), ("add04_children", 3)):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) <= most, name


def odd_documents(spark, folder):
    """Ids that come twice, with pages of their own and shared ones; no id, no text, empty lines, others than letters."""
    lines = ["Ropes and knots of the sailors", "b", "", "Fog and boats at the quay", "", "c 3. d", "Sails and masts in harbour winds", "中文 第3章 帆船", "x", "  Tides of two oceans", "4. Lamps", "y"]
    texts = ["\n".join(lines * 3), "\n".join(lines[::-1] * 2), "\n", "", None, "\n".join(lines), "Fog and boats at the quay\n\n\nZebra crossings of the town"]
    rows = list(zip([1, 1, 2, 3, 4, None, 1], texts, strict=True)) + [(None, texts[1])]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(folder / "documents.parquet")
    return str(folder)


def test_children_of_whole_documents(spark, tmp_path):
    """ADD04: one row a document gives what rows of parents, children and pages give; texts move once, as they are."""
    from leafwright.operators.further import attach_children
    from leafwright.plans.catalogue import QUERIES
    from leafwright.sources.derived import page_text, toc_items

    folder = odd_documents(spark, tmp_path)
    t = toc_items(spark, folder)
    parents = t.where("ord % 3 = 0").selectExpr("doc_id", "ord", "page as start_page", "page + 6 as end_page")
    want = attach_children(parents, t.where("ord % 3 > 0").selectExpr("doc_id", "cast(ord div 3 * 3 as int) as parent", "ord", "title"), page_text(spark, folder))
    got = QUERIES["add04_children"](spark, folder)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 4
    plan = QUERIES["add04_children"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Join" not in plan


def test_children_of_parents_told_twice(spark):
    """ADD04: a parent told twice has its children twice, as a join has; a parent or document without a number has none."""
    from leafwright.operators.further import attach_children

    pages = spark.createDataFrame([(1, 1, "Ropes and knots"), (1, 2, "Sails and masts"), (None, 1, "Ropes and knots")], "doc_id long, page int, text string")
    parents = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 1, 2), (1, None, 1, 2), (1, 0, 2, None), (None, 0, 1, 2)], "doc_id long, ord int, start_page int, end_page int")
    kids = spark.createDataFrame([(1, 0, 5, "Sails and masts"), (1, None, 6, "Ropes and knots"), (None, 0, 7, "Ropes and knots")], "doc_id long, parent int, ord int, title string")
    got = attach_children(parents, kids, pages)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.doc_id, r.parent, r.ord, r.page) for r in got.collect()) == [(1, 0, 5, 2)] * 2
