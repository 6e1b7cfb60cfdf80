"""Edge rules of scalar functions and folds that no data table shows."""

import pytest
from pyspark.sql import functions as F

from leafwright.operators import outlines, passages, runs, scalars
from leafwright.plans.catalogue import QUERIES


def one(spark, make, *values, types="string"):
    d = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {t}" for i, t in enumerate([types] * len(values) if isinstance(types, str) else types)))
    return d.select(make(*[F.col(c) for c in d.columns]).alias("x")).first().x


@pytest.mark.parametrize("asked, want", [
    ("1-3,8", [1, 2, 3, 8]), ("3，1–2", [3, 1, 2]), ("5-3", None), ("x", None), ("1-", None), ("0,2,2", [2]), ("", []),
    ("1-500", list(range(1, 11))), ("1-9,1-500", list(range(1, 11))), (None, None),
])
def test_page_request(spark, asked, want):
    assert one(spark, scalars.page_request, asked) == want


@pytest.mark.parametrize("text, want", [("二十三", 23), ("十", 10), ("三十", 30), ("一二", 12), ("零", None), ("百", None), ("12", None), ("", None), (None, None)])
def test_chinese_number(spark, text, want):
    assert one(spark, scalars.chinese_number, text) == want


@pytest.mark.parametrize("pages, want", [([], ""), ([4], "4"), ([1, 2, 3, 8], "1-3,8"), ([1, 3, 4], "1,3-4")])
def test_page_label(spark, pages, want):
    assert one(spark, scalars.page_label, pages, types="array<int>") == want


@pytest.mark.parametrize("text, focus, want", [("a  b", "b", "a b"), ("", "x", ""), ("x" * 60 + "KEY" + "y" * 60, "key", "..." + "x" * 48 + "KEY" + "y" * 48 + "..."), ("z" * 200, "q", "z" * 96)])
def test_snippet(spark, text, focus, want):
    assert one(spark, scalars.snippet, text, focus) == want


@pytest.mark.parametrize("title, want", [("Chapter 7 End", "7"), ("第十二章 论", "12"), ("3.4 Of", "3.4"), ("appendix c", "A3"), ("Of", None), (None, None)])
def test_heading_structure(spark, title, want):
    assert one(spark, scalars.heading_structure, title) == want


def test_pack_keeps_order_and_limit(spark):
    d = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 1, 20, 3, 7, 1])] + [(2, 0, 99)], "doc_id int, ord int, s int")
    got = {(r.doc_id, r.ord): r.group for r in outlines.pack(d, "s", 10).collect()}
    assert [got[1, i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 4] and got[2, 0] == 0


def test_valid_order_ends_at_an_error(spark):
    happy = ["session_started", "intent_start", "intent_done", "retrieval_start", "retrieval_done", "answer_delta", "answer_done", "citations_ready", "done"]
    runs_ = {1: happy, 2: happy[:-1], 3: ["session_started", "error"], 4: ["error", "done"], 5: ["warn", *happy], 6: ["session_started", "odd", "error"], 7: [*happy, "error"], 8: ["answer_delta", *happy]}
    d = spark.createDataFrame([(k, i, e) for k, v in runs_.items() for i, e in enumerate(v)], "run int, seq int, event_type string")
    assert {r.run: r.valid for r in runs.valid_order(d, "run", ["seq"]).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False}


def test_ancestors_skip_levels(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 3, 2, 3, 1, 2, 2])], "doc_id int, ord int, level int")
    got = {r.ord: r.ancestors for r in outlines.with_ancestors(d).collect()}
    assert got == {0: [], 1: [0], 2: [0], 3: [0, 2], 4: [], 5: [4], 6: [4]}


def test_markdown_fences_hide_headings(spark):
    d = spark.createDataFrame([(1, "# A\n```\n# no\n```\n## B ##\ntext"), (2, ""), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in passages.markdown_headings(d).orderBy("line").collect()] == [(1, 1, 1, "A", 4), (1, 5, 2, "B", 6)]


def test_win20_groups_never_pass_the_limit(spark):
    got = QUERIES["win20_pack"](spark, "/root/testdata/sf0.001")
    assert got.groupBy("doc_id").agg((F.max("group") + 1 <= F.count("*")).alias("ok")).where("not ok").count() == 0
