"""Small cases whose results are written out."""

from pyspark.sql import functions as F

from leafwright.operators import intervals, records, tables


def test_groupby_with_blank_keys_and_no_numbers(spark):
    catch = [("cod", "7.5"), ("", "1,200"), ("eel", "none"), ("cod", "2"), ("\t", "300"), ("bream", "-4")]
    t = spark.createDataFrame(catch, "fish string, kilos string")
    ask = lambda **q: [tuple(r) for r in tables.aggregate(t, q).collect()]
    assert ask(operation="groupby", group_by="fish", target_column="kilos", metric="sum") == [("(empty)", 1500.0), ("cod", 9.5), ("bream", -4.0)]
    assert ask(operation="count")[0][0] == len(catch)
    assert tables.aggregate(t.where("fish = 'eel'"), {"operation": "sum", "target_column": "kilos"}).count() == 0
    assert ask(operation="median") == []


def test_number_grammar(spark):
    t = spark.createDataFrame([(x,) for x in ("1_000", "5d", " 2.5 ", "1,2", "", None, "1e3", ".5")], "x string")
    assert [r[0] for r in t.select(tables.to_number(F.col("x"))).collect()] == [1000.0, None, 2.5, 12.0, None, None, 1000.0, 0.5]


def test_empty_allow_list_admits_nothing(spark):
    d = spark.range(3)
    assert records.allowed(d, None, "id").count() == 3
    assert records.allowed(d, spark.range(0), "id").count() == 0


def test_ranges_and_coverage(spark):
    t = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 3)], "doc_id int, ord int, page int").withColumn("last_page", F.lit(9))
    r = intervals.assign_ranges(t, "last_page")
    assert [x.end_page for x in r.orderBy("ord").collect()] == [2, 3, 9]
    c = intervals.coverage(r.withColumnRenamed("page", "start_page")).first()
    assert (c.missing, c["class"]) == (0, "good")


def test_sentences_bind_to_common_words_too(spark):
    """JON19: evidence that shares only tokens which all of it has is bound; ties go by id."""
    from leafwright.operators.citations import bind_sentences

    e = spark.createDataFrame([(i, "alpha beta gamma" + (" delta" if i == 7 else ""), 0.9 if i != 3 else 0.1) for i in range(20)], "evidence_id long, quote string, confidence double")
    s = spark.createDataFrame([(1, "alpha beta"), (2, "delta alpha"), (3, "nothing shared"), (4, "")], "sentence_id long, sentence string")
    got = sorted((r.sentence_id, r.evidence_id, r["rank"], r.score) for r in bind_sentences(s, e).collect())
    assert got == [(1, 0, 1, 0.975), (1, 1, 2, 0.975), (2, 0, 2, 0.6), (2, 7, 1, 0.975)]


def test_top_segments_of_the_best_documents(spark):
    from leafwright.operators.search import top_segments

    rows = [(d, i, float((d * 7 + i * 3) % 11)) for d in range(6) for i in range(5)]
    got = {(r.doc_id, r.seg_id, r["rank"], r.doc_score) for r in top_segments(spark.createDataFrame(rows, "doc_id long, seg_id long, score double"), 2, 3).collect()}
    by = {d: sorted((r for r in rows if r[0] == d), key=lambda r: (-r[2], r[1]))[:2] for d in range(6)}
    best = sorted(by, key=lambda d: (-by[d][0][2], d))[:3]
    assert got == {(d, r[1], k, by[d][0][2]) for d in best for k, r in enumerate(by[d], 1)}
