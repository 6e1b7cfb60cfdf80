"""Evidence and citations: labels, duplicates, binding of sentences and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import write_stage
from ..sources.derived import PAGES, page_text
from ..sources.tables import load
from .text import tokens


def labels(text: Column) -> Column:
    """SEA17: the labels in double brackets."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """SET03, SET04, SET07: the first row of each key, in ``order``."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def bind_sentences(sentences: DataFrame, evidence: DataFrame, per: int = 2, least: float = 0.65) -> DataFrame:
    """JON19: each sentence's best evidence by token overlap and confidence; evidence that shares no token is never met.

    Sentences first meet evidence on the rarer half of their tokens. Evidence not met so has
    at most the other half, which bounds its score; sentences whose last place stays within
    that bound then meet evidence on all their tokens. So no evidence is missed, and common
    tokens bring pairs together for those sentences only.
    """
    e = evidence.where(F.col("confidence") >= least).select("evidence_id", "confidence", F.explode(tokens(F.col("quote"))).alias("tok"))
    counts = e.groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    s = sentences.withColumn("st", tokens(F.col("sentence"))).select("sentence_id", F.size("st").alias("n"), F.explode("st").alias("tok"))
    order = W.partitionBy("sentence_id").orderBy("c", "tok")
    s = s.join(counts, "tok").withColumn("i", F.row_number().over(order)).withColumn("met", F.count(F.lit(1)).over(W.partitionBy("sentence_id")))
    half = F.ceil(F.col("met") / 2)

    def ranked(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        # all tokens count once a pair has met
        j = asked.join(e, "tok").join(pairs, ["sentence_id", "evidence_id"], "left_semi") if pairs is not None else asked.join(e, "tok")
        j = j.groupBy("sentence_id", "evidence_id", "confidence", "n", "met").agg(F.count(F.lit(1)).alias("common"))
        score = F.round(0.75 * F.col("common") / F.greatest(F.lit(1), F.col("n")) + 0.25 * F.col("confidence"), 4)
        w = W.partitionBy("sentence_id").orderBy(F.desc("score"), "evidence_id")
        return j.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per)

    rare = s.where(F.col("i") <= half).join(e, "tok").select("sentence_id", "evidence_id").distinct()
    first = write_stage(ranked(s, rare), "bound")
    top = evidence.agg(F.max("confidence")).first()[0] or 0.0
    bound = F.round(0.75 * (F.col("met") - half) / F.greatest(F.lit(1), F.col("n")) + 0.25 * F.lit(float(top)), 4)
    done = first.where((F.col("rank") == per) & (F.col("score") > bound)).select("sentence_id")
    rest = ranked(s.join(done, "sentence_id", "left_anti"), None)
    columns = ["sentence_id", "evidence_id", "score", "rank"]
    return first.join(done, "sentence_id", "left_semi").select(columns).unionByName(rest.select(columns))


def fresh_evidence(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """JON02: evidence without a document, or whose document is still there at the recorded version."""
    d = docs.select(F.col("doc_id").alias("__d"), F.col("version").alias("__v"))
    j = evidence.join(d, F.col("doc_id") == F.col("__d"), "left")
    ok = F.col("doc_id").isNull() | (F.col("__d").isNotNull() & (F.col("version").isNull() | (F.col("version") == F.col("__v"))))
    return j.where(ok).drop("__d", "__v")


@query("sea17_labels", r"SELECT conv_id, turn, array_to_string(regexp_extract_all('[[a p.' || turn || ']] ' || text || ' [[b]]', '\[\[([^\[\]]+)\]\]', 1), ';') AS labels FROM conversations")
def _sea17(spark, d):
    c = load(spark, d, "conversations")
    said = F.concat(F.lit("[[a p."), F.col("turn").cast("string"), F.lit("]] "), F.col("text"), F.lit(" [[b]]"))
    return c.select("conv_id", "turn", F.array_join(labels(said), ";").alias("labels"))


@query("set07_keep_first", f"WITH {PAGES} SELECT doc_id, text, min(page) AS page FROM pg GROUP BY 1, 2")
def _set07(spark, d):
    return keep_first(page_text(spark, d), [F.col("doc_id"), F.col("text")], ["page"])


@query("jon02_fresh", "SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 20 WHERE o_orderkey % 5 = 0 OR (c_custkey IS NOT NULL AND (o_orderkey % 3 = 0 OR c_nationkey % 2 = o_orderkey % 2))")
def _jon02(spark, d):
    o = load(spark, d, "orders")
    e = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") + 20).alias("doc_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 2).alias("version"))
    docs = load(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_nationkey") % 2).alias("version"))
    return fresh_evidence(e, docs).select("o_orderkey")


_TOK = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+|[一-鿿]'))"


@query("jon19_bind", f"WITH s AS (SELECT item_id AS sentence_id, {_TOK('text')} AS st FROM benchmark), e AS (SELECT doc_id AS evidence_id, {_TOK('text')} AS et FROM documents), j AS (SELECT sentence_id, evidence_id, round(0.75 * len(list_intersect(st, et)) / greatest(1, len(st)) + 0.25 * 0.9, 4)::DOUBLE AS score FROM s, e WHERE len(list_intersect(st, et)) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY score DESC, evidence_id) AS rank FROM j) SELECT * FROM r WHERE rank <= 2")
def _jon19(spark, d):
    s = load(spark, d, "benchmark").select(F.col("item_id").alias("sentence_id"), F.col("text").alias("sentence"))
    e = load(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("quote"), F.lit(0.9).alias("confidence"))
    return bind_sentences(s, e)
