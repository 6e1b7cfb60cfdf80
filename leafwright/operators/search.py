"""BM25 retrieval, scoping, fusion with vectors, and ranking of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import write_stage
from ..sources.tables import load

K1, B = 1.5, 0.75
TOKEN = r"[\p{L}\p{N}]+"
TERMS = ["the", "and", "that", "with"]


def _is(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row under the query ``terms``; rows without any score 0.

    Statistics are of all rows: filter the result, not the input, to scope a search.
    Terms are picked within each row, so postings are never exploded: one pass over the
    texts writes term counts and lengths, from which statistics and scores follow.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    d = docs.select(key, words.alias("w"))
    d = d.select(key, F.size("w").alias("dl"), *[F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    d = write_stage(d, "terms")
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    d = d.crossJoin(F.broadcast(stats))  # one row
    part = lambda i: F.log1p((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return d.select(key, sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def cosine(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / (norm(a) * norm(b))


def minmax(df: DataFrame, score: str, out: str) -> DataFrame:
    """Scores of the rows at hand to [0, 1]; a single one becomes 0."""
    s = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    return df.crossJoin(F.broadcast(s)).withColumn(out, (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-8)).drop("__lo", "__hi")


def confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")


def top_segments(scored: DataFrame, per_doc: int = 3, top_k: int = 10, doc: str = "doc_id", seg: str = "seg_id") -> DataFrame:
    """The best segments of the best documents, each document ranked by its best segment."""
    w = W.partitionBy(doc).orderBy(F.desc("score"), seg)
    d = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_doc)
    best = d.groupBy(doc).agg(F.max("score").alias("doc_score")).orderBy(F.desc("doc_score"), doc).limit(top_k)
    return d.join(F.broadcast(best), doc)


_BM25 = r"""
w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
t AS (SELECT unnest(['the', 'and', 'that', 'with']) AS term),
f AS (SELECT doc_id, source, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, t),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM f GROUP BY term),
bm AS (SELECT doc_id, any_value(source) AS source, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM f JOIN df USING (term), st GROUP BY doc_id)"""


@query("bm25_topk", f"WITH {_BM25} SELECT doc_id, round(score, 4) AS score FROM bm ORDER BY round(score, 4) DESC, doc_id LIMIT 20")
def sea01_topk(spark, d):
    return bm25(load(spark, d, "documents"), TERMS).withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "doc_id").limit(20)


@query("sea02_scoped", f"WITH {_BM25} SELECT doc_id, round(score, 4) AS score FROM bm WHERE source IN ('src1', 'src2') ORDER BY round(score, 4) DESC, doc_id LIMIT 24")
def _sea02(spark, d):
    docs = load(spark, d, "documents")
    allowed = docs.where(F.col("source").isin("src1", "src2")).select("doc_id")
    return bm25(docs, TERMS).join(allowed, "doc_id", "left_semi").withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "doc_id").limit(24)


_HYBRID = (
    _BM25
    + """, hy AS (SELECT bm.doc_id, score, list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)) AS cos FROM bm JOIN embeddings ON vec_id = doc_id),
mm AS (SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-8) AS norm FROM hy)"""
)


@query("sea04_hybrid", f"WITH {_HYBRID} SELECT doc_id, round(0.7 * (cos + 1) / 2 + 0.3 * norm, 4) AS score, CASE WHEN round(0.7 * (cos + 1) / 2 + 0.3 * norm, 4) >= 0.7 THEN 'high' WHEN round(0.7 * (cos + 1) / 2 + 0.3 * norm, 4) >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM mm")
def _sea04(spark, d):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    s = bm25(load(spark, d, "documents"), TERMS).withColumnRenamed("score", "bm").join(e, F.col("doc_id") == F.col("vec_id"))
    s = minmax(s.crossJoin(F.broadcast(q)), "bm", "norm").withColumn("raw", 0.7 * (cosine("embedding", "q") + 1) / 2 + 0.3 * F.col("norm"))
    return s.select("doc_id", F.round("raw", 4).alias("score"), confidence(F.round("raw", 4)).alias("confidence"))


@query("sea03_minmax", f"WITH {_BM25} SELECT doc_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-8), 4) AS norm FROM bm")
def _sea03(spark, d):
    return minmax(bm25(load(spark, d, "documents"), TERMS), "score", "norm").select("doc_id", F.round("norm", 4).alias("norm"))


def keyword_relevance(text: Column, phrase: str, terms: list[str]) -> Column:
    """0.9 where the phrase occurs, else a sum over terms that occur, capped below it; 0 without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    score = F.least(F.lit(0.89), 0.3 + 0.15 * hits)
    return F.when(low.contains(phrase), F.lit(0.9)).when(hits > 0, score).otherwise(F.lit(0.0))


@query("sea13_keyword", "WITH k AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'of the') THEN 0.9 WHEN contains(t, 'the') OR contains(t, 'with') THEN round(least(0.89, 0.3 + 0.15 * (contains(t, 'the')::INT + contains(t, 'with')::INT)), 4) ELSE 0.0 END AS relevance FROM k")
def _sea13(spark, d):
    return load(spark, d, "documents").select("doc_id", F.round(keyword_relevance(F.col("text"), "of the", ["the", "with"]), 4).alias("relevance"))
