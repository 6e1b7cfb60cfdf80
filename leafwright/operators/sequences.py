"""More on ordered lists: batches, spreads, pagination, history, densifying and zips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import PAGES, TOC, files, page_text, toc_items
from ..sources.tables import load
from .text import tokens


def root_folder(folder: Column) -> Column:
    """FLT05: names that stand for the root become null."""
    return F.when(F.lower(F.trim(folder)).isin("", "root", "null", "none", "/"), None).otherwise(folder)


def batches(pages: DataFrame, size: int, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """WIN21: pages in batches of ``size``: first, last and count."""
    return pages.groupBy(doc, F.floor((F.col(page) - 1) / size).cast("int").alias("batch")).agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count(F.lit(1)).alias("n"))


def uniform_spread(items: DataFrame, last_page: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """WIN15: items spread evenly from page 1, halves rounded to even."""
    i = F.row_number().over(W.partitionBy(doc).orderBy(order)) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(doc))
    return items.withColumn("spread_page", (F.lit(1) + F.bround(i * F.col(last_page) / n)).cast("int"))


def paginate(items: DataFrame, part: int, size: int, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """SRT06: the ``part``-th run of ``size`` items of each document, from 1."""
    i = F.row_number().over(W.partitionBy(doc).orderBy(order))
    return items.withColumn("__i", i).where(F.col("__i").between((part - 1) * size + 1, part * size)).drop("__i")


def history_tail(messages: DataFrame, most: int = 6) -> DataFrame:
    """WIN23: of a conversation's last messages, those of user and assistant with content."""
    i = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("__i", i).where((F.col("__i") <= most) & F.col("role").isin("user", "assistant") & (F.trim("text") != "")).drop("__i")


def densify(nodes: DataFrame, span: int, start: str = "start_page", end: str = "end_page") -> DataFrame:
    """TRE16: spans longer than ``span`` pages cut into pieces of that length."""
    d = nodes.withColumn("piece_start", F.explode(F.sequence(start, end, F.lit(span))))
    return d.withColumn("piece_end", F.least(F.col("piece_start") + span - 1, F.col(end)))


def jaccard(a: Column, b: Column) -> Column:
    """SET14: shared tokens over all tokens, 0 without any."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def zip_in_order(left: DataFrame, right: DataFrame, doc: str, lo: str, ro: str) -> DataFrame:
    """JON21: the first of one side with the first of the other, and so on."""
    a = left.withColumn("__i", F.row_number().over(W.partitionBy(doc).orderBy(lo)))
    b = right.withColumn("__i", F.row_number().over(W.partitionBy(doc).orderBy(ro)))
    return a.join(b, [doc, "__i"]).drop("__i")


_LAST = "la AS (SELECT doc_id, max(page) AS last_page FROM pg GROUP BY 1)"


@query("flt05_root", "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'n' || c_nationkey END AS folder FROM customer")
def _flt05(spark, d):
    return files(spark, d).select("id", root_folder(F.coalesce("folder_id", F.lit(" Root "))).alias("folder"))


@query("win21_batches", f"WITH {PAGES} SELECT doc_id, CAST((page - 1) // 4 AS INT) AS batch, min(page) AS first, max(page) AS last, count(*) AS n FROM pg GROUP BY 1, 2")
def _win21(spark, d):
    return batches(page_text(spark, d), 4)


@query("win15_spread", f"WITH {TOC}, {_LAST} SELECT doc_id, ord, CAST(1 + round_even(CAST((row_number() OVER w - 1) * last_page AS DOUBLE) / count(*) OVER (PARTITION BY doc_id), 0) AS INT) AS spread_page FROM ti JOIN la USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def _win15(spark, d):
    last = page_text(spark, d).groupBy("doc_id").agg(F.max("page").alias("last_page"))
    return uniform_spread(toc_items(spark, d).join(last, "doc_id"), "last_page").select("doc_id", "ord", "spread_page")


@query("srt06_paginate", f"WITH {TOC} SELECT doc_id, ord FROM ti QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) BETWEEN 3 AND 4")
def _srt06(spark, d):
    return paginate(toc_items(spark, d), 2, 2).select("doc_id", "ord")


@query("win23_history", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) SELECT conv_id, turn, role FROM n WHERE i <= 6 AND role IN ('user', 'assistant') AND trim(text) <> ''")
def _win23(spark, d):
    return history_tail(load(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("tre16_densify", f"WITH {PAGES}, {_LAST}, p AS (SELECT doc_id, last_page, CAST(unnest(range(1, last_page + 1, 4)) AS INT) AS piece_start FROM la) SELECT doc_id, piece_start, least(piece_start + 3, last_page) AS piece_end FROM p")
def _tre16(spark, d):
    n = page_text(spark, d).groupBy("doc_id").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    return densify(n, 4).select("doc_id", "piece_start", "piece_end")


@query("jon21_zip", f"WITH {TOC}, a AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM ti), b AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM pg WHERE page % 2 = 0) SELECT doc_id, ord, page FROM a JOIN b USING (doc_id, i)")
def _jon21(spark, d):
    return zip_in_order(toc_items(spark, d).select("doc_id", "ord"), page_text(spark, d).where("page % 2 = 0").select("doc_id", "page"), "doc_id", "ord", "page")


_TK = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+|[一-鿿]'))"


@query("set14_jaccard", f"WITH {TOC}, n AS (SELECT doc_id, ord, {_TK('title')} AS a, {_TK('lead(title) OVER (PARTITION BY doc_id ORDER BY ord)')} AS b FROM ti) SELECT doc_id, ord, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 0), 4)::DOUBLE AS similarity FROM n WHERE b IS NOT NULL")
def _set14(spark, d):
    t = toc_items(spark, d).withColumn("next", F.lead("title").over(W.partitionBy("doc_id").orderBy("ord"))).where("next is not null")
    return t.select("doc_id", "ord", F.round(jaccard(tokens(F.col("title")), tokens(F.col("next"))), 4).alias("similarity"))
