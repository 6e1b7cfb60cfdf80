"""Ordered sequences and page intervals: ranges, gaps, fills, runs and containment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import PAGES, TOC, page_text, toc_items


def _by(key: str, *order) -> W:
    return W.partitionBy(key).orderBy(*order)


def assign_ranges(items: DataFrame, last_page: str, doc: str = "doc_id", order: str = "ord", start: str = "page") -> DataFrame:
    """WIN03: an item ends before the next one starts, at its own start at least; the last at ``last_page``."""
    nxt = F.lead(start).over(_by(doc, order))
    return items.withColumn("end_page", F.when(nxt.isNull(), F.greatest(F.col(last_page), F.col(start))).otherwise(F.greatest(nxt - 1, F.col(start))))


def fill_previous_else_next(items: DataFrame, value: str, out: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """JON13: a missing value is that of the nearest row before, else after."""
    before = F.last(value, ignorenulls=True).over(_by(doc, order).rowsBetween(W.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(_by(doc, order).rowsBetween(0, W.unboundedFollowing))
    return items.withColumn(out, F.coalesce(before, after))


def fill_next_else_previous(items: DataFrame, value: str, out: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """JON14: the other way round."""
    before = F.last(value, ignorenulls=True).over(_by(doc, order).rowsBetween(W.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(_by(doc, order).rowsBetween(0, W.unboundedFollowing))
    return items.withColumn(out, F.coalesce(after, before))


def monotone(items: DataFrame, value: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """WIN06: whether values never fall, for each document."""
    d = items.where(F.col(value).isNotNull()).withColumn("__up", F.coalesce(F.col(value) >= F.lag(value).over(_by(doc, order)), F.lit(True)))
    return d.groupBy(doc).agg(F.bool_and("__up").alias("monotone"))


def running_max(items: DataFrame, value: str, out: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """WIN14: values made monotone by the largest so far."""
    return items.withColumn(out, F.max(value).over(_by(doc, order).rowsBetween(W.unboundedPreceding, 0)))


def keep_monotone(items: DataFrame, value: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """FLT12: rows at least as large as all before them."""
    most = F.max(value).over(_by(doc, order).rowsBetween(W.unboundedPreceding, -1))
    return items.withColumn("__m", most).where(F.col("__m").isNull() | (F.col(value) >= F.col("__m"))).drop("__m")


def runs(pages: DataFrame, page: str = "page", doc: str = "doc_id") -> DataFrame:
    """Islands of consecutive distinct pages: first, last and length."""
    d = pages.select(doc, page).distinct().withColumn("__i", F.col(page) - F.row_number().over(_by(doc, page)))
    return d.groupBy(doc, "__i").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count(F.lit(1)).alias("length")).drop("__i")


def longest_run(pages: DataFrame, page: str = "page", doc: str = "doc_id") -> DataFrame:
    """WIN08: each document's longest run, the first of equals."""
    w = W.partitionBy(doc).orderBy(F.desc("length"), "first")
    return runs(pages, page, doc).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def common_step(items: DataFrame, value: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """AGG11: the commonest difference of neighbours, the first seen of equals."""
    d = items.withColumn("step", F.lead(value).over(_by(doc, order)) - F.col(value)).where("step is not null")
    d = d.groupBy(doc, "step").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return d.withColumn("__r", F.row_number().over(W.partitionBy(doc).orderBy(F.desc("n"), "seen"))).where("__r = 1").drop("__r", "seen")


def best_node(pages: DataFrame, nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JON09: for each page the most specific node covering it; else the first node after; else the last.

    The join is on the document, so nodes are compared with pages of their own only.
    """
    j = pages.join(nodes, doc)
    covers = (F.col("start_page") <= F.col("page")) & (F.col("page") <= F.col("end_page"))
    tier = F.when(covers, 0).when(F.col("start_page") >= F.col("page"), 1).otherwise(2)
    size = F.when(covers, F.col("end_page") - F.col("start_page")).when(F.col("start_page") >= F.col("page"), F.col("ord")).otherwise(-F.col("ord"))
    w = W.partitionBy(doc, "page").orderBy("tier", "size", "ord")
    return j.withColumn("tier", tier).withColumn("size", size).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "size")


def node_text(pages: DataFrame, nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JON10: texts of the pages that a node spans, in order, a line each.

    A node's pages are rows, so that pages meet their own nodes by an equal join.
    """
    j = nodes.where("start_page <= end_page").withColumn("page", F.explode(F.expr("sequence(start_page, end_page)"))).join(pages, [doc, "page"])
    got = j.groupBy(doc, "ord").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return got.select(doc, "ord", F.array_join(F.transform("p", lambda x: x.text), "\n").alias("node_text"))


def coverage(nodes: DataFrame, last_page: str = "last_page", doc: str = "doc_id") -> DataFrame:
    """INT03: pages that no node covers, and a class by how many may be missing."""
    d = nodes.select(doc, last_page, F.explode(F.expr("sequence(start_page, least(end_page, last_page))")).alias("page"))
    d = d.groupBy(doc, last_page).agg(F.countDistinct("page").alias("covered"))
    missing = F.col(last_page) - F.col("covered")
    allowed = F.least(F.greatest(F.lit(2), F.ceil(F.col(last_page) * 0.05)), F.lit(10))
    return d.select(doc, missing.alias("missing"), F.when(missing == 0, "good").when(missing <= allowed, "ok").when(missing <= 2 * allowed, "warning").otherwise("bad").alias("class"))


def clamp(page: Column, last: Column) -> Column:
    """INT04."""
    return F.greatest(F.lit(1), F.least(page, last))


def sibling_overlap_ranges(items: DataFrame, last_page: str, top: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """WIN04: an item ends where the next starts, or before it if that starts on top of its page."""
    w = _by(doc, order)
    nxt, on_top = F.lead("page").over(w), F.lead(top).over(w)
    return items.withColumn("end_page", F.when(nxt.isNull(), F.col(last_page)).when(on_top, F.greatest(nxt - 1, F.col("page"))).otherwise(nxt))


_LAST = "la AS (SELECT doc_id, max(page) AS last_page FROM pg GROUP BY 1)"
_RANGES = f"{TOC}, {_LAST}, ra AS (SELECT ti.*, last_page, CASE WHEN lead(ti.page) OVER (PARTITION BY ti.doc_id ORDER BY ord) IS NULL THEN greatest(last_page, ti.page) ELSE greatest(lead(ti.page) OVER (PARTITION BY ti.doc_id ORDER BY ord) - 1, ti.page) END AS end_page FROM ti JOIN la USING (doc_id))"


def _ranged(spark, d) -> DataFrame:
    last = page_text(spark, d).groupBy("doc_id").agg(F.max("page").alias("last_page"))
    return assign_ranges(toc_items(spark, d).join(last, "doc_id"), "last_page")


def _nodes(spark, d) -> DataFrame:
    # chapters hold three items each, so that nodes nest
    r = _ranged(spark, d)
    wide = r.groupBy("doc_id", F.expr("ord div 3").alias("g")).agg(F.min("page").alias("start_page"), F.max("end_page").alias("end_page"), (F.min("ord") + 1000).alias("ord"))
    return r.select("doc_id", "ord", F.col("page").alias("start_page"), "end_page").unionByName(wide.select("doc_id", "ord", "start_page", "end_page"))


_NODES = f"{_RANGES}, no AS (SELECT doc_id, ord, page AS start_page, end_page FROM ra UNION ALL SELECT doc_id, min(ord) + 1000, min(page), max(end_page) FROM ra GROUP BY doc_id, ord // 3)"


@query("win03_ranges", f"WITH {_RANGES} SELECT doc_id, ord, page, end_page FROM ra")
def _win03(spark, d):
    return _ranged(spark, d).select("doc_id", "ord", "page", "end_page")


@query("jon09_best_node", f"WITH {_NODES}, j AS (SELECT pg.doc_id, pg.page, no.ord, CASE WHEN pg.page BETWEEN start_page AND end_page THEN 0 WHEN start_page >= pg.page THEN 1 ELSE 2 END AS tier, CASE WHEN pg.page BETWEEN start_page AND end_page THEN end_page - start_page WHEN start_page >= pg.page THEN ord ELSE -ord END AS size FROM pg JOIN no USING (doc_id)) SELECT doc_id, page, ord, tier FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY tier, size, ord) = 1")
def _jon09(spark, d):
    return best_node(page_text(spark, d).select("doc_id", "page"), _nodes(spark, d)).select("doc_id", "page", "ord", "tier")


@query("jon10_node_text", f"WITH {_NODES} SELECT no.doc_id, no.ord, string_agg(pg.text, chr(10) ORDER BY pg.page) AS node_text FROM no JOIN pg ON pg.doc_id = no.doc_id AND pg.page BETWEEN start_page AND end_page GROUP BY 1, 2")
def _jon10(spark, d):
    return node_text(page_text(spark, d), _nodes(spark, d))


_HOLES = f"{TOC}, ho AS (SELECT *, CASE WHEN ord % 3 = 1 THEN NULL ELSE page END AS known FROM ti)"


def _holes(spark, d) -> DataFrame:
    return toc_items(spark, d).withColumn("known", F.when(F.col("ord") % 3 != 1, F.col("page")))


@query("jon13_fill", f"WITH {_HOLES} SELECT doc_id, ord, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), first_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM ho")
def _jon13(spark, d):
    return fill_previous_else_next(_holes(spark, d), "known", "filled").select("doc_id", "ord", "filled")


@query("jon14_fill", f"WITH {_HOLES} SELECT doc_id, ord, coalesce(first_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS filled FROM ho")
def _jon14(spark, d):
    return fill_next_else_previous(_holes(spark, d), "known", "filled").select("doc_id", "ord", "filled")


_LONG = f"{PAGES}, lo AS (SELECT doc_id, page FROM pg WHERE length(text) > 100)"


def _long(spark, d) -> DataFrame:
    return page_text(spark, d).where("length(text) > 100").select("doc_id", "page")


@query("win08_longest_run", f"WITH {_LONG}, i AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM lo), r AS (SELECT doc_id, min(page) AS first, max(page) AS last, count(*) AS length FROM i GROUP BY doc_id, k) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, first) = 1")
def _win08(spark, d):
    return longest_run(_long(spark, d))


@query("win09_gaps", f"WITH {_LONG}, g AS (SELECT doc_id, page FROM pg EXCEPT SELECT doc_id, page FROM lo), i AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM g) SELECT doc_id, min(page) AS first, max(page) AS last, count(*) AS length FROM i GROUP BY doc_id, k")
def _win09(spark, d):
    p = page_text(spark, d).select("doc_id", "page")
    return runs(p.join(_long(spark, d), ["doc_id", "page"], "left_anti"))


@query("agg11_common_step", f"WITH {_LONG}, s AS (SELECT doc_id, page, lead(page) OVER (PARTITION BY doc_id ORDER BY page) - page AS step FROM lo), c AS (SELECT doc_id, step, count(*) AS n, min(page) AS seen FROM s WHERE step IS NOT NULL GROUP BY 1, 2) SELECT doc_id, step, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) = 1")
def _agg11(spark, d):
    return common_step(_long(spark, d), "page", order="page")


_WILD = f"{TOC}, wi AS (SELECT *, (page * 7) % 11 AS claimed FROM ti)"


def _wild(spark, d) -> DataFrame:
    return toc_items(spark, d).withColumn("claimed", F.col("page") * 7 % 11)


@query("win06_monotone", f"WITH {_WILD}, u AS (SELECT doc_id, coalesce(claimed >= lag(claimed) OVER (PARTITION BY doc_id ORDER BY ord), true) AS up FROM wi) SELECT doc_id, bool_and(up) AS monotone FROM u GROUP BY 1")
def _win06(spark, d):
    return monotone(_wild(spark, d), "claimed")


@query("win14_running_max", f"WITH {_WILD} SELECT doc_id, ord, max(claimed) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS forced FROM wi")
def _win14(spark, d):
    return running_max(_wild(spark, d), "claimed", "forced").select("doc_id", "ord", "forced")


@query("flt12_keep_monotone", f"WITH {_WILD}, m AS (SELECT *, max(claimed) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM wi) SELECT doc_id, ord, claimed FROM m WHERE m IS NULL OR claimed >= m")
def _flt12(spark, d):
    return keep_monotone(_wild(spark, d), "claimed").select("doc_id", "ord", "claimed")


@query("int03_coverage", f"WITH {_RANGES}, e AS (SELECT doc_id, last_page, unnest(range(page, least(end_page, last_page) + 1)) AS p FROM ra WHERE ord % 4 <> 1), c AS (SELECT doc_id, last_page, count(DISTINCT p) AS covered FROM e GROUP BY 1, 2), m AS (SELECT doc_id, last_page - covered AS missing, least(greatest(2, ceil(last_page * 0.05)), 10) AS a FROM c) SELECT doc_id, missing, CASE WHEN missing = 0 THEN 'good' WHEN missing <= a THEN 'ok' WHEN missing <= 2 * a THEN 'warning' ELSE 'bad' END AS class FROM m")
def _int03(spark, d):
    return coverage(_ranged(spark, d).where("ord % 4 != 1").withColumnRenamed("page", "start_page"))


@query("win04_overlap_ranges", f"WITH {TOC}, {_LAST} SELECT doc_id, ord, coalesce(CASE WHEN lead(ord % 2 = 0) OVER w THEN greatest(lead(ti.page) OVER w - 1, ti.page) ELSE lead(ti.page) OVER w END, last_page) AS end_page FROM ti JOIN la USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def _win04(spark, d):
    last = page_text(spark, d).groupBy("doc_id").agg(F.max("page").alias("last_page"))
    return sibling_overlap_ranges(toc_items(spark, d).join(last, "doc_id").withColumn("top", F.col("ord") % 2 == 0), "last_page", "top").select("doc_id", "ord", "end_page")
