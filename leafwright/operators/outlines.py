"""Outlines: tree ranges and totals, page maps, candidate scores and quality gates.

Every operator works within a document by windows on (document, order), so a document's
items are one sort group and no two documents are ever compared.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import PAGES, TOC, page_text, toc_items
from .hierarchy import MAX_LEVEL, parents_by_level
from .scalars import noise_title


def _ahead(doc: str, order: str) -> W:
    return W.partitionBy(doc).orderBy(order).rowsBetween(1, W.unboundedFollowing)


def subtree_ends(items: DataFrame, doc: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """TRE08: where each item's descendants end: the next item at its level or above, null at the document's end."""
    nxt = F.coalesce(*[F.when(F.col(level) == k, F.min(F.when(F.col(level) <= k, F.col(order))).over(_ahead(doc, order))) for k in range(1, MAX_LEVEL + 1)])
    return items.withColumn("until", nxt)


def is_descendant(order: Column, ancestor: Column, until: Column) -> Column:
    """TRE08: whether an item lies in the subtree that starts at ``ancestor``."""
    return (order > ancestor) & (until.isNull() | (order < until))


def subtree_totals(items: DataFrame, value: str, out: str, doc: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """AGG22: an item's value and those of all its descendants.

    Running sums don't fall where values aren't negative, so the sum before the subtree's end
    is the least of those ahead at the item's level or above.
    """
    run = F.sum(value).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    d = items.withColumn("__run", run).withColumn("__all", F.sum(value).over(W.partitionBy(doc)))
    end = F.coalesce(*[F.when(F.col(level) == k, F.min(F.when(F.col(level) <= k, F.col("__run"))).over(_ahead(doc, order))) for k in range(1, MAX_LEVEL + 1)], F.col("__all"))
    return d.withColumn(out, end - F.col("__run")).drop("__run", "__all")


def with_ancestors(items: DataFrame, doc: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """TRE01: each row's ancestors, the root first; their number is its depth from 0.

    They are the last rows before at lesser levels, but for those with a later row above them.
    """
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w) for k in range(1, MAX_LEVEL)]
    d = items.withColumn("__last", F.array(*last))
    seen = F.transform("__last", lambda x, i: F.when(i < F.col(level) - 1, x))
    later = lambda x, i: F.coalesce(x > F.array_max(F.concat(F.array(F.lit(-1).cast("int")), F.slice(seen, 1, i))), F.lit(False))
    return d.withColumn("ancestors", F.array_compact(F.transform(seen, lambda x, i: F.when(later(x, i), x)))).drop("__last")


def widen_parents(items: DataFrame, end: str, doc: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """TRE10: an item ends no sooner than any of its descendants. Each row goes to its ancestors, at most one a level."""
    up = with_ancestors(items, doc, order, level).select(doc, F.explode("ancestors").alias(order), F.col(end).alias("__e"))
    deep = up.groupBy(doc, order).agg(F.max("__e").alias("__deep"))
    return items.join(deep, [doc, order], "left").withColumn(end, F.greatest(end, "__deep")).drop("__deep")


def with_preface(items: DataFrame, doc: str = "doc_id", order: str = "ord", page: str = "page", title: str = "Preface") -> DataFrame:
    """TRE12, ADD01: a first row for page 1 of documents whose first item starts later; it comes before all."""
    first = items.withColumn("__i", F.row_number().over(W.partitionBy(doc).orderBy(order))).where((F.col("__i") == 1) & (F.col(page) > 1))
    new = {order: F.col(order) - 1, page: F.lit(1).cast(items.schema[page].dataType), "title": F.lit(title), "structure": F.lit("0")}
    return items.unionByName(first.select(*[new[c].cast(items.schema[c].dataType).alias(c) if c in new else F.col(c) for c in items.columns]))


def expansion_candidates(nodes: DataFrame, attempt: int = 8, hard: int = 16) -> DataFrame:
    """TRE19: leaves that span ``attempt`` pages, ``hard`` where a root must be expanded."""
    span = F.col("end_page") - F.col("start_page") + 1
    return nodes.where(F.col("leaf") & (span >= attempt)).withColumn("required", (span >= hard) & (F.col("level") == 1))


def depth_of(structure: Column) -> Column:
    """TRE03: the depth of ``1.2.3``; ``0`` and nothing are roots."""
    return F.when(structure.isin("", "0"), 1).otherwise(F.size(F.split(structure, r"\.")))


def valid_pages(items: DataFrame, last_page: str, page: str = "page", group: Column | None = None) -> DataFrame:
    """FLT10: items on a page of the document, and catalog groups wherever they are."""
    ok = F.col(page).between(F.lit(1), F.col(last_page))
    return items.where(ok if group is None else ok | group)


def catalog_kind(title: Column) -> Column:
    """CLS11: what a catalog lists. The titles of lists."""
    t = F.lower(F.trim(title))
    return F.when(t.isin("figure catalog", "list of figures", "图目录", "插图目录"), "figure").when(t.isin("table catalog", "list of tables", "表目录"), "table").otherwise("main")


def collapse(items: DataFrame, page: str = "page", doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """WIN16: of five items or more, over 30 % and three at least on the last page, or leading on the first's.

    Items without a page count as items, but neither as first nor as last.
    """
    w = W.partitionBy(doc).orderBy(order)
    every = W.partitionBy(doc)
    d = items.withColumn("__n", F.count(F.lit(1)).over(every)).where(F.col(page).isNotNull())
    d = d.withColumn("__first", F.first(page).over(w)).withColumn("__last", F.max(page).over(every))
    d = d.withColumn("__lead", F.max((F.col(page) != F.col("__first")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 0)
    got = d.groupBy(doc, "__n").agg(F.count_if(F.col(page) == F.col("__last")).alias("t"), F.count_if("__lead").alias("f"), F.min("__first").alias("__first"), F.max("__last").alias("__last"))
    bad = lambda c, at: (F.col("__n") >= 5) & (F.col(at) > 0) & (F.col(c) / F.col("__n") > 0.3) & (F.col(c) >= 3)
    return got.select(doc, bad("t", "__last").alias("tail"), bad("f", "__first").alias("front"))


def anchor_thirds(items: DataFrame, anchor: Column, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """WIN17: whether the first, middle and last third of a document's items hold an anchor."""
    i = F.row_number().over(W.partitionBy(doc).orderBy(order)) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(doc))
    d = items.select(doc, i.alias("i"), n.alias("n"), anchor.alias("a"))
    a = F.greatest(F.lit(1), F.expr("n div 3"))
    b = F.greatest(F.lit(2), F.expr("2 * n div 3"))
    at = lambda c: F.coalesce(F.bool_or(F.col("a") & c), F.lit(False))
    return d.groupBy(doc).agg(at(F.col("i") < a).alias("front"), at((F.col("i") >= a) & (F.col("i") < b)).alias("middle"), at(F.col("i") >= b).alias("back"))


def matching_prefix(pages: DataFrame, matches: Column, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """WIN11: the first run of matching pages; what matches after the first miss is left."""
    w = W.partitionBy(doc).orderBy(page).rowsBetween(W.unboundedPreceding, 0)
    d = pages.withColumn("__m", matches).withColumn("__begun", F.max(F.col("__m").cast("int")).over(w))
    d = d.withColumn("__missed", F.sum(((F.col("__begun") == 1) & ~F.col("__m")).cast("int")).over(w))
    return d.where(F.col("__m") & (F.col("__missed") == 0)).drop("__m", "__begun", "__missed")


def pack(items: DataFrame, size: str, limit: int, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """WIN20: items in order into groups of at most ``limit``; what alone is larger has its own.

    Each group's start depends on the one before, so a document's sizes are gone through in
    order, in one group of Arrow rows. A null size counts nothing.
    """
    d = items.select(doc, F.col(order).cast("int").alias(order), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__s"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(order, "ascending"), ("__s", "ascending")])
        group, used, groups = 0, 0, []
        for i, s in enumerate(rows["__s"].to_pylist()):
            if i and used + s > limit:
                group, used = group + 1, 0
            used += s
            groups.append(group)
        return rows.select([doc, order]).append_column("group", pa.array(groups, pa.int32()))

    return d.groupBy(doc).applyInArrow(run, d.select(doc, order, F.lit(0).alias("group")).schema)


def printed_to_physical(items: DataFrame, printed: str, anchored: str, doc: str = "doc_id") -> DataFrame:
    """INT09: printed pages moved by the document's offset, the upper median over anchored items (AGG12).

    Documents without an anchor keep their printed pages.
    """
    offsets = items.where(F.col(anchored).isNotNull()).withColumn("__d", F.col(anchored) - F.col(printed))
    w = W.partitionBy(doc).orderBy("__d")
    o = offsets.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(doc)))
    o = o.where("__i = __n div 2").select(doc, F.col("__d").alias("offset"))
    return items.join(o, doc, "left").withColumn("physical", F.col(printed) + F.coalesce("offset", F.lit(0)))


def printed_plausible(items: DataFrame, last_page: str, page: str = "page", doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """TOC04: whether pages can be printed ones: three at least, none past the end, and not just 1, 2, 3 …"""
    w = W.partitionBy(doc).orderBy(order)
    d = items.where(F.col(page).isNotNull()).withColumn("__up", F.coalesce(F.col(page) >= F.lag(page).over(w), F.lit(True)))
    g = d.groupBy(doc, last_page).agg(F.count(F.lit(1)).alias("n"), F.max(page).alias("most"), F.countDistinct(page).alias("k"), F.bool_and("__up").alias("up"))
    counting = (F.col("k") == F.col("n")) & F.col("up") & (F.col("most") <= F.greatest(F.lit(4), F.col("n")))
    return g.select(doc, ((F.col("n") >= 3) & (F.col("most") <= F.col(last_page)) & ~counting).alias("plausible"))


def mapping_score(items: DataFrame, doc: str = "doc_id", page: str = "page", source: str = "source", least: float = 0.55) -> DataFrame:
    """MAP08: 0.7 of the title matches, 0.15 of what isn't estimated, 0.15 of what is mapped; failed ones below 0.5."""
    g = items.groupBy(doc).agg(F.avg((F.col(source) == "title_search").cast("int")).alias("match"), F.avg((F.col(source) == "estimated").cast("int")).alias("est"), F.avg(F.col(page).isNotNull().cast("int")).alias("mapped"))
    score = 0.7 * F.col("match") + 0.15 * (1 - F.col("est")) + 0.15 * F.col("mapped")
    ok = F.col("match") >= least
    return g.select(doc, F.round(F.when(ok, score).otherwise(F.least(score, F.lit(0.49))), 4).alias("score"), ok.alias("passed"))


def candidate_score(preselect: Column, mapping: Column, conflict: Column, coverage: Column) -> Column:
    """QLT10: what a candidate outline is worth."""
    return 0.55 * preselect + 0.25 * mapping + 0.1 * conflict + 0.1 * coverage


def toc_leakage(nodes: DataFrame, toc_pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """INT07: nodes that reach into the outline's own pages, catalogs apart."""
    t = toc_pages.groupBy(doc).agg(F.min("page").alias("__a"), F.max("page").alias("__b"))
    hit = (F.col("start_page") <= F.col("__b")) & (F.col("end_page") >= F.col("__a")) & (catalog_kind(F.col("title")) == "main")
    return nodes.join(t, doc).where(hit).drop("__a", "__b")


def range_failures(nodes: DataFrame, last_page: str, doc: str = "doc_id") -> DataFrame:
    """INT08: how many nodes lack a page, end before they start, or leave the document."""
    a, b = F.col("start_page"), F.col("end_page")
    return nodes.groupBy(doc).agg(F.count_if(a.isNull() | b.isNull()).alias("missing"), F.count_if(b < a).alias("inverted"), F.count_if((a < 1) | (b > F.col(last_page))).alias("outside"))


def tree_style(items: DataFrame, doc: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """QLT11: by how many roots have children: none, all or some; a lone root without any is collapsed."""
    root = F.when(F.size("ancestors") == 0, F.col(order)).otherwise(F.get("ancestors", F.lit(0)))
    r = with_ancestors(items, doc, order, level).withColumn("__root", root).groupBy(doc, "__root").agg(F.count(F.lit(1)).alias("size"))
    g = r.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > F.lit(1)).alias("c"))
    return g.select(doc, F.when((F.col("c") == 0) & (F.col("n") == 1), "collapsed").when(F.col("c") == 0, "flat").when(F.col("c") == F.col("n"), "hierarchical").otherwise("mixed").alias("style"))


def structure_quality(items: DataFrame, doc: str = "doc_id", title: str = "title", depth: str = "level") -> DataFrame:
    """AGG16, AGG17: ratios of noisy, short and distinct titles, the depth, and a score that falls with each fault."""
    t = F.trim(title)
    g = items.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.avg(noise_title(t).cast("int")).alias("b"), F.avg((F.char_length(t) <= 4).cast("int")).alias("s"), (F.countDistinct(F.when(t != "", t)) / F.count(F.lit(1))).alias("u"), F.max(depth).alias("depth"))
    fault = lambda c, x: F.when(c, x).otherwise(0.0)
    n = F.col("n")
    score = 1 - F.col("b") - fault(n <= 1, 0.35) - fault((F.col("depth") <= 1) & (n >= 6), 0.15) - fault((F.col("s") > 0.4) & (n >= 4), 0.12) - fault((F.col("u") < 0.6) & (n >= 5), 0.1)
    return g.select(doc, F.round("b", 4).alias("bad_ratio"), F.round("s", 4).alias("short_ratio"), F.round("u", 4).alias("unique_ratio"), "depth", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"))


def shallow(items: DataFrame, last_page: str, doc: str = "doc_id", order: str = "ord", page: str = "page") -> DataFrame:
    """ADD02: two items or more but few for the pages, in order, with six pages or more between two of them."""
    gap = F.lead(page).over(W.partitionBy(doc).orderBy(order)) - F.col(page)
    g = items.withColumn("__gap", gap).groupBy(doc, last_page).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("__gap"), F.lit(0)).alias("lo"), F.coalesce(F.max("__gap"), F.lit(0)).alias("hi"))
    few = F.col("n") <= F.greatest(F.lit(8.0), F.col(last_page) / 6)
    return g.select(doc, ((F.col("n") >= 2) & few & (F.col("lo") >= 0) & (F.col("hi") >= 6)).alias("shallow"))


def drop_parent_echo(items: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """SET08: without children titled as their parent."""
    d = parents_by_level(items, doc, order)
    p = items.select(F.col(doc).alias("__d"), F.col(order).alias("__o"), F.lower(F.trim("title")).alias("__t"))
    j = d.join(p, (F.col(doc) == F.col("__d")) & (F.col("parent_ord") == F.col("__o")), "left")
    return j.where(F.col("__t").isNull() | (F.col("__t") != F.lower(F.trim("title")))).drop("__d", "__o", "__t")


def uncovered(items: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """SET11: pages that no node covers. Each node's pages are listed, so the join is an equal one."""
    c = items.select(doc, F.explode(F.expr("sequence(start_page, end_page)")).alias("page")).distinct()
    return pages.select(doc, "page").join(c, [doc, "page"], "left_anti")


def content_type(coverage: Column, images: Column, image_only: Column, garbled: Column, quality: Column, edges_only: Column) -> Column:
    """CLS02: ocr where images or garbage prevail; a reliable text layer with a bare cover or back is text; else hybrid by any fault."""
    ocr = (image_only >= 0.9) | (garbled >= 0.5) | ((coverage <= 0.05) & (images >= 0.5)) | (quality == "garbled")
    sparse = (quality == "reliable") & (coverage >= 0.95) & (garbled == 0) & (image_only <= 0.05) & edges_only
    return F.when(ocr, "ocr").when(sparse, "text").when((image_only > 0) | (garbled > 0) | quality.isin("partial", "noisy"), "hybrid").otherwise("text")


_N = "ln AS (SELECT doc_id, max(page) AS last_page FROM pg GROUP BY 1)"
_SPAN = f"{TOC}, {_N}, nd AS (SELECT ti.*, last_page, page AS start_page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY ord) - 1, last_page) AS end_page FROM ti JOIN ln USING (doc_id))"
_END = "(SELECT min(b.ord) FROM ti b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level)"


def spans(spark, d) -> DataFrame:
    last = page_text(spark, d).groupBy("doc_id").agg(F.max("page").alias("last_page"))
    n = toc_items(spark, d).join(last, "doc_id").withColumn("start_page", F.col("page"))
    return n.withColumn("end_page", F.coalesce(F.lead("page").over(W.partitionBy("doc_id").orderBy("ord")) - 1, "last_page"))


@query("tre08_subtree", f"WITH {TOC} SELECT doc_id, ord, {_END} AS until FROM ti a")
def _tre08(spark, d):
    return subtree_ends(toc_items(spark, d)).select("doc_id", "ord", "until")


@query("agg22_subtree", f"WITH {TOC} SELECT doc_id, ord, CAST((SELECT sum(length(c.title)) FROM ti c WHERE c.doc_id = a.doc_id AND c.ord >= a.ord AND c.ord < coalesce({_END}, 1000000)) AS BIGINT) AS total FROM ti a")
def _agg22(spark, d):
    return subtree_totals(toc_items(spark, d).withColumn("v", F.char_length("title")), "v", "total").select("doc_id", "ord", "total")


@query("tre10_widen", f"WITH {_SPAN}, e AS (SELECT a.*, {_END} AS until FROM nd a) SELECT a.doc_id, a.ord, greatest(a.end_page, coalesce((SELECT max(c.end_page) FROM nd c WHERE c.doc_id = a.doc_id AND c.ord > a.ord AND (a.until IS NULL OR c.ord < a.until)), 0)) AS end_page FROM e a")
def _tre10(spark, d):
    return widen_parents(spans(spark, d), "end_page").select("doc_id", "ord", "end_page")


@query("tre01_flatten", f"WITH {TOC} SELECT a.doc_id, a.ord, (SELECT count(DISTINCT b.level) FROM ti b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM ti c WHERE c.doc_id = a.doc_id AND c.ord > b.ord AND c.ord < a.ord AND c.level < b.level))::INT AS depth FROM ti a")
def _tre01(spark, d):
    return with_ancestors(toc_items(spark, d)).select("doc_id", "ord", F.size("ancestors").alias("depth"))


@query("tre12_preface", f"WITH {TOC}, x AS (SELECT * FROM ti WHERE ord <> 0 OR doc_id % 2 = 0) SELECT doc_id, ord, title, page FROM x UNION ALL SELECT doc_id, min(ord) - 1, 'Preface', 1 FROM x GROUP BY 1 HAVING min(page) > 1")
def _tre12(spark, d):
    x = toc_items(spark, d).where("ord <> 0 or doc_id % 2 = 0")
    return with_preface(x).select("doc_id", "ord", "title", "page")


@query("tre19_expand", f"WITH {_SPAN} SELECT doc_id, ord, end_page - start_page + 1 >= 4 AND level = 1 AS required FROM nd a WHERE end_page - start_page + 1 >= 3 AND NOT coalesce((SELECT b.level > a.level FROM ti b WHERE b.doc_id = a.doc_id AND b.ord = a.ord + 1), false)")
def _tre19(spark, d):
    n = spans(spark, d).withColumn("leaf", F.coalesce(F.lead("level").over(W.partitionBy("doc_id").orderBy("ord")) <= F.col("level"), F.lit(True)))
    return expansion_candidates(n, 3, 4).select("doc_id", "ord", "required")


@query("tre03_depth", f"WITH {TOC} SELECT doc_id, ord, CASE WHEN ord % 5 = 0 THEN 1 ELSE 2 END AS depth FROM ti")
def _tre03(spark, d):
    s = F.when(F.col("ord") % 5 == 0, F.lit("0")).otherwise(F.col("structure"))
    return toc_items(spark, d).select("doc_id", "ord", depth_of(s).alias("depth"))


@query("flt10_valid", f"WITH {TOC}, {_N} SELECT doc_id, ord FROM ti JOIN ln USING (doc_id) WHERE page * 2 - 2 BETWEEN 1 AND last_page OR ord = 0")
def _flt10(spark, d):
    return valid_pages(spans(spark, d).withColumn("at", F.col("page") * 2 - 2), "last_page", "at", F.col("ord") == 0).select("doc_id", "ord")


@query("flt11_catalogs", f"WITH {TOC} SELECT doc_id, ord, CASE ord % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'main' END AS kind FROM ti")
def _flt11(spark, d):
    t = F.expr("case ord % 3 when 0 then ' List of Figures' when 1 then '表目录' else title end")
    return toc_items(spark, d).select("doc_id", "ord", catalog_kind(t).alias("kind"))


_COLL = "cl AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 4 THEN NULL WHEN doc_id % 2 = 0 THEN least(page, 4) ELSE greatest(page, 7) END AS pt FROM ti)"


@query("win16_collapse", f"WITH {TOC}, {_COLL}, n AS (SELECT doc_id, count(*) AS n FROM cl GROUP BY 1), p AS (SELECT doc_id, pt, max(pt) OVER (PARTITION BY doc_id) AS hi, first(pt) OVER w AS lo, min(ord) FILTER (pt <> f) OVER (PARTITION BY doc_id) AS miss, ord FROM (SELECT *, first(pt) OVER (PARTITION BY doc_id ORDER BY ord) AS f FROM cl WHERE pt IS NOT NULL) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)), g AS (SELECT doc_id, count(*) FILTER (pt = hi) AS t, count(*) FILTER (ord < coalesce(miss, 1000000)) AS f FROM p GROUP BY 1) SELECT doc_id, n >= 5 AND t / n > 0.3 AND t >= 3 AS tail, n >= 5 AND f / n > 0.3 AND f >= 3 AS front FROM g JOIN n USING (doc_id)")
def _win16(spark, d):
    at = F.when(F.col("ord") % 5 == 4, None).when(F.col("doc_id") % 2 == 0, F.least(F.col("page"), F.lit(4))).otherwise(F.greatest(F.col("page"), F.lit(7)))
    return collapse(toc_items(spark, d).withColumn("at", at), "at")


@query("win17_thirds", f"WITH {TOC}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, page % 4 = 0 AS a FROM ti) SELECT doc_id, bool_or(a AND i < greatest(1, n // 3)) AS front, bool_or(a AND i >= greatest(1, n // 3) AND i < greatest(2, 2 * n // 3)) AS middle, bool_or(a AND i >= greatest(2, 2 * n // 3)) AS back FROM k GROUP BY 1")
def _win17(spark, d):
    return anchor_thirds(toc_items(spark, d), F.col("page") % 4 == 0)


@query("win11_prefix", f"WITH {PAGES}, k AS (SELECT doc_id, page, contains(text, 'e') AND length(text) % 3 > 0 AS m FROM pg), s AS (SELECT *, min(page) FILTER (m) OVER (PARTITION BY doc_id) AS a FROM k), t AS (SELECT *, min(page) FILTER (NOT m AND page > a) OVER (PARTITION BY doc_id) AS b FROM s) SELECT doc_id, page FROM t WHERE m AND page < coalesce(b, 1000000000)")
def _win11(spark, d):
    return matching_prefix(page_text(spark, d), F.contains(F.col("text"), F.lit("e")) & (F.char_length("text") % 3 > 0)).select("doc_id", "page")


@query(
    "win20_pack",
    f"""WITH RECURSIVE {PAGES}, x AS (SELECT doc_id, page, length(text) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM pg),
f AS (SELECT doc_id, i, page, s AS used, 0 AS g FROM x WHERE i = 1
  UNION ALL SELECT x.doc_id, x.i, x.page, CASE WHEN f.used + x.s > 1500 THEN x.s ELSE f.used + x.s END, CASE WHEN f.used + x.s > 1500 THEN f.g + 1 ELSE f.g END
  FROM f JOIN x ON x.doc_id = f.doc_id AND x.i = f.i + 1)
SELECT doc_id, page, g AS "group" FROM f""",
)
def _win20(spark, d):
    return pack(page_text(spark, d).withColumn("tokens", F.char_length("text")), "tokens", 1500, order="page")


@query("int09_physical", f"WITH {TOC}, k AS (SELECT doc_id, ord, page, CASE WHEN ord % 2 = 0 THEN page + ord % 5 END AS pt FROM ti), o AS (SELECT doc_id, (list_sort(list(pt - page)))[len(list(pt - page)) // 2 + 1] AS off FROM k WHERE pt IS NOT NULL GROUP BY 1) SELECT doc_id, ord, page + coalesce(off, 0) AS physical FROM k LEFT JOIN o USING (doc_id)")
def _int09(spark, d):
    k = toc_items(spark, d).withColumn("at", F.when(F.col("ord") % 2 == 0, F.col("page") + F.col("ord") % 5))
    return printed_to_physical(k, "page", "at").select("doc_id", "ord", "physical")


@query("toc04_plausible", f"WITH {TOC}, {_N}, k AS (SELECT doc_id, last_page, ord, CASE WHEN doc_id % 2 = 0 THEN ord + 1 ELSE page END AS p FROM ti JOIN ln USING (doc_id)) SELECT doc_id, count(*) >= 3 AND max(p) <= max(last_page) AND NOT (count(DISTINCT p) = count(*) AND max(p) <= greatest(4, count(*))) AS plausible FROM k GROUP BY 1")
def _toc04(spark, d):
    k = spans(spark, d).withColumn("p", F.when(F.col("doc_id") % 2 == 0, F.col("ord") + 1).otherwise(F.col("page")))
    return printed_plausible(k, "last_page", "p")


_MAPPED = "mp AS (SELECT doc_id, ord, CASE WHEN ord % 4 < 3 THEN page END AS page, CASE WHEN ord % 4 = 3 THEN 'none' WHEN (ord + doc_id) % 3 = 0 THEN 'estimated' ELSE 'title_search' END AS source FROM ti)"


@query("map08_score", f"WITH {TOC}, {_MAPPED}, g AS (SELECT doc_id, avg((source = 'title_search')::INT) AS m, avg((source = 'estimated')::INT) AS e, avg((page IS NOT NULL)::INT) AS p FROM mp GROUP BY 1) SELECT doc_id, round(CASE WHEN m >= 0.55 THEN 0.7 * m + 0.15 * (1 - e) + 0.15 * p ELSE least(0.49, 0.7 * m + 0.15 * (1 - e) + 0.15 * p) END, 4) AS score, m >= 0.55 AS passed FROM g")
def _map08(spark, d):
    t = toc_items(spark, d).withColumn("page", F.expr("case when ord % 4 < 3 then page end"))
    return mapping_score(t.withColumn("source", F.expr("case when ord % 4 = 3 then 'none' when (ord + doc_id) % 3 = 0 then 'estimated' else 'title_search' end")))


@query("qlt10_candidates", "SELECT p_partkey, round(0.55 * (p_size / 50) + 0.25 * ((p_partkey % 7) / 7) + 0.1 * ((p_partkey % 3) / 3) + 0.1 * ((p_partkey % 5) / 5), 6) AS score FROM part")
def _qlt10(spark, d):
    from ..sources.tables import load

    k = lambda m: F.col("p_partkey") % m / m
    return load(spark, d, "part").select("p_partkey", F.round(candidate_score(F.col("p_size") / 50, k(7), k(3), k(5)), 6).alias("score"))


@query("int07_leakage", f"WITH {_SPAN} SELECT doc_id, ord FROM nd WHERE last_page >= 2 AND start_page <= 3 AND start_page <= last_page AND end_page >= 2")
def _int07(spark, d):
    return toc_leakage(spans(spark, d), page_text(spark, d).where("page in (2, 3)")).select("doc_id", "ord")


@query("int08_failures", f"WITH {_SPAN}, k AS (SELECT doc_id, last_page, CASE WHEN ord % 7 = 6 THEN NULL ELSE start_page - ord % 2 * 5 END AS a, end_page + ord % 3 - 3 AS b FROM nd) SELECT doc_id, count(*) FILTER (a IS NULL OR b IS NULL) AS missing, count(*) FILTER (b < a) AS inverted, count(*) FILTER (a < 1 OR b > last_page) AS outside FROM k GROUP BY 1")
def _int08(spark, d):
    n = spans(spark, d).withColumn("start_page", F.expr("case when ord % 7 = 6 then null else start_page - ord % 2 * 5 end")).withColumn("end_page", F.expr("end_page + ord % 3 - 3"))
    return range_failures(n, "last_page")


_ROOTS = "x AS (SELECT * FROM ti WHERE doc_id % 3 = 0 OR (level <> 2) = (doc_id % 3 = 1)), rt AS (SELECT *, NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS root FROM x a)"


@query("qlt11_style", f"WITH {TOC}, {_ROOTS}, g AS (SELECT doc_id, sum(root::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM rt), n AS (SELECT doc_id, r, count(*) AS n FROM g GROUP BY 1, 2), k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (n > 1) AS c FROM n GROUP BY 1) SELECT doc_id, CASE WHEN c = 0 AND n = 1 THEN 'collapsed' WHEN c = 0 THEN 'flat' WHEN c = n THEN 'hierarchical' ELSE 'mixed' END AS style FROM k")
def _qlt11(spark, d):
    return tree_style(toc_items(spark, d).where("doc_id % 3 = 0 or (level <> 2) = (doc_id % 3 = 1)"))


@query("agg17_structure", rf"""WITH {TOC}, k AS (SELECT doc_id, level, trim(title) AS t FROM ti), g AS (SELECT doc_id, count(*) AS n, avg((regexp_full_match(t, '[0-9\s.+±-]*') OR length(t) NOT BETWEEN 2 AND 120)::INT) AS b, avg((length(t) <= 4)::INT) AS s, count(DISTINCT nullif(t, '')) / count(*) AS u, max(level) AS depth FROM k GROUP BY 1) SELECT doc_id, round(b, 4) AS bad_ratio, round(s, 4) AS short_ratio, round(u, 4) AS unique_ratio, depth, round(greatest(0, least(1, 1 - b - CASE WHEN n <= 1 THEN 0.35 ELSE 0 END - CASE WHEN depth <= 1 AND n >= 6 THEN 0.15 ELSE 0 END - CASE WHEN s > 0.4 AND n >= 4 THEN 0.12 ELSE 0 END - CASE WHEN u < 0.6 AND n >= 5 THEN 0.1 ELSE 0 END)), 4) AS score FROM g""")
def _agg17(spark, d):
    return structure_quality(toc_items(spark, d))


@query("add02_shallow", f"WITH {TOC}, {_N}, k AS (SELECT doc_id, ord, last_page, page * (1 + doc_id % 3) AS p FROM ti JOIN ln USING (doc_id)), q AS (SELECT *, lead(p) OVER (PARTITION BY doc_id ORDER BY ord) - p AS g FROM k) SELECT doc_id, count(*) >= 2 AND count(*) <= greatest(8, max(last_page) / 6) AND coalesce(min(g), 0) >= 0 AND coalesce(max(g), 0) >= 6 AS shallow FROM q GROUP BY 1")
def _add02(spark, d):
    return shallow(spans(spark, d).withColumn("p", F.expr("page * (1 + doc_id % 3)")), "last_page", page="p")


@query("set08_echo", f"WITH {TOC}, x AS (SELECT doc_id, ord, level, CASE WHEN ord % 4 < 2 THEN 'same' ELSE title END AS title FROM ti), p AS (SELECT *, (SELECT max(b.ord) FROM x b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS po FROM x a) SELECT a.doc_id, a.ord FROM p a LEFT JOIN x b ON b.doc_id = a.doc_id AND b.ord = a.po WHERE b.title IS NULL OR lower(trim(b.title)) <> lower(trim(a.title))")
def _set08(spark, d):
    x = toc_items(spark, d).withColumn("title", F.expr("case when ord % 4 < 2 then 'same' else title end"))
    return drop_parent_echo(x).select("doc_id", "ord")


@query("set11_uncovered", f"WITH {_SPAN} SELECT doc_id, page FROM pg WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.doc_id = pg.doc_id AND nd.ord % 2 = 0 AND pg.page BETWEEN nd.start_page AND nd.end_page)")
def _set11(spark, d):
    return uncovered(spans(spark, d).where("ord % 2 = 0 and end_page >= start_page"), page_text(spark, d))


@query("cls02_content", f"WITH {PAGES}, g AS (SELECT doc_id, avg((page % (doc_id % 4 + 1) = 0)::INT) AS c, avg((page % 11 = 3)::INT) AS g FROM pg GROUP BY 1) SELECT doc_id, CASE WHEN 1 - c >= 0.9 OR g >= 0.5 OR c <= 0.05 THEN 'ocr' WHEN c >= 0.95 AND g = 0 AND 1 - c <= 0.05 THEN 'text' ELSE CASE WHEN 1 - c > 0 OR g > 0 THEN 'hybrid' ELSE 'text' END END AS kind FROM g")
def _cls02(spark, d):
    g = page_text(spark, d).groupBy("doc_id").agg(F.avg(F.expr("cast(page % (doc_id % 4 + 1) = 0 as int)")).alias("c"), F.avg(F.expr("cast(page % 11 = 3 as int)")).alias("g"))
    return g.select("doc_id", content_type(F.col("c"), 1 - F.col("c"), 1 - F.col("c"), F.col("g"), F.lit("reliable"), F.lit(True)).alias("kind"))
