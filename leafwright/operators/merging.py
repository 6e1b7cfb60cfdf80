"""Merging and matching within a document: repeats, assignments, catalogs, anchors, prior evidence and requirements."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import PAGES, TOC, page_text, toc_items
from ..sources.tables import load
from .citations import labels
from .hierarchy import parents_by_level
from .outlines import _SPAN, catalog_kind, spans
from .text import match_form


def drop_adjacent(items: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """SET06: without items like the last one kept: titles alike in 20 characters, pages at most one apart.

    What was kept last depends on what was dropped, so a document's items are gone through
    in order, in one group of Arrow rows. A null title or page is like nothing.
    """
    d = items.select(doc, F.col(order).cast("int").alias(order), F.substring("title", 1, 20).alias("__t"), F.col("page").cast("int").alias("__p"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(order, "ascending"), ("__t", "ascending"), ("__p", "ascending")])
        kept, last = [], (None, None)
        for i, now in enumerate(zip(rows["__t"].to_pylist(), rows["__p"].to_pylist(), strict=True)):
            if None in now or now[0] != last[0] or last[1] is None or abs(now[1] - last[1]) > 1:
                kept.append(i)
                last = now
        return rows.take(pa.array(kept, pa.int64())).select([doc, order])

    return d.groupBy(doc).applyInArrow(run, d.select(doc, order).schema)


def assign_in_order(agenda: DataFrame, slides: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JON22: each agenda title takes the first slide of that title no earlier one took: the n-th the n-th."""
    a = agenda.withColumn("__k", match_form(F.col("title"))).withColumn("__i", F.row_number().over(W.partitionBy(doc, "__k").orderBy("ord")))
    s = slides.select(doc, "slide", match_form(F.col("title")).alias("__k")).withColumn("__i", F.row_number().over(W.partitionBy(doc, "__k").orderBy("slide")))
    return a.join(s, [doc, "__k", "__i"], "left").drop("__k", "__i")


def group_catalogs(items: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """TRE15: items under a root for each kind of catalog, if a document has more than one kind."""
    d = items.withColumn("kind", catalog_kind(F.col("title"))).withColumn("__k", F.size(F.collect_set("kind").over(W.partitionBy(doc))))
    root = F.when(F.col("kind") == "figure", "图目录").when(F.col("kind") == "table", "表目录").otherwise("目录")
    return d.withColumn("root", F.when(F.col("__k") > 1, root)).drop("__k")


def top_bounded_ends(items: DataFrame, upper: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """WIN05: an item ends on the page before the next, or on the next's where that is known not to start at the top."""
    w = W.partitionBy(doc).orderBy(order)
    nxt, top = F.lead("page").over(w), F.lead("near_page_top").over(w)
    end = F.when(nxt.isNull(), F.col(upper)).otherwise(F.least(F.when(F.coalesce(~top, F.lit(False)), nxt).otherwise(nxt - 1), F.col(upper)))
    return items.withColumn("end_page", F.greatest("page", end))


def sibling_ordinals(items: DataFrame, doc: str = "doc_id", order: str = "ord", parent: str = "parent_ord") -> DataFrame:
    """WIN22: places among an item's siblings, from 1."""
    return items.withColumn("ordinal", F.row_number().over(W.partitionBy(doc, parent).orderBy(order)))


def section_pages(nodes: DataFrame, doc: str = "doc_id", kind: str = "kind") -> DataFrame:
    """AGG15: distinct pages of each kind of section."""
    return nodes.select(doc, kind, F.explode(F.expr("sequence(start_page, end_page)")).alias("page")).groupBy(doc, kind).agg(F.countDistinct("page").alias("pages"))


def titles_kept(candidates: DataFrame, final: DataFrame, doc: str = "doc_id") -> DataFrame:
    """SET12: the share of a candidate's titles that are in the final outline."""
    f = final.select(doc, match_form(F.col("title")).alias("__k")).distinct().withColumn("__in", F.lit(1))
    c = candidates.withColumn("__k", match_form(F.col("title"))).join(f, [doc, "__k"], "left")
    return c.groupBy(doc).agg(F.round(F.avg(F.coalesce("__in", F.lit(0))), 4).alias("kept"))


def anchored_text(anchors: DataFrame, lines: DataFrame, doc: str = "doc_id", line: str = "page", most: int = 500) -> DataFrame:
    """INT06: the lines an anchor spans, ``most`` at the most, joined in order."""
    a = anchors.withColumn("__n", F.explode(F.expr(f"sequence(start_line, least(end_line, start_line + {most - 1}))")))
    j = a.join(lines.select(doc, F.col(line).alias("__n"), "text"), [doc, "__n"])
    return j.groupBy(doc, "anchor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "text"))), lambda x: x.text), "\n").alias("text"))


def citation_suffix(answer: Column, label: Column) -> Column:
    """SEA18: the first piece of evidence's label where an answer cites nothing."""
    return F.when((F.size(labels(answer)) > 0) | label.isNull(), "").otherwise(F.concat(F.lit(" [["), label, F.lit("]]")))


def page_entries(pages: DataFrame, nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """SEA10: each page with the titles of the nodes that start on it."""
    n = nodes.groupBy(doc, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x.title), " / ").alias("titles"))
    return pages.join(n, [doc, "page"], "left").withColumn("titles", F.coalesce("titles", F.lit("")))


def signature(tool: Column, arguments: Column) -> Column:
    """ADD09: a call's tool and its arguments (a map) in order of their names."""
    pairs = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat_ws("=", e.key, e.value))
    return F.concat(tool, F.lit("("), F.array_join(pairs, ","), F.lit(")"))


def prior_evidence(calls: DataFrame, prior: DataFrame) -> DataFrame:
    """ADD09: the first prior evidence of the same call."""
    p = prior.groupBy(signature(F.col("tool"), F.col("arguments")).alias("__s")).agg(F.min("evidence_id").alias("evidence_id"))
    return calls.withColumn("__s", signature(F.col("tool"), F.col("arguments"))).join(p, "__s", "left").drop("__s")


def markers(evidence: DataFrame, key: str, order: str, most: int = 8) -> DataFrame:
    """ADD08: distinct labels of precise sources that aren't on the web, in order, ``most`` at the most."""
    e = evidence.where(F.col("precise") & ~F.col("web")).groupBy(key, "label").agg(F.min(order).alias("__o"))
    e = e.withColumn("__i", F.row_number().over(W.partitionBy(key).orderBy("__o", "label"))).where(F.col("__i") <= most)
    return e.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "label"))), lambda x: x.label), ";").alias("markers"))


def fresh(evidence: DataFrame, docs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """FLT14: evidence of a document at its present version; that of the web for ``minutes``."""
    v = docs.select("doc_id", F.col("version").alias("__v"))
    j = evidence.join(v, "doc_id", "left")
    web = F.col("at") >= now - F.expr(f"interval {minutes} minutes")
    return j.where(F.when(F.col("doc_id").isNull(), web).otherwise(F.coalesce(F.col("version") == F.col("__v"), F.lit(False)))).drop("__v")


def reading_order(lines: DataFrame, page: list[str]) -> DataFrame:
    """ADD18: a page's lines from the top, those at one height from the left."""
    return lines.withColumn("place", F.row_number().over(W.partitionBy(*page).orderBy("y0", "x0")))


def required_nodes(nodes: DataFrame, wanted: DataFrame, slack: int = 1, doc: str = "doc_id") -> DataFrame:
    """ADD20: whether each node that must be there is, its range within ``slack`` pages."""
    n = nodes.select(F.col(doc).alias("__d"), F.col("title").alias("__t"), F.col("start_page").alias("__a"), F.col("end_page").alias("__b"))
    j = wanted.join(n, (F.col(doc) == F.col("__d")) & (F.col("title") == F.col("__t")), "left")
    near = (F.abs(F.col("__a") - F.col("start_index")) <= slack) & (F.abs(F.col("__b") - F.col("end_index")) <= slack)
    return j.groupBy(doc, "title", "start_index", "end_index").agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("met"))


def numeric_loss(raw: DataFrame, final: DataFrame, doc: str = "doc_id", least: int = 5) -> DataFrame:
    """QLT08: of five or more numbered items without a gap, more than 15 % missing from the final outline."""
    f = final.select(doc, "number").distinct().withColumn("__in", F.lit(1))
    g = raw.select(doc, "number").distinct().join(f, [doc, "number"], "left").groupBy(doc).agg(F.count(F.lit(1)).alias("n"), (F.max("number") - F.min("number") + 1).alias("span"), F.sum(F.coalesce("__in", F.lit(0))).alias("k"))
    return g.select(doc, ((F.col("n") >= least) & (F.col("span") == F.col("n")) & (1 - F.col("k") / F.col("n") > 0.15)).alias("lost"))


def compact_toc(nodes: DataFrame, most: int = 200) -> DataFrame:
    """PRJ09, PRJ20: outline rows with level, pages and the start of the summary."""
    pages = F.when(F.col("start_page") == F.col("end_page"), F.col("start_page").cast("string")).otherwise(F.concat_ws("-", F.col("start_page").cast("string"), F.col("end_page").cast("string")))
    return nodes.select("doc_id", "ord", "level", "title", pages.alias("pages"), F.substring("summary", 1, most).alias("summary"))


def canonical_node(nodes: DataFrame, last_page: str, doc: str = "doc_id") -> DataFrame:
    """PRJ06: ranges within the document, in order, and an id that depends on nothing but the node."""
    a = F.least(F.greatest(F.col("start_page"), F.lit(1)), F.col(last_page))
    b = F.least(F.greatest(F.col("end_page"), a), F.col(last_page))
    key = F.concat_ws("|", F.col(doc).cast("string"), F.col("title"), a.cast("string"), b.cast("string"))
    return nodes.select(doc, "ord", a.alias("first"), b.alias("last"), F.substring(F.sha1(key), 1, 16).alias("node_id"))


@query(
    "set06_adjacent",
    f"""WITH RECURSIVE {TOC}, x AS (SELECT doc_id, ord, CASE WHEN ord % 4 < 3 THEN 'same title' ELSE left(title, 20) END AS t, ord AS p, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM ti),
f AS (SELECT doc_id, i, ord, t, p, true AS kept FROM x WHERE i = 1
  UNION ALL SELECT x.doc_id, x.i, x.ord, CASE WHEN x.t = f.t AND abs(x.p - f.p) <= 1 THEN f.t ELSE x.t END, CASE WHEN x.t = f.t AND abs(x.p - f.p) <= 1 THEN f.p ELSE x.p END, NOT (x.t = f.t AND abs(x.p - f.p) <= 1)
  FROM f JOIN x ON x.doc_id = f.doc_id AND x.i = f.i + 1)
SELECT doc_id, ord FROM f WHERE kept""",
)
def _set06(spark, d):
    """Three titles of four alike, on pages one apart: the third is two apart from the one kept."""
    return drop_adjacent(toc_items(spark, d).withColumns({"title": F.expr("if(ord % 4 < 3, 'same title', title)"), "page": F.col("ord")}))


@query("jon22_assign", f"WITH {TOC}, a AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id, ord % 2 ORDER BY ord) AS i FROM ti), s AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page % 2 ORDER BY page) AS i FROM pg) SELECT a.doc_id, a.ord, s.page AS slide FROM a LEFT JOIN s ON s.doc_id = a.doc_id AND s.i = a.i AND s.page % 2 = a.ord % 2")
def _jon22_all(spark, d):
    name = lambda c: F.when(F.col(c) % 2 == 0, "Even ones").otherwise("Odd Ones!")
    s = page_text(spark, d).select("doc_id", F.col("page").alias("slide"), F.when(F.col("page") % 2 == 0, "even-ones").otherwise("odd ones").alias("title"))
    return assign_in_order(toc_items(spark, d).withColumn("title", name("ord")), s).select("doc_id", "ord", "slide")


@query("tre15_catalogs", f"WITH {TOC} SELECT doc_id, ord, CASE WHEN max(ord) OVER (PARTITION BY doc_id) > 0 THEN CASE ord % 3 WHEN 0 THEN '图目录' WHEN 1 THEN '表目录' ELSE '目录' END END AS root FROM ti")
def _tre15(spark, d):
    t = toc_items(spark, d).withColumn("title", F.expr("case ord % 3 when 0 then 'List of Figures' when 1 then 'list of tables' else 'x' end"))
    return group_catalogs(t).select("doc_id", "ord", "root")


@query("win05_ends", f"WITH {TOC}, k AS (SELECT doc_id, ord, page, 50 AS up, lead(page) OVER w AS n, lead(CASE WHEN ord % 3 = 0 THEN NULL ELSE ord % 3 = 1 END) OVER w AS top FROM ti WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, ord, CAST(greatest(page, CASE WHEN n IS NULL THEN up WHEN top = false THEN least(n, up) ELSE least(n - 1, up) END) AS INT) AS end_page FROM k")
def _win05(spark, d):
    t = toc_items(spark, d).withColumn("near_page_top", F.expr("if(ord % 3 = 0, null, ord % 3 = 1)")).withColumn("up", F.lit(50))
    return top_bounded_ends(t, "up").select("doc_id", "ord", "end_page")


@query("win22_siblings", f"WITH {TOC}, p AS (SELECT *, (SELECT max(b.ord) FROM ti b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS po FROM ti a) SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id, po ORDER BY ord) AS ordinal FROM p")
def _win22(spark, d):
    return sibling_ordinals(parents_by_level(toc_items(spark, d))).select("doc_id", "ord", "ordinal")


@query("agg15_sections", f"WITH {_SPAN} SELECT doc_id, level AS kind, count(DISTINCT p) AS pages FROM (SELECT doc_id, level, unnest(range(start_page, end_page + 1)) AS p FROM nd) GROUP BY 1, 2")
def _agg15(spark, d):
    return section_pages(spans(spark, d).where("end_page >= start_page").withColumn("kind", F.col("level")))


@query("set12_titles_kept", rf"WITH {TOC}, k AS (SELECT doc_id, ord, regexp_replace(lower(title), '[^0-9a-zA-Z\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS k FROM ti) SELECT doc_id, round(avg((EXISTS (SELECT 1 FROM k b WHERE b.doc_id = k.doc_id AND b.k = k.k AND b.ord % 3 > 0))::INT), 4) AS kept FROM k GROUP BY 1")
def _set12(spark, d):
    t = toc_items(spark, d)
    return titles_kept(t, t.where("ord % 3 > 0"))


@query("int06_anchors", f"WITH {TOC} SELECT ti.doc_id, ord AS anchor_id, string_agg(text, chr(10) ORDER BY pg.page) AS text FROM ti JOIN pg ON pg.doc_id = ti.doc_id AND pg.page BETWEEN ti.page AND ti.page + 1 GROUP BY 1, 2")
def _int06(spark, d):
    a = toc_items(spark, d).select("doc_id", F.col("ord").alias("anchor_id"), F.col("page").alias("start_line"), (F.col("page") + 5).alias("end_line"))
    return anchored_text(a, page_text(spark, d), most=2)


@query("sea18_suffix", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR turn % 5 = 0 THEN '' ELSE ' [[d p.' || turn || ']]' END AS suffix FROM conversations")
def _sea18(spark, d):
    said = F.expr("concat(replace(replace(text, '[', ''), ']', ''), if(turn % 3 = 0, ' [[x]]', ''))")
    return load(spark, d, "conversations").select("conv_id", "turn", citation_suffix(said, F.expr("if(turn % 5 = 0, null, concat('d p.', turn))")).alias("suffix"))


@query("sea10_entries", f"WITH {TOC} SELECT pg.doc_id, pg.page, coalesce(title, '') AS titles FROM pg LEFT JOIN ti ON ti.doc_id = pg.doc_id AND ti.page = pg.page")
def _sea10(spark, d):
    return page_entries(page_text(spark, d), toc_items(spark, d)).select("doc_id", "page", "titles")


@query("add09_prior", "SELECT o_orderkey, p.e AS evidence_id FROM orders LEFT JOIN (SELECT p_size, min(p_partkey) AS e FROM part GROUP BY 1) p ON p_size = o_orderkey % 60")
def _add09(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("evidence_id"), F.lit("read").alias("tool"), F.expr("map('b', 'x', 'a', cast(p_size as string))").alias("arguments"))
    c = load(spark, d, "orders").select("o_orderkey", F.lit("read").alias("tool"), F.expr("map('a', cast(o_orderkey % 60 as string), 'b', 'x')").alias("arguments"))
    return prior_evidence(c, p).select("o_orderkey", "evidence_id")


@query("add08_markers", "WITH e AS (SELECT o_custkey, 'L' || o_orderkey % 20 AS label, min(o_orderkey) AS o FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o, label) AS i FROM e) SELECT o_custkey, string_agg(label, ';' ORDER BY i) AS markers FROM r WHERE i <= 8 GROUP BY 1")
def _add08(spark, d):
    e = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr("concat('L', o_orderkey % 20)").alias("label"), F.expr("o_orderkey % 3 > 0").alias("precise"), F.expr("o_orderkey % 5 = 0").alias("web"))
    return markers(e, "o_custkey", "o_orderkey")


@query("flt14_fresh", "SELECT event_id FROM events LEFT JOIN supplier ON s_suppkey = event_id % 20 WHERE CASE WHEN event_id % 20 = 19 THEN ts >= TIMESTAMP '2024-01-15 00:00:00' ELSE s_suppkey IS NOT NULL AND event_id % 3 = s_suppkey % 3 END")
def _flt14(spark, d):
    e = load(spark, d, "events").select("event_id", F.expr("nullif(event_id % 20, 19)").alias("doc_id"), F.expr("event_id % 3").alias("version"), F.col("ts").alias("at"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.expr("s_suppkey % 3").alias("version"))
    return fresh(e, s, F.expr("timestamp_ntz '2024-01-15 00:15:00'")).select("event_id")


@query("add18_reading", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 2, -l_linenumber) AS place FROM lineitem")
def _add18(spark, d):
    k = load(spark, d, "lineitem").withColumn("y0", F.col("l_partkey") % 2).withColumn("x0", -F.col("l_linenumber"))
    return reading_order(k, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "place")


@query("add20_required", f"WITH {_SPAN}, w AS (SELECT doc_id, title, start_page + ord % 3 AS a, end_page AS b FROM nd WHERE ord < 6 UNION SELECT doc_id, 'no such', 1, 1 FROM nd) SELECT w.doc_id, w.title, a AS start_index, b AS end_index, coalesce(bool_or(abs(nd.start_page - a) <= 1 AND abs(nd.end_page - b) <= 1), false) AS met FROM w LEFT JOIN nd ON nd.doc_id = w.doc_id AND nd.title = w.title GROUP BY 1, 2, 3, 4")
def _add20(spark, d):
    n = spans(spark, d)
    w = n.where("ord < 6").select("doc_id", "title", F.expr("start_page + ord % 3").alias("start_index"), F.col("end_page").alias("end_index"))
    w = w.union(n.select("doc_id", F.lit("no such"), F.lit(1), F.lit(1))).distinct()
    return required_nodes(n, w)


@query("qlt08_labels", f"WITH {TOC}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (ord % (doc_id % 7 + 2) > 0) AS k FROM ti GROUP BY 1) SELECT doc_id, n >= 5 AND 1 - k / n > 0.15 AS lost FROM g")
def _qlt08(spark, d):
    t = toc_items(spark, d).withColumn("number", F.col("ord"))
    return numeric_loss(t, t.where("ord % (doc_id % 7 + 2) > 0"))


@query("prj09_compact", f"WITH {_SPAN} SELECT nd.doc_id, ord, level, title, CASE WHEN start_page = end_page THEN CAST(start_page AS VARCHAR) ELSE start_page || '-' || end_page END AS pages, text[1:200] AS summary FROM nd JOIN pg USING (doc_id, page)")
def _prj09(spark, d):
    return compact_toc(spans(spark, d).join(page_text(spark, d).withColumnRenamed("text", "summary"), ["doc_id", "page"]))


@query("prj06_nodes", f"WITH {_SPAN}, k AS (SELECT doc_id, ord, title, last_page, least(greatest(start_page - 2, 1), last_page) AS a, end_page + 3 - ord AS e FROM nd), b AS (SELECT *, least(greatest(e, a), last_page) AS b FROM k) SELECT doc_id, ord, a AS first, b AS last, substr(sha1(doc_id || '|' || title || '|' || a || '|' || b), 1, 16) AS node_id FROM b")
def _prj06(spark, d):
    n = spans(spark, d).withColumn("start_page", F.col("start_page") - 2).withColumn("end_page", F.expr("end_page + 3 - ord"))
    return canonical_node(n, "last_page")
