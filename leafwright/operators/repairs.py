"""Page ranges of whole trees, and repairs of outlines: roots promoted or moved, titles made, leaves thinned, chapters rebuilt.

Nodes are rows in pre-order with levels. Rules that look at neighbours only are windows;
those that recurse, or whose outcome feeds the next node, take a document's nodes as one
group.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import PAGES, TOC, page_text, toc_items

# Titles of roots that only hold the outline, of chapters without a name, and of cases that go on.
ROOTS = ("目录", "Contents", "Table of Contents")
BARE_CHAPTER = re.compile(r"第[一二三四五六七八九十]+章\s*Chapter\s*\d+", re.I)
CONTINUED = re.compile(r"[一-龥A-Za-z]+AI[:：]")
CASES = ("突破奖", "案例", "应用")


def tree(rows: list[dict]) -> list[dict]:
    """Rows in pre-order as nodes with ``kids``: each belongs to the last one before it of a lesser level."""
    roots, open_ = [], []
    for r in rows:
        node = {**r, "kids": []}
        while open_ and open_[-1]["level"] >= r["level"]:
            open_.pop()
        (open_[-1]["kids"] if open_ else roots).append(node)
        open_.append(node)
    return roots


def flat(nodes: list[dict], level: int = 1) -> Iterator[dict]:
    """The nodes in pre-order, with their depths as levels."""
    for n in nodes:
        yield {**{k: v for k, v in n.items() if k != "kids"}, "level": level}
        yield from flat(n["kids"], level + 1)


def _known(page) -> int:
    return int(page) if page is not None and page == page and page > 0 else 0


def normalise_ranges(nodes: list[dict], last: int, lower: int = 1, upper: int | None = None) -> list[dict]:
    """INT01: starts and ends of siblings inside their parent's, each ending before the next one begins.

    An end on the very page where the next begins stays, as both share it. Catalogs
    (``aux``) are outside this order: they keep their own range within the parent's.
    """
    upper = max(lower, last if upper is None else upper)
    inside = lambda p: max(lower, min(p, upper))
    for n in nodes:
        n["start"] = inside(_known(n["start"]) or lower)
        n["end"] = max(n["start"], inside(_known(n["end"]) or (n["start"] if n["aux"] else upper)))
    body = [n for n in nodes if not n["aux"]]
    for n, after in zip(body, [*body[1:], None], strict=False):
        if after is None:
            n["end"] = max(n["start"], upper)
        elif after["start"] != n["end"]:
            n["end"] = max(n["start"], min(after["start"] - 1, upper))
    for n in nodes:
        normalise_ranges(n["kids"], last, n["start"], n["end"])
    return nodes


def derive_ranges(nodes: list[dict], last: int, lower: int = 1, upper: int | None = None) -> list[dict]:
    """INT02: inclusive ranges from starts alone, level by level; catalogs' items are points.

    A node ends before the next sibling's page if that begins at its top, else on it.
    """
    upper = max(lower, last if upper is None else upper)
    for n in nodes:
        n["start"] = max(lower, min(_known(n["start"]) or lower, upper))
    for n, after in zip(nodes, [*nodes[1:], None], strict=False):
        if n["aux"]:
            n["end"] = n["start"]
        elif after is None:
            n["end"] = max(n["start"], upper)
        else:
            n["end"] = max(n["start"], min(upper, after["start"] - bool(after["top"])))
        derive_ranges(n["kids"], last, n["start"], n["end"])
    return nodes


def move_continued(nodes: list[dict]) -> list[dict]:
    """TRE13: roots that go on with a case are put, with their children, under the case's chapter, which is widened."""
    out: list[dict] = []
    for n in nodes:
        before = out[-1] if out else None
        if before and CONTINUED.match(n["title"].strip()) and any(k in before["title"] for k in CASES):
            before["kids"] += [{**n, "kids": []}, *n["kids"]]
            before["end"] = max(before["end"], n["end"])
        else:
            out.append(n)
    return out


def name_chapters(nodes: list[dict]) -> list[dict]:
    """TRE13: chapters with a bare number get the topics of their first two children, or the first child's title."""
    for n in nodes:
        name_chapters(n["kids"])
        if BARE_CHAPTER.fullmatch(n["title"].strip()) and n["kids"]:
            topics = [m[1].strip() for k in n["kids"] if (m := re.match(r"([^:：]{2,12})[:：]", k["title"].strip()))]
            n["title"] = "与".join(topics[:2]) if len(topics) >= 2 else n["kids"][0]["title"].strip()
    return nodes


def thin(rows: list[dict], least: int, tokens: Callable[[str], int] = lambda t: max(1, int(len(t) * 0.7))) -> list[dict]:
    """TRE14: nodes below ``least`` tokens take in the texts of all below them, the last nodes first."""
    rows, gone = [dict(r) for r in rows], set()
    for i in range(len(rows) - 1, -1, -1):
        n = rows[i]
        if i in gone or tokens(n["text"]) >= least:
            continue
        end = next((k for k in range(i + 1, len(rows)) if rows[k]["level"] <= n["level"]), len(rows))
        below = [k for k in range(i + 1, end) if k not in gone]
        for k in below:
            if rows[k]["text"].strip():
                n["text"] += ("\n\n" if n["text"] and not n["text"].endswith("\n") else "") + rows[k]["text"]
        gone.update(below)
    return [r for i, r in enumerate(rows) if i not in gone]


def promote_root(nodes: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """TRE11: a lone root that is called contents and spans the document gives way to its children, if these are in order.

    It needs two children at least, all with a start, and covers the pages from the second
    to the last but one.
    """
    last = pages.groupBy(doc).agg(F.max("page").alias("__last"))
    kids = nodes.where("level = 2").withColumn("__back", F.coalesce((F.col("start") < F.lag("start").over(W.partitionBy(doc).orderBy("ord"))).cast("int"), F.lit(0)))
    kids = kids.groupBy(doc).agg(F.count(F.lit(1)).alias("__kids"), F.count("start").alias("__known"), F.max("__back").alias("__back"))
    root = nodes.where("level = 1").groupBy(doc).agg(F.count(F.lit(1)).alias("__roots"), F.first("title").alias("__title"), F.first("start").alias("__s"), F.first("end").alias("__e"))
    d = nodes.join(root, doc).join(kids, doc, "left").join(last, doc)
    wraps = (F.col("__roots") == 1) & F.trim("__title").isin(*ROOTS) & (F.col("__kids") >= 2) & (F.col("__known") == F.col("__kids")) & (F.col("__back") == 0)
    wraps = F.coalesce(wraps & (F.col("__s") <= 2) & (F.col("__e") >= F.greatest(F.lit(1), F.col("__last") - 1)), F.lit(False))
    return d.withColumn("__w", wraps).where(~F.col("__w") | (F.col("level") > 1)).withColumn("level", F.col("level") - F.col("__w").cast("int")).select(*nodes.columns)


def by_dividers(items: DataFrame, dividers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """TRE17: an outline rebuilt under divider pages: each item in the last chapter that begins at or before its page.

    Chapters are numbered in order of their pages and items within them; those before the
    first divider are in a chapter 0 without a row of its own.
    """
    both = items.select(doc, "page", F.lit(1).alias("kind"), F.col("ord").alias("o"), "title").unionByName(dividers.select(doc, "page", F.lit(0).alias("kind"), F.lit(0).alias("o"), "title"))
    w = W.partitionBy(doc).orderBy("page", "kind", "o")
    d = both.withColumn("chapter", F.sum((F.col("kind") == 0).cast("int")).over(w))
    d = d.withColumn("i", F.sum("kind").over(W.partitionBy(doc, "chapter").orderBy("page", "kind", "o")))
    number = F.when(F.col("kind") == 0, F.col("chapter").cast("string")).otherwise(F.concat_ws(".", F.col("chapter").cast("string"), F.col("i").cast("string")))
    return d.select(doc, number.alias("structure"), "title", "page")


def merge_framework(chapters: DataFrame, children: DataFrame, doc: str = "doc_id") -> DataFrame:
    """TRE18: chapters with the children found for each, numbered; children on no page of their chapter are left out."""
    c = chapters.withColumn("k", F.row_number().over(W.partitionBy(doc).orderBy("start", "ord")))
    kids = children.select(F.col(doc).alias("__d"), F.col("chapter").alias("__c"), F.col("ord").alias("__o"), F.col("title").alias("t"), F.col("page").alias("p"))
    j = c.join(kids, (F.col(doc) == F.col("__d")) & (F.col("ord") == F.col("__c")) & F.col("p").between(F.col("start"), F.col("end")))
    i = F.row_number().over(W.partitionBy(doc, "k").orderBy("p", "__o"))
    below = j.select(doc, F.concat_ws(".", F.col("k").cast("string"), i.cast("string")).alias("structure"), F.col("t").alias("title"), F.col("p").alias("page"))
    return c.select(doc, F.col("k").cast("string").alias("structure"), "title", F.col("start").alias("page")).unionByName(below)


_NODE = "ord int, level int, title string, start int, end int"


def rebuilt(nodes: DataFrame, rule: Callable[[list[dict], int], list[dict]], doc: str = "doc_id") -> DataFrame:
    """``rule(nodes as a tree, last page)`` on each document's nodes (ord, level, title, start, end, aux, top, last)."""
    names = [doc, *(c.split()[0] for c in _NODE.split(", "))]

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        rows = f.sort_values("ord").to_dict("records")
        out = [(key[0], *(n[c] for c in names[1:])) for n in flat(rule(tree(rows), int(rows[0]["last"])))]
        return pd.DataFrame(out, columns=names)

    return nodes.groupBy(doc).applyInPandas(run, f"{doc} long, {_NODE}")


def _nodes(spark, d) -> DataFrame:
    last = page_text(spark, d).groupBy("doc_id").agg(F.max("page").alias("last"))
    t = toc_items(spark, d).join(last, "doc_id")
    return t.selectExpr("doc_id", "ord", "level", "title", "if(ord % 7 = 5, null, page) as start", "if(ord % 4 = 1, page + 3, null) as end", "ord % 5 = 4 as aux", "ord % 2 = 0 as top", "last")


@query("int01_siblings")
def _int01(spark, d):
    return rebuilt(_nodes(spark, d), normalise_ranges)


@query("int02_derived")
def _int02(spark, d):
    return rebuilt(_nodes(spark, d), derive_ranges)


@query("int02_one_level", f"WITH {TOC}, l AS (SELECT doc_id, max(page) AS last FROM pg GROUP BY 1), n AS (SELECT doc_id, ord, title, page AS s, ord % 2 = 0 AS top, lead(page) OVER w AS nx, lead(ord % 2 = 0) OVER w AS nt, last FROM ti JOIN l USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, ord, 1 AS level, title, s AS start, CASE WHEN nx IS NULL THEN greatest(s, last) ELSE greatest(s, least(last, nx - nt::INT)) END AS \"end\" FROM n")
def _int02_one(spark, d):
    return rebuilt(_nodes(spark, d).selectExpr("doc_id", "ord", "1 as level", "title", "cast(ord * 3 + 1 as int) as start", "end", "false as aux", "top", "last"), derive_ranges)


@query("tre13_continued")
def _tre13(spark, d):
    title = F.expr("case ord % 3 when 1 then concat('应用', title) when 2 then concat('xAI: ', title) else title end")
    return rebuilt(_nodes(spark, d).withColumn("title", title).withColumn("start", F.coalesce("start", F.lit(1))).withColumn("end", F.coalesce("end", "start")), lambda ns, last: name_chapters(move_continued(ns)))


@query("tre14_thinned")
def _tre14(spark, d):
    t = toc_items(spark, d).join(page_text(spark, d), ["doc_id", "page"]).select("doc_id", "ord", "level", F.coalesce("text", F.lit("")).alias("text"))

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], n["ord"], n["level"], n["text"]) for n in thin(f.sort_values("ord").to_dict("records"), 60)], columns=["doc_id", "ord", "level", "text"])

    return t.groupBy("doc_id").applyInPandas(run, "doc_id long, ord int, level int, text string")


_ROOT = "n AS (SELECT doc_id, ord, CASE WHEN ord = 0 THEN 1 ELSE 2 + ord % 2 END AS level, CASE WHEN ord = 0 AND doc_id % 3 > 0 THEN 'Contents' ELSE title END AS title, CASE WHEN doc_id % 5 = 1 AND ord = 3 THEN NULL ELSE page END AS start, page + 100 - 100 * (doc_id % 7 = 2)::INT AS \"end\" FROM ti)"


@query("tre11_promoted", f"WITH {TOC}, {_ROOT}, l AS (SELECT doc_id, max(page) AS last FROM pg GROUP BY 1), b AS (SELECT doc_id, start, coalesce((start < lag(start) OVER (PARTITION BY doc_id ORDER BY ord))::INT, 0) AS b FROM n WHERE level = 2), k AS (SELECT doc_id, count(*) AS kids, count(start) AS known, max(b) AS back FROM b GROUP BY 1), r AS (SELECT doc_id, title AS t, start AS s, \"end\" AS e FROM n WHERE level = 1), w AS (SELECT n.*, coalesce(t = 'Contents' AND kids >= 2 AND known = kids AND back = 0 AND s <= 2 AND e >= greatest(1, last - 1), false) AS w FROM n JOIN r USING (doc_id) LEFT JOIN k USING (doc_id) JOIN l USING (doc_id)) SELECT doc_id, ord, level - w::INT AS level, title, start, \"end\" FROM w WHERE NOT w OR level > 1")
def _tre11(spark, d):
    n = toc_items(spark, d).selectExpr("doc_id", "ord", "if(ord = 0, 1, 2 + ord % 2) as level", "if(ord = 0 and doc_id % 3 > 0, 'Contents', title) as title", "if(doc_id % 5 = 1 and ord = 3, null, page) as start", "page + 100 - if(doc_id % 7 = 2, 100, 0) as end")
    return promote_root(n, page_text(spark, d))


@query("tre17_dividers", f"WITH {TOC}, b AS (SELECT doc_id, page, 1 AS kind, ord AS o, title FROM ti UNION ALL SELECT doc_id, page, 0, 0, 'Part' FROM pg WHERE page % 4 = 3), c AS (SELECT *, sum((kind = 0)::INT) OVER (PARTITION BY doc_id ORDER BY page, kind, o) AS chapter FROM b), i AS (SELECT *, sum(kind) OVER (PARTITION BY doc_id, chapter ORDER BY page, kind, o) AS i FROM c) SELECT doc_id, CASE WHEN kind = 0 THEN CAST(chapter AS VARCHAR) ELSE chapter || '.' || i END AS structure, title, page FROM i")
def _tre17(spark, d):
    marks = page_text(spark, d).where("page % 4 = 3").select("doc_id", "page", F.lit("Part").alias("title"))
    return by_dividers(toc_items(spark, d), marks)


@query("tre18_framework", f"WITH {TOC}, c AS (SELECT doc_id, ord, title, page AS s, page + 5 AS e, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS k FROM ti WHERE ord % 3 = 0), j AS (SELECT c.doc_id, k, t.title, t.page, row_number() OVER (PARTITION BY c.doc_id, k ORDER BY t.page, t.ord) AS i FROM c JOIN ti t ON t.doc_id = c.doc_id AND t.ord % 3 > 0 AND t.ord // 3 * 3 = c.ord AND t.page BETWEEN s AND e) SELECT doc_id, CAST(k AS VARCHAR) AS structure, title, s AS page FROM c UNION ALL SELECT doc_id, k || '.' || i, title, page FROM j")
def _tre18(spark, d):
    t = toc_items(spark, d)
    c = t.where("ord % 3 = 0").selectExpr("doc_id", "ord", "title", "page as start", "page + 5 as end")
    return merge_framework(c, t.where("ord % 3 > 0").selectExpr("doc_id", "ord", "cast(ord div 3 * 3 as int) as chapter", "title", "page"))
