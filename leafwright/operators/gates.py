"""Gates and routes: page signals and roles, document kinds, acceptance of outlines, attempts and their choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import FILES, PAGES, TOC, files, page_text, toc_items
from ..sources.tables import load
from .details import one_line

# Lines that a chart's axes and legends leave, and what figures, tables and sections are called.
CHART_LINE = r"^(\d{1,4}(\.\d+)?(\s+\d{1,4}(\.\d+)?)?|[a-z])$|^\([a-z]\)\s+\S.{1,40}$|\b(query time|recall|precision|latency|throughput)\b"
FOOTER = r"(?i)^(copyright|all rights reserved|www\.|page \d+)"
NUMBERED = r"^\s*\d{1,2}(\.\d{1,2})*[.)、\s]\s*\S"
NUMBER_AT_END = r"[.…·\s]\d{1,4}\s*$"
FIGURE_LINE, TABLE_LINE = r"(?i)^\s*(figure|fig\.|图)\s*\d", r"(?i)^\s*(table|表)\s*\d"
FIGURES, TABLES = "list of figures|图目录", "list of tables|表目录"
CONTENTS, AGENDA = "table of contents|contents|目录", "agenda|outline|议程"
TRUSTED = ("bookmarks", "links")


def lines_of(text: Column) -> Column:
    """A page's lines, each on one line of its own, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one_line), lambda x: x != "")


def counted(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def share(lines: Column, test) -> Column:
    return counted(lines, test) / F.greatest(F.size(lines), F.lit(1))


def meaningful_ratio(text: Column) -> Column:
    """CLS05: the share of characters in lines that say something: no addresses, numbers, footers or short plain ones."""
    ls = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.char_length(x) >= 3)
    say = F.filter(ls, lambda x: ~x.rlike(r"^https?://|^\d+$") & ~x.rlike(FOOTER) & ~((F.char_length(x) < 20) & x.rlike(r"^[\x00-\x7f]*$")))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.char_length(x))
    enough = (F.char_length(text) >= 10) & (total(ls) > 0)
    return F.when(enough, F.round(total(say) / total(ls), 6)).otherwise(0.0)


def body_signal(text: Column) -> Column:
    """CLS09: how much a page looks like running text, 0 to 0.36."""
    ls = lines_of(text)
    long = F.when(counted(ls, lambda x: F.char_length(x) >= 90) >= 2, 0.16).otherwise(0.0)
    prose = F.when(share(ls, lambda x: (F.char_length(x) >= 45) & ~x.rlike(NUMBER_AT_END)) >= 0.35, 0.14).otherwise(0.0)
    shown = F.when(F.exists(ls, lambda x: F.lower(x).rlike("<img|^<div")), 0.04).otherwise(0.0)
    return F.round(F.least(F.lit(0.36), long + prose + shown), 4)


def chart_signal(text: Column) -> Column:
    """CLS09: how much a page looks like a chart, 0 to 0.6: 0 below twelve lines or 45 % of axis and legend lines."""
    ls = lines_of(text)
    s = share(ls, lambda x: F.lower(x).rlike(CHART_LINE) | x.rlike(r"^[A-Z][A-Z0-9-]{1,8}(\s+[A-Z][A-Z0-9-]{1,8}){0,2}$"))
    return F.when((F.size(ls) >= 12) & (s >= 0.45), F.round(F.least(F.lit(0.6), s), 6)).otherwise(0.0)


def page_role(text: Column) -> tuple[Column, Column]:
    """CLS10: (role, confidence) of a page: catalogs of figures and tables, contents with and without pages, agenda, section marker, content."""
    ls = lines_of(text)
    low = F.lower(F.array_join(ls, "\n"))
    numbered = counted(ls, lambda x: x.rlike(NUMBERED))
    formal = low.rlike(CONTENTS)
    own = ~low.rlike("table of contents|(?m)^(contents|目录)$")
    figures = low.rlike(FIGURES) | (counted(ls, lambda x: x.rlike(FIGURE_LINE)) >= 3)
    tables = low.rlike(TABLES) | (counted(ls, lambda x: x.rlike(TABLE_LINE)) >= 3)
    sparse = (F.size(ls) <= 3) & (F.char_length(low) <= 60) & F.exists(ls, lambda x: x.rlike(r"(?i)^(part|chapter|section)\s*\d|^第.{1,4}[章节篇部]|^\d{1,2}$"))
    rules = [
        (figures & own, "aux_figure_catalog", 0.85),
        (tables & own, "aux_table_catalog", 0.85),
        (formal & (numbered >= 3) & F.exists(ls, lambda x: x.rlike(NUMBER_AT_END)), "formal_toc", 0.9),
        (formal & (numbered >= 3), "no_page_toc", 0.78),
        (low.rlike(AGENDA) & (numbered >= 2), "agenda_outline", 0.76),
        (sparse, "section_marker", 0.72),
    ]
    role, sure = F.lit("content"), F.lit(0.0)
    for when, r, c in reversed(rules):
        role, sure = F.when(when, r).otherwise(role), F.when(when, c).otherwise(sure)
    return role, sure


def layout_contents(features: DataFrame, key: str, least: float = 0.5, most: int = 3) -> DataFrame:
    """CLS08: a document's contents pages by layout: up to ``most`` of the best scores that reach ``least``."""
    w = W.partitionBy(key).orderBy(F.col("toc_score").desc(), "page")
    return features.where(F.col("toc_score") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def document_kinds(pages: DataFrame, doc: str = "doc_id", least: int = 8) -> DataFrame:
    """CLS13: whether a document is like slides (agendas and numbered titles), or has one agenda that comes back.

    ``agenda`` and ``titled`` tell of each page what it is, ``items`` the agenda's entries.
    """
    d = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.length("text") > 0).cast("double")).alias("coverage"),
        F.count_if("agenda").alias("agendas"),
        F.count_if("titled").alias("titles"),
        F.min(F.when(F.col("agenda"), F.col("items"))).alias("common"),
    )
    slides = (F.col("n") >= least) & (F.col("coverage") >= 0.6) & (F.col("agendas") >= 2) & (F.col("titles") >= 5)
    agenda = (F.col("n") >= least) & (F.col("coverage") >= 0.8) & (F.col("agendas") >= 2) & F.col("common").between(3, 8) & (F.col("titles") >= F.col("common"))
    return d.select(doc, slides.alias("slide_like"), F.coalesce(agenda, F.lit(False)).alias("agenda_like"))


def route(embedded: Column, disabled: Column, has_page: Column, numbered: Column) -> tuple[Column, Column]:
    """CLS14: (path, attempts in order) of a document, by what its contents are in."""
    visible = F.when(has_page & numbered, "visible_toc_with_pages").when(has_page, "visible_toc_no_pages").otherwise("content_outline")
    path = F.when(embedded & ~disabled, "embedded_toc").otherwise(visible)
    rest = F.when(path == "embedded_toc", F.array()).when(path == "content_outline", F.array()).when(path == "visible_toc_no_pages", F.array(F.lit("content_outline"))).otherwise(F.array(F.lit("visible_toc_no_pages"), F.lit("content_outline")))
    return path, F.concat(F.array(path), rest.cast("array<string>"))


def _steps(items: DataFrame, doc: str) -> DataFrame:
    """Per document: whether its pages never go back, and their most common step."""
    w = W.partitionBy(doc).orderBy("ord")
    d = items.where("page is not null").withColumn("step", F.col("page") - F.lag("page").over(w))
    n = d.where("step is not null").groupBy(doc, "step").agg(F.count(F.lit(1)).alias("c"))
    top = n.groupBy(doc).agg(F.max(F.struct("c", -F.col("step"))).alias("top")).select(doc, (-F.col("top.col2")).alias("step"), F.col("top.c").alias("c"))
    return d.groupBy(doc).agg(F.count(F.lit(1)).alias("paged"), F.countDistinct("page").alias("unique"), F.coalesce(F.min("step") >= 0, F.lit(True)).alias("monotone"), F.max("page").alias("hi"), F.min("page").alias("lo")).join(top, doc, "left")


def check_contents(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """QLT02: whether contents are used as they are, as a skeleton to be mapped, or not at all.

    Their titles make a skeleton: two at the top level and four in five not blank. Their
    pages are used if four in five items have one, they never go back, and seven in ten differ.
    """
    low = items.join(items.where("trim(title) != ''").groupBy(doc).agg(F.min("level").alias("least")), doc, "left")
    a = low.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.trim("title") != "") & (F.col("level") == F.col("least"))).alias("top"), F.avg((F.trim("title") != "").cast("double")).alias("named"))
    d = a.join(_steps(items, doc), doc, "left")
    skeleton = (F.col("top") >= 2) & (F.col("named") >= 0.8)
    pages = F.coalesce((F.col("paged") >= 0.8 * F.col("n")) & F.col("monotone") & (F.col("unique") >= 0.7 * F.col("paged")), F.lit(False))
    return d.select(doc, "n", "top", F.when(skeleton & pages, "USE_DIRECT").when(skeleton, "USE_SKELETON_MAP_LATER").otherwise("REJECT").alias("decision"))


def accept_code_toc(items: DataFrame, pages: DataFrame, noisy: Column, doc: str = "doc_id") -> DataFrame:
    """QLT03: whether contents found in a file's own data are taken, and why not: source, pages, noise, range covered."""
    n = items.withColumn("noisy", noisy).groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"), F.avg(F.col("noisy").cast("double")).alias("noise"))
    d = n.join(_steps(items, doc), doc, "left").join(pages.groupBy(doc).agg(F.max("page").alias("last")), doc)
    covered = F.round(F.coalesce(F.col("hi") / F.col("last"), F.lit(0.0)), 4)
    reasons = [
        (F.col("source") == "", "missing_source"),
        ((F.col("source") != "") & ~F.col("source").isin(*TRUSTED), "untrusted_source"),
        (~F.coalesce((F.col("lo") >= 1) & (F.col("hi") <= F.col("last")), F.lit(False)), "invalid_pages"),
        (~F.coalesce("monotone", F.lit(True)), "non_monotonic_pages"),
        (F.col("noise") > 0.2, "title_noise_high"),
        (covered < 0.7, "low_range_coverage"),
    ]
    why = F.array_sort(F.filter(F.array(*[F.when(c, r) for c, r in reasons]), lambda x: x.isNotNull()))
    return d.select(doc, covered.alias("coverage"), F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("accepted"))


def balanced_gate(nodes: DataFrame, expected: DataFrame, doc: str = "doc_id", hard: int = 16) -> DataFrame:
    """QLT04: the top level against the titles ``expected``, and leaves too long to have no children.

    Extra top-level nodes are taken out without harm; missing ones, and leaves of ``hard``
    pages or more at the top, need repair.
    """
    top = nodes.where("level = 1").select(doc, "title").distinct()
    want = expected.select(doc, "title").distinct()
    extra = top.join(want, [doc, "title"], "left_anti").groupBy(doc).agg(F.count(F.lit(1)).alias("extra"))
    lost = want.join(top, [doc, "title"], "left_anti").groupBy(doc).agg(F.count(F.lit(1)).alias("missing"))
    long = nodes.groupBy(doc).agg(F.count_if((F.col("level") == 1) & F.col("leaf") & (F.col("end_page") - F.col("start_page") + 1 >= hard)).alias("long"))
    d = long.join(extra, doc, "left").join(lost, doc, "left").na.fill(0, ["extra", "missing"])
    return d.select(doc, "extra", "missing", "long", ((F.col("missing") > 0) | (F.col("long") > 0)).alias("needs_repair"))


def validate_items(items: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """QLT05: a score from 1 down: 0.05 for each item without a page or title, 0.1 for each beyond the last page."""
    last = pages.groupBy(doc).agg(F.max("page").alias("last"))
    cost = F.when(F.col("page").isNull(), 5).when(F.col("page") > F.col("last"), 10).otherwise(0) + F.when(F.trim(F.coalesce("title", F.lit(""))) == "", 5).otherwise(0)
    return items.join(last, doc).groupBy(doc).agg(F.sum((cost > 0).cast("long")).alias("issues"), F.greatest(F.lit(0.0), F.round(1 - F.sum(cost) / 100, 2)).alias("score"))


def auxiliary_mixed(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """QLT07: figure and table nodes that lie in no catalog of their own: an ancestor, or the node, that is an auxiliary catalog."""
    aux = F.col("catalog").isin("figure", "table")
    roots = nodes.where((F.col("kind") == "auxiliary_catalog") | (aux & ~F.col("leaf"))).select(F.col(doc).alias("__d"), F.col("ord").alias("__a"), F.col("last_ord").alias("__b"))
    inside = (F.col(doc) == F.col("__d")) & F.col("ord").between(F.col("__a"), F.col("__b"))
    loose = nodes.where(aux).join(roots, inside, "left_anti").groupBy(doc).agg(F.count(F.lit(1)).alias("mixed"))
    return nodes.select(doc).distinct().join(loose, doc, "left").na.fill(0, ["mixed"]).withColumn("isolated", F.col("mixed") == 0)


def adapter_score(nodes: DataFrame, noisy: Column, doc: str = "doc_id") -> DataFrame:
    """QLT09: 1, less for under three nodes, noisy titles, and anchors that go back; anchors of 0 are passed over."""
    w = W.partitionBy(doc).orderBy("ord")
    back = nodes.where("anchor > 0").withColumn("b", (F.col("anchor") < F.lag("anchor").over(w)).cast("int")).groupBy(doc).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bad"))
    d = nodes.withColumn("__n", noisy.cast("double")).groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.avg("__n").alias("noise")).join(back, doc, "left").na.fill(0, ["bad"])
    score = 1 - F.when(F.col("n") < 3, 0.35).otherwise(0.0) - F.least(F.lit(0.5), F.col("noise") * 0.8) - F.least(F.lit(0.3), F.col("bad") * 0.05)
    return d.select(doc, F.round(F.greatest(F.lit(0.0), score), 4).alias("score"))


def synthetic_root(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """TRE20: the nodes that count as top level: those of the least level, or those below a lone root that begins the outline and has the rest under it."""
    real = items.where("trim(title) != ''").withColumn("__named", F.lower(F.trim("title")).isin("contents", "table of contents", "目录"))
    levels = real.where("not __named").groupBy(doc, "level").agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("first"))
    w = W.partitionBy(doc).orderBy("level")
    levels = levels.withColumn("i", F.row_number().over(w)).withColumn("under", F.lead("c").over(w)).withColumn("head", F.min("first").over(W.partitionBy(doc)))
    top = levels.where("i = 1")
    lone = (F.col("c") == 1) & (F.coalesce("under", F.lit(0)) >= 2) & (F.col("first") == F.col("head"))
    said = real.groupBy(doc).agg(F.max(F.col("__named").cast("int")).alias("said"))
    return top.join(said, doc).select(doc, F.when(lone, F.col("under")).otherwise(F.col("c")).alias("top_level"), (lone | (F.col("said") == 1)).alias("synthetic"))


def first_passing(attempts: DataFrame, key: str) -> DataFrame:
    """TOC18: of each document's attempts the first that drafted, mapped and passed its gate; else the best candidate, as such."""
    ok = F.col("drafted") & F.col("mapped") & F.col("passed")
    d = attempts.groupBy(key).agg(F.min(F.when(ok, F.struct("step", "path"))).alias("won"), F.max(F.when(F.col("drafted"), F.struct("score", -F.col("step"), "path"))).alias("best"))
    return d.select(key, F.coalesce("won.path", "best.path").alias("path"), F.col("won").isNotNull().alias("passed"))


def pick_provider(candidates: DataFrame, key: str) -> DataFrame:
    """TOC16: of all providers' candidates the one with the best score; hints, then names, part equal ones."""
    best = F.max(F.struct("score", "hint", F.struct(F.transform(F.split("source", ""), lambda c: -F.ascii(c))).alias("n"), "source")).alias("b")
    return candidates.groupBy(key).agg(best, F.count(F.lit(1)).alias("candidates")).select(key, F.col("b.source").alias("source"), F.col("b.score").alias("score"), "candidates")


def fast_path(docs: DataFrame) -> Column:
    """TOC15: what a document's outline is made by: its own data if accepted, else headings in its text if there are enough, else a model."""
    return F.when(F.col("accepted"), "code_toc").when((F.col("headings") >= 3) & (F.col("coverage") >= 0.6), "fast_text").otherwise("balanced")


def checked_draft(items: DataFrame) -> DataFrame:
    """TOC12: items by contract: a title, a level from 1 on, a page or none, a known kind; others are marked with what they break."""
    page = F.col("page").try_cast("int")
    faults = F.array(F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title"), F.when(F.col("page").isNotNull() & F.coalesce(page < 1, F.lit(True)), "page"), F.when(~F.col("kind").isin("main_toc", "figure_catalog", "table_catalog", "other_toc"), "kind"))
    return items.withColumn("level", F.greatest(F.lit(1), F.coalesce(F.col("level").try_cast("int"), F.lit(1)))).withColumn("faults", F.filter(faults, lambda x: x.isNotNull()))


# --- queries -------------------------------------------------------------------------------------------------------

_LN = r"dl AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents)"
_COUNT = lambda test: f"len(list_filter(ls, lambda x: {test}))"
_HAS = lambda x, p: f"regexp_matches({x}, '{p}')"


@query("cls05_meaningful", rf"WITH l AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 3) AS ls FROM documents), a AS (SELECT doc_id, text, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS total, coalesce(list_sum(list_transform(list_filter(ls, lambda x: NOT regexp_matches(x, '^https?://|^\d+$') AND NOT {_HAS('x', FOOTER)} AND NOT (length(x) < 20 AND regexp_matches(x, '^[\x00-\x7f]*$'))), lambda x: length(x))), 0) AS say FROM l) SELECT doc_id, CASE WHEN length(text) >= 10 AND total > 0 THEN round(say / total, 6) ELSE 0 END::DOUBLE AS ratio FROM a")
def _cls05(spark, d):
    return load(spark, d, "documents").select("doc_id", meaningful_ratio(F.coalesce("text", F.lit(""))).alias("ratio"))


@query("cls09_signals", rf"""WITH {_LN} SELECT doc_id, round(least(0.36, CASE WHEN {_COUNT('length(x) >= 90')} >= 2 THEN 0.16 ELSE 0 END + CASE WHEN {_COUNT(f"length(x) >= 45 AND NOT {_HAS('x', NUMBER_AT_END)}")} / greatest(len(ls), 1) >= 0.35 THEN 0.14 ELSE 0 END + CASE WHEN {_COUNT("regexp_matches(lower(x), '<img|^<div')")} > 0 THEN 0.04 ELSE 0 END), 4)::DOUBLE AS body,
 (CASE WHEN len(ls) >= 3 AND length(text) % 2 = 0 THEN 0.6 ELSE 0 END)::DOUBLE AS chart FROM dl""")
def _cls09(spark, d):
    axis = F.expr("if(size(split(text, '\n')) >= 0 and char_length(text) % 2 = 0, array_join(array_repeat('12.5', 12), '\n'), text)")
    docs = load(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    body, chart = body_signal(F.col("text")), chart_signal(axis)
    return docs.select("doc_id", body.alias("body"), F.when(F.size(lines_of(F.col("text"))) >= 3, chart).otherwise(0.0).alias("chart"))


_ROLES = "CASE doc_id % 7 WHEN 0 THEN 'List of Figures' || chr(10) || text WHEN 1 THEN 'x' || chr(10) || 'Table 1 a' || chr(10) || 'table 2 b' || chr(10) || '表 3' WHEN 2 THEN 'Contents' || chr(10) || '1. One .. 3' || chr(10) || '2. Two' || chr(10) || '2.1 Three' WHEN 3 THEN 'Table of contents' || chr(10) || '1. One' || chr(10) || '2. Two' || chr(10) || '2.1 Three' || chr(10) || 'Figure one' WHEN 4 THEN 'Agenda' || chr(10) || '1) One' || chr(10) || '2) Two' WHEN 5 THEN 'Part 2' ELSE 'some words' END"


@query("cls10_roles", "SELECT doc_id, ['aux_figure_catalog', 'aux_table_catalog', 'formal_toc', 'no_page_toc', 'agenda_outline', 'section_marker', 'content'][doc_id % 7 + 1] AS role, [0.85, 0.85, 0.9, 0.78, 0.76, 0.72, 0][doc_id % 7 + 1]::DOUBLE AS confidence FROM documents WHERE text IS NOT NULL")
def _cls10(spark, d):
    role, sure = page_role(F.expr(_ROLES.replace("chr(10)", "'\\n'")))
    return load(spark, d, "documents").where("text is not null").select("doc_id", role.alias("role"), sure.alias("confidence"))


@query("cls08_layout_pages", f"WITH {PAGES}, s AS (SELECT doc_id, page, round((page * 7 % 11) / 10.0, 2) AS toc_score FROM pg), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY toc_score DESC, page) AS place FROM s WHERE toc_score >= 0.5) SELECT doc_id, page, place FROM r WHERE place <= 3")
def _cls08(spark, d):
    p = page_text(spark, d).withColumn("toc_score", F.expr("round((page * 7 % 11) / 10.0, 2)"))
    return layout_contents(p, "doc_id").select("doc_id", "page", "place")


@query("cls13_kinds", f"WITH {PAGES}, a AS (SELECT doc_id, count(*) AS n, avg((length(text) > 0)::INT) AS c, count(*) FILTER (page % 4 = 1) AS g, count(*) FILTER (page % 4 <> 1 AND length(text) > 30) AS t, 3 + doc_id % 7 AS i FROM pg GROUP BY 1) SELECT doc_id, n >= 8 AND c >= 0.6 AND g >= 2 AND t >= 5 AS slide_like, n >= 8 AND c >= 0.8 AND g >= 2 AND i BETWEEN 3 AND 8 AND t >= i AS agenda_like FROM a")
def _cls13(spark, d):
    p = page_text(spark, d).withColumn("agenda", F.expr("page % 4 = 1")).withColumn("titled", F.expr("page % 4 != 1 and length(text) > 30")).withColumn("items", F.expr("3 + doc_id % 7"))
    return document_kinds(p)


@query("cls14_routes", "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'embedded_toc' WHEN c_custkey % 5 < 3 AND c_custkey % 7 < 4 THEN 'visible_toc_with_pages' WHEN c_custkey % 5 < 3 THEN 'visible_toc_no_pages' ELSE 'content_outline' END AS path FROM customer) SELECT c_custkey, path, CASE path WHEN 'visible_toc_with_pages' THEN path || ',visible_toc_no_pages,content_outline' WHEN 'visible_toc_no_pages' THEN path || ',content_outline' ELSE path END AS attempts FROM r")
def _cls14(spark, d):
    path, tries = route(F.expr("c_custkey % 3 = 0"), F.expr("c_custkey % 2 = 0"), F.expr("c_custkey % 5 < 3"), F.expr("c_custkey % 7 < 4"))
    return load(spark, d, "customer").select("c_custkey", path.alias("path"), F.array_join(tries, ",").alias("attempts"))


_ITEMS = "it AS (SELECT doc_id, ord, level, CASE WHEN (doc_id + ord) % 6 = 0 THEN ' ' ELSE title END AS title, CASE WHEN doc_id % 4 = 1 AND ord % 2 = 0 THEN NULL WHEN doc_id % 4 = 2 AND ord = 2 THEN 1 ELSE page END AS page FROM ti)"
_STEPS = "st AS (SELECT doc_id, count(*) AS paged, count(DISTINCT page) AS u, coalesce(min(step) >= 0, true) AS monotone, max(page) AS hi, min(page) AS lo FROM (SELECT doc_id, page, page - lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS step FROM it WHERE page IS NOT NULL) GROUP BY 1)"


def _items(spark, d) -> DataFrame:
    return toc_items(spark, d).selectExpr("doc_id", "ord", "level", "if((doc_id + ord) % 6 = 0, ' ', title) as title", "case when doc_id % 4 = 1 and ord % 2 = 0 then null when doc_id % 4 = 2 and ord = 2 then 1 else page end as page")


@query("qlt02_decision", f"WITH {TOC}, {_ITEMS}, {_STEPS}, m AS (SELECT doc_id, min(level) AS least FROM it WHERE trim(title) <> '' GROUP BY 1), a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (trim(title) <> '' AND level = least) AS top, avg((trim(title) <> '')::INT) AS named FROM it LEFT JOIN m USING (doc_id) GROUP BY 1) SELECT doc_id, n, top, CASE WHEN top >= 2 AND named >= 0.8 AND coalesce(paged >= 0.8 * n AND monotone AND u >= 0.7 * paged, false) THEN 'USE_DIRECT' WHEN top >= 2 AND named >= 0.8 THEN 'USE_SKELETON_MAP_LATER' ELSE 'REJECT' END AS decision FROM a LEFT JOIN st USING (doc_id)")
def _qlt02(spark, d):
    return check_contents(_items(spark, d))


@query("qlt03_code_toc", f"WITH {TOC}, {_ITEMS}, {_STEPS}, n AS (SELECT doc_id, avg((length(title) < 12)::INT) AS noise, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'regex' WHEN 2 THEN 'links' ELSE 'bookmarks' END AS source FROM it GROUP BY 1), l AS (SELECT doc_id, max(page) AS last FROM pg GROUP BY 1), r AS (SELECT doc_id, round(coalesce(hi / last, 0), 4) AS coverage, list_filter(['invalid_pages', 'low_range_coverage', 'missing_source', 'non_monotonic_pages', 'title_noise_high', 'untrusted_source'], lambda x: CASE x WHEN 'invalid_pages' THEN NOT coalesce(lo >= 1 AND hi <= last, false) WHEN 'low_range_coverage' THEN round(coalesce(hi / last, 0), 4) < 0.7 WHEN 'missing_source' THEN source = '' WHEN 'non_monotonic_pages' THEN NOT coalesce(monotone, true) WHEN 'title_noise_high' THEN noise > 0.2 ELSE source = 'regex' END) AS why FROM n LEFT JOIN st USING (doc_id) JOIN l USING (doc_id)) SELECT doc_id, coverage, array_to_string(why, ',') AS reasons, len(why) = 0 AS accepted FROM r")
def _qlt03(spark, d):
    t = _items(spark, d).withColumn("source", F.expr("case doc_id % 5 when 0 then '' when 1 then 'regex' when 2 then 'links' else 'bookmarks' end"))
    return accept_code_toc(t, page_text(spark, d), F.length("title") < 12)


@query("qlt04_gate", f"WITH {TOC}, n AS (SELECT doc_id, ord, level, title, page AS s, page + 4 * (doc_id % 6) AS e, ord % 2 = 0 AS leaf FROM ti), t AS (SELECT DISTINCT doc_id, title FROM n WHERE level = 1), w AS (SELECT DISTINCT doc_id, title FROM ti WHERE level = 1 AND ord % 2 = 0 UNION SELECT DISTINCT doc_id, 'Planned' FROM ti WHERE doc_id % 3 = 0), x AS (SELECT doc_id, count(*) AS extra FROM t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = t.doc_id AND w.title = t.title) GROUP BY 1), m AS (SELECT doc_id, count(*) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE w.doc_id = t.doc_id AND w.title = t.title) GROUP BY 1), l AS (SELECT doc_id, count(*) FILTER (level = 1 AND leaf AND e - s + 1 >= 16) AS long FROM n GROUP BY 1) SELECT doc_id, coalesce(extra, 0) AS extra, coalesce(missing, 0) AS missing, long, coalesce(missing, 0) > 0 OR long > 0 AS needs_repair FROM l LEFT JOIN x USING (doc_id) LEFT JOIN m USING (doc_id)")
def _qlt04(spark, d):
    t = toc_items(spark, d)
    n = t.selectExpr("doc_id", "level", "title", "page as start_page", "page + 4 * (doc_id % 6) as end_page", "ord % 2 = 0 as leaf")
    want = t.where("level = 1 and ord % 2 = 0").select("doc_id", "title").unionByName(t.where("doc_id % 3 = 0").select("doc_id", F.lit("Planned").alias("title")))
    return balanced_gate(n, want)


@query("qlt05_validated", f"WITH {TOC}, {_ITEMS}, l AS (SELECT doc_id, max(page) AS last FROM pg GROUP BY 1), c AS (SELECT doc_id, CASE WHEN page IS NULL THEN 5 WHEN page + 2 > last THEN 10 ELSE 0 END + CASE WHEN trim(title) = '' THEN 5 ELSE 0 END AS cost FROM it JOIN l USING (doc_id)) SELECT doc_id, CAST(count(*) FILTER (cost > 0) AS BIGINT) AS issues, greatest(0, round(1 - sum(cost) / 100, 2))::DOUBLE AS score FROM c GROUP BY 1")
def _qlt05(spark, d):
    return validate_items(_items(spark, d).withColumn("page", F.col("page") + 2), page_text(spark, d))


@query("qlt07_isolation", f"WITH {TOC}, n AS (SELECT doc_id, ord, CASE WHEN ord % 3 > 0 AND doc_id % 3 > 0 THEN 'figure' ELSE 'main' END AS catalog, CASE WHEN ord % 6 = 0 THEN 'auxiliary_catalog' ELSE 'section' END AS kind FROM ti), r AS (SELECT doc_id, ord AS a, ord + 1 AS b FROM n WHERE kind = 'auxiliary_catalog'), x AS (SELECT doc_id, count(*) AS mixed FROM n WHERE catalog = 'figure' AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = n.doc_id AND n.ord BETWEEN a AND b) GROUP BY 1) SELECT t.doc_id, coalesce(mixed, 0) AS mixed, coalesce(mixed, 0) = 0 AS isolated FROM (SELECT DISTINCT doc_id FROM n) t LEFT JOIN x ON x.doc_id = t.doc_id")
def _qlt07(spark, d):
    n = toc_items(spark, d).selectExpr("doc_id", "ord", "if(ord % 3 > 0 and doc_id % 3 > 0, 'figure', 'main') as catalog", "if(ord % 6 = 0, 'auxiliary_catalog', 'section') as kind", "true as leaf", "if(ord % 6 = 0, ord + 1, ord) as last_ord")
    return auxiliary_mixed(n)


@query("qlt09_adapter", f"WITH {TOC}, n AS (SELECT doc_id, ord, length(title) < 12 AS noisy, CASE WHEN ord % 4 = 3 THEN 0 WHEN doc_id % 2 = 0 AND ord % 5 = 2 THEN 1 ELSE page END AS anchor FROM ti), b AS (SELECT doc_id, sum(b) AS bad FROM (SELECT doc_id, (anchor < lag(anchor) OVER (PARTITION BY doc_id ORDER BY ord))::INT AS b FROM n WHERE anchor > 0) GROUP BY 1), a AS (SELECT doc_id, count(*) AS n, avg(noisy::INT) AS noise FROM n GROUP BY 1) SELECT doc_id, round(greatest(0, 1 - CASE WHEN n < 3 THEN 0.35 ELSE 0 END - least(0.5, noise * 0.8) - least(0.3, coalesce(bad, 0) * 0.05)), 4)::DOUBLE AS score FROM a LEFT JOIN b USING (doc_id)")
def _qlt09(spark, d):
    n = toc_items(spark, d).withColumn("anchor", F.expr("case when ord % 4 = 3 then 0 when doc_id % 2 = 0 and ord % 5 = 2 then 1 else page end"))
    return adapter_score(n, F.length("title") < 12)


@query("tre20_synthetic", f"WITH {TOC}, n AS (SELECT doc_id, ord, CASE WHEN ord = 0 AND doc_id % 4 = 0 THEN 'Contents' ELSE title END AS title, CASE WHEN doc_id % 2 = 0 AND ord > 0 THEN level + 1 ELSE level END AS level FROM ti), e AS (SELECT *, lower(trim(title)) IN ('contents', 'table of contents', '目录') AS nm FROM n WHERE trim(title) <> ''), v AS (SELECT doc_id, level, count(*) AS c, min(ord) AS f FROM e WHERE NOT nm GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS i, lead(c) OVER w AS u, min(f) OVER (PARTITION BY doc_id) AS h FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY level)), s AS (SELECT doc_id, bool_or(nm) AS said FROM e GROUP BY 1) SELECT doc_id, CASE WHEN c = 1 AND coalesce(u, 0) >= 2 AND f = h THEN u ELSE c END AS top_level, (c = 1 AND coalesce(u, 0) >= 2 AND f = h) OR said AS synthetic FROM k JOIN s USING (doc_id) WHERE i = 1")
def _tre20(spark, d):
    t = toc_items(spark, d).selectExpr("doc_id", "ord", "if(ord = 0 and doc_id % 4 = 0, 'Contents', title) as title", "if(doc_id % 2 = 0 and ord > 0, level + 1, level) as level")
    return synthetic_root(t)


_TRIES = "a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step, o_orderpriority AS path, o_orderkey % 4 > 0 AS drafted, o_orderkey % 3 > 0 AS mapped, o_orderstatus = 'F' AS passed, round(o_totalprice) AS score FROM orders)"


@query("toc18_attempts", f"WITH {_TRIES}, w AS (SELECT o_custkey, arg_min(path, step) AS p FROM a WHERE drafted AND mapped AND passed GROUP BY 1), b AS (SELECT o_custkey, path AS q FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, step) AS i FROM a WHERE drafted) WHERE i = 1) SELECT o_custkey, coalesce(p, q) AS path, p IS NOT NULL AS passed FROM (SELECT DISTINCT o_custkey FROM a) LEFT JOIN w USING (o_custkey) LEFT JOIN b USING (o_custkey)")
def _toc18(spark, d):
    step = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    a = load(spark, d, "orders").select("o_custkey", step.alias("step"), F.col("o_orderpriority").alias("path"), F.expr("o_orderkey % 4 > 0 as drafted"), F.expr("o_orderkey % 3 > 0 as mapped"), F.expr("o_orderstatus = 'F' as passed"), F.round("o_totalprice").alias("score"))
    return first_passing(a, "o_custkey")


@query("toc16_providers", "SELECT o_custkey, source, score, n AS candidates FROM (SELECT o_custkey, o_orderpriority AS source, o_orderkey % 3 AS score, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 DESC, o_orderkey % 2 DESC, o_orderpriority) AS i FROM orders) WHERE i = 1")
def _toc16(spark, d):
    c = load(spark, d, "orders").selectExpr("o_custkey", "o_orderpriority as source", "o_orderkey % 3 as score", "o_orderkey % 2 as hint")
    return pick_provider(c, "o_custkey")


@query("toc15_fast_path", f"WITH {FILES} SELECT id, CASE WHEN status = 'completed' THEN 'code_toc' WHEN id % 6 >= 3 AND updated >= 0 THEN 'fast_text' ELSE 'balanced' END AS made_by FROM fi")
def _toc15(spark, d):
    f = files(spark, d).selectExpr("id", "status = 'completed' as accepted", "id % 6 as headings", "if(updated >= 0, 0.9, 0.1) as coverage")
    return f.select("id", fast_path(f).alias("made_by"))


@query("toc12_contract", f"WITH {TOC} SELECT doc_id, ord, CASE WHEN ord % 4 = 0 THEN 1 ELSE level END AS level, array_to_string(list_filter([CASE WHEN trim(title) = '' OR ord % 5 = 0 THEN 'title' END, CASE WHEN ord % 3 = 0 THEN 'page' END, CASE WHEN ord % 2 = 0 THEN 'kind' END], lambda x: x IS NOT NULL), ',') AS faults FROM ti")
def _toc12(spark, d):
    t = toc_items(spark, d).selectExpr("doc_id", "ord", "if(ord % 5 = 0, null, title) as title", "case ord % 4 when 0 then 'x' else cast(level as string) end as level", "case ord % 3 when 0 then 'ix' when 1 then null else cast(page as string) end as page", "if(ord % 2 = 0, 'strange', 'main_toc') as kind")
    return checked_draft(t).select("doc_id", "ord", "level", F.array_join("faults", ",").alias("faults"))
