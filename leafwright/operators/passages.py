"""Pages and passages: segments, labels, merged text layers, plain-text sources, titles on pages and the document tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import FILES, PAGES, TOC, files, page_text, toc_items
from ..sources.tables import load
from .outlines import _SPAN, spans
from .scalars import page_request, strip_extension
from .search import confidence
from .text import match_form


def segment_text(title: Column, summary: Column, text: Column, most: int = 2000) -> Column:
    """PRJ02: what is searched of a node: title, summary and text that aren't empty, a line each."""
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.substring(F.concat_ws("\n", some(title), some(summary), some(text)), 1, most)


def segment_snippet(title: Column, summary: Column, text: Column, most: int = 320) -> Column:
    """PRJ02: what is shown of it: the first of text, summary and title that isn't empty."""
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.substring(F.coalesce(some(text), some(summary), some(title), F.lit("")), 1, most)


def anchor_unit(anchor: Column) -> Column:
    """PRJ04: the unit of an anchor (a map) without one, by the keys it has."""
    has = lambda *keys: F.coalesce(F.arrays_overlap(F.map_keys(anchor), F.array(*map(F.lit, keys))), F.lit(False))
    named = F.try_element_at(anchor, F.lit("unit_type"))
    return (
        F.when(named.isNotNull() & (named != ""), named)
        .when(has("start_line", "end_line"), "line")
        .when(has("start_paragraph", "end_paragraph"), "paragraph")
        .when(has("start_row", "end_row"), "row_range")
        .when(has("start_slide", "end_slide", "slide"), "slide")
        .when(has("start_page", "end_page", "page"), "page")
    )


def short_label(name: Column, unit: Column, start: Column, end: Column) -> Column:
    """PRJ05: a document's name without suffix and a place; the name as it is without one."""
    many = F.coalesce(end, start) != start
    span = F.when(many, F.concat_ws("-", start.cast("string"), end.cast("string"))).otherwise(start.cast("string"))
    place = F.when(unit == "page", F.concat(F.lit("p."), span)).otherwise(F.concat(unit, F.when(many, "s ").otherwise(" "), span))
    return F.when(start.isNull() | (start == 0), name).otherwise(F.concat_ws(" ", strip_extension(name), place))


def fast_summaries(nodes: DataFrame, doc: str = "doc_id", order: str = "ord", parent: str = "parent_ord", most: int = 200) -> DataFrame:
    """PRJ19: the title with the text's start; without text up to five children's titles, else the title alone."""
    c = nodes.where(F.col(parent).isNotNull()).withColumn("__i", F.row_number().over(W.partitionBy(doc, parent).orderBy(order))).where("__i <= 5")
    c = c.groupBy(doc, F.col(parent).alias(order)).agg(F.array_sort(F.collect_list(F.struct("__i", "title"))).alias("__c"))
    j = nodes.join(c, [doc, order], "left")
    text = F.trim(F.translate(F.substring(F.coalesce("text", F.lit("")), 1, most), "\n", " "))
    kids = F.array_join(F.filter(F.transform("__c", lambda x: x.title), lambda t: (t != "") & (t != F.col("title"))), "；")
    body = F.when(text != "", text).otherwise(F.coalesce(kids, F.lit("")))
    return j.withColumn("summary", F.when(body == "", F.col("title")).otherwise(F.concat(F.col("title"), F.lit("。"), body))).drop("__c")


def duration(status: Column, updated: Column, reindexed: Column, created: Column) -> Column:
    """PRJ16: seconds a completed document took since its last parse, or else its arrival."""
    return F.when(status == "completed", F.unix_timestamp(updated) - F.unix_timestamp(F.coalesce(reindexed, created)))


def pages_to_ocr(kind: Column, images: Column, image_only: Column, garbled: Column) -> Column:
    """CLS03: every page of an ocr document, pages with images of a hybrid one, bare and garbled ones of any."""
    return (kind == "ocr") | ((kind == "hybrid") & (images > 0)) | image_only | garbled


def merge_layers(pages: DataFrame, recognized: DataFrame, doc: str = "doc_id") -> DataFrame:
    """CLS04: a page's text by recognition where it was asked for and gave any, else of the text layer; with source and quality."""
    o = recognized.select(doc, "page", F.col("text").alias("__o"))
    j = pages.join(o, [doc, "page"], "left")
    used = F.col("wanted") & F.coalesce(F.trim("__o") != "", F.lit(False))
    quality = F.when(used, "reliable").when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(F.col("wanted"), "partial").otherwise("reliable")
    return j.select(doc, "page", F.when(used, F.col("__o")).otherwise(F.col("text")).alias("text"), F.when(used, "ocr").otherwise("text_layer").alias("source"), quality.alias("quality"), used.alias("ocr_used"))


def trailing_numbers(lines: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 3) -> DataFrame:
    """CLS12: whether ``least`` lines of a document end in a page number."""
    n = F.count_if(F.col(text).rlike(r"[.…·\s]\s*\d{1,4}\s*$"))
    return lines.groupBy(doc).agg((n >= least).alias("numbered"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 12000) -> DataFrame:
    """SRC02: lines between blank ones as paragraphs with their first and last line; text cut at ``most``."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("p", "l")).withColumn("line", F.col("p") + 1)
    w = W.partitionBy(key).orderBy("line")
    g = lines.withColumn("g", F.sum((F.trim("l") == "").cast("int")).over(w)).where(F.trim("l") != "")
    g = g.groupBy(key, "g").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.array_sort(F.collect_list(F.struct("line", "l"))).alias("x"))
    return g.select(key, "start_line", "end_line", F.substring(F.array_join(F.transform("x", lambda r: r.l), "\n"), 1, most).alias("text"))


def line_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 40) -> DataFrame:
    """SRC11: every ``size`` lines as a chunk with its first and last line."""
    lines = F.split(text, "\n")
    d = docs.select(key, lines.alias("l")).withColumn("c", F.explode(F.expr(f"sequence(0, (size(l) - 1) div {size})")))
    part = F.slice("l", F.col("c") * size + 1, size)
    return d.select(key, (F.col("c") * size + 1).alias("start_line"), F.least((F.col("c") + 1) * size, F.size("l")).alias("end_line"), F.array_join(part, "\n").alias("text"))


def markdown_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SRC03, SRC12: hash headings outside fences, each with its level and the last line of its section.

    A fence opens or closes code, so lines after an odd number of fences are code.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("p", "l")).withColumn("line", F.col("p") + 1)
    w = W.partitionBy(key).orderBy("line")
    d = lines.withColumn("f", F.sum(F.col("l").rlike(r"^\s{0,3}(```|~~~)").cast("int")).over(w)).withColumn("last", F.max("line").over(W.partitionBy(key)))
    h = d.where((F.col("f") % 2 == 0) & F.col("l").rlike(r"^#{1,6}\s+\S"))
    end = F.coalesce(F.lead("line").over(w) - 1, F.col("last"))
    return h.select(key, "line", F.char_length(F.regexp_extract("l", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("l", r"^#+\s+|\s+#+\s*$", "")).alias("title"), end.alias("end_line"))


def row_chunks(rows: DataFrame, table: str, order: list[str], size: int = 100, most: int = 20) -> DataFrame:
    """SRC06: a table's rows in ranges of ``size``; only the first ``most`` ranges become nodes, as of an outline."""
    i = F.row_number().over(W.partitionBy(table).orderBy(*order))
    d = rows.withColumn("i", i).withColumn("chunk", F.expr(f"(i - 1) div {size}")).where(F.col("chunk") < most)
    return d.groupBy(table, "chunk").agg(F.min("i").alias("first_row"), F.max("i").alias("last_row"))


def toc_lines(text: Column) -> Column:
    """TOC05: lines of title, leaders and page as (number, title, page)."""
    hit = r"(?m)^((?:\d{1,2}(?:\.\d{1,2}){0,3}\s+)?)([^\n.…·]{2,80})[.…·\s]+(\d{1,4})\s*$"
    part = lambda i: F.regexp_extract_all(text, F.lit(hit), F.lit(i))
    z = F.arrays_zip(part(1).alias("n"), part(2).alias("t"), part(3).alias("p"))
    return F.filter(F.transform(z, lambda x: F.struct(F.trim(x.n).alias("number"), F.trim(x.t).alias("title"), x.p.cast("int").alias("page"))), lambda x: (x.page > 0) & (x.title != ""))


def first_title_page(items: DataFrame, pages: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """MAP01, JON12 (exact tiers): the first page with the title as a line of its own (0.95), else the first that holds it (0.9)."""
    p = pages.select(doc, F.col("page").alias("__p"), match_form(F.col("text")).alias("__f"), F.transform(F.split("text", "\n"), match_form).alias("__l"))
    t = items.withColumn("__t", match_form(F.col("title"))).where("__t <> ''")
    score = F.when(F.array_contains("__l", F.col("__t")), 0.95).when(F.contains("__f", F.col("__t")), 0.9)
    j = t.join(p, doc).withColumn("score", score).where("score is not null")
    return j.groupBy(doc, order).agg(F.max_by(F.struct(F.col("__p").alias("page"), "score"), F.struct("score", -F.col("__p"))).alias("b")).select(doc, order, F.col("b.page").alias("found"), F.col("b.score").alias("score"))


def repeated_catalogs(items: DataFrame, pages: DataFrame, least: int = 3, doc: str = "doc_id") -> DataFrame:
    """MAP12: pages that hold the titles of ``least`` items or more."""
    t = items.select(doc, match_form(F.col("title")).alias("__t")).where("__t <> ''").groupBy(doc).agg(F.collect_set("__t").alias("__ts"))
    j = pages.withColumn("__f", match_form(F.col("text"))).join(t, doc)
    n = F.size(F.filter("__ts", lambda x: F.contains("__f", x)))
    return j.withColumn("titles", n).where(F.col("titles") >= least).select(doc, "page", "titles")


def located(pages: DataFrame, phrase: str, terms: list[str], doc: str = "doc_id") -> DataFrame:
    """SEA09, SEA12, SRT04, TOOL5: pages that hold the phrase, or two terms (any, under a phrase of less than six
    characters), ranked by phrase, two terms, number of terms, occurrences and page."""
    t = F.lower("text")
    counts = F.array(*[F.size(F.split(t, F.lit("\\Q" + x.lower() + "\\E"))) - 1 for x in terms])
    d = pages.withColumn("__p", F.contains(t, F.lit(phrase.lower()))).withColumn("__c", counts)
    n, total = F.size(F.filter("__c", lambda x: x > 0)), F.aggregate("__c", F.lit(0), lambda a, x: a + x)
    d = d.withColumn("matched", n).withColumn("occurrences", total).where(F.col("__p") | (F.col("matched") >= (1 if len(phrase) < 6 else 2)))
    w = W.partitionBy(doc).orderBy(F.desc("__p"), F.desc(F.col("matched") >= 2), F.desc("matched"), F.desc("occurrences"), "page")
    return d.withColumn("place", F.row_number().over(w)).drop("__p", "__c")


def recall(evidence: Column, tokens: Column) -> Column:
    """SEA15: the distinct tokens of two characters or more that the evidence contains."""
    return F.size(F.filter(F.array_distinct(tokens), lambda x: (F.char_length(x) >= 2) & F.contains(F.lower(evidence), x)))


def empty_nodes(texts: DataFrame, text: str = "node_text", doc: str = "doc_id") -> DataFrame:
    """QLT06: nodes without text and their share."""
    e = (F.coalesce(F.trim(text), F.lit("")) == "").cast("int")
    return texts.groupBy(doc).agg(F.sum(e).alias("empty"), F.round(F.avg(e), 4).alias("ratio"))


def path_taken(outline_ok: Column, official_ok: Column) -> Column:
    """QLT12: the branch of an extraction."""
    return F.when(outline_ok, "BRANCH_A").when(official_ok, "BRANCH_B").otherwise("REPAIR")


def page_content(pages: DataFrame, asked: DataFrame, most: int = 4000, doc: str = "doc_id") -> DataFrame:
    """TOOL4: the pages a request names, each cut at ``most`` characters; a bad request has none."""
    a = asked.select(doc, F.explode(page_request(F.col("request"))).alias("page"))
    return a.join(pages, [doc, "page"]).select(doc, "page", F.substring("text", 1, most).alias("text"), (F.char_length("text") > most).alias("cut"))


def browse(docs: DataFrame, scored: DataFrame | None = None, scope: str | None = None, sort: str = "name") -> DataFrame:
    """TOOL2, SEA19, SRT10: documents of a scope by score where a search was made, else by a field as text."""
    d = docs if scope is None else docs.where(F.col("folder_id") == scope)
    if scored is None:
        return d.withColumn("place", F.row_number().over(W.partitionBy("folder_id").orderBy(F.col(sort).cast("string"), "id")))
    return d.join(scored.select("id", "score"), "id").withColumn("place", F.row_number().over(W.partitionBy("folder_id").orderBy(F.desc("score"), "id")))


@query("prj02_segments", f"WITH {TOC} SELECT ti.doc_id, ord, (CASE WHEN trim(title) <> '' THEN title || chr(10) ELSE '' END || CASE WHEN ord % 2 = 0 THEN 'sum' || chr(10) ELSE '' END || text)[1:2000] AS searched, (CASE WHEN trim(text) <> '' THEN text WHEN ord % 2 = 0 THEN 'sum' ELSE title END)[1:320] AS shown FROM ti JOIN pg USING (doc_id, page) WHERE trim(text) <> ''")
def _prj02(spark, d):
    j = toc_items(spark, d).join(page_text(spark, d), ["doc_id", "page"]).where("trim(text) <> ''").withColumn("s", F.expr("if(ord % 2 = 0, 'sum', '')"))
    c = [F.col("title"), F.col("s"), F.col("text")]
    return j.select("doc_id", "ord", segment_text(*c).alias("searched"), segment_snippet(*c).alias("shown"))


@query("prj04_units", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'slide' WHEN 2 THEN 'page' ELSE 'given' END AS unit FROM events")
def _prj04(spark, d):
    a = F.expr("case event_id % 4 when 0 then map('end_line', '3') when 1 then map('slide', '1') when 2 then map('page', '2') else map('unit_type', 'given', 'page', '1') end")
    return load(spark, d, "events").select("event_id", anchor_unit(a).alias("unit"))


@query("prj05_labels", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '.pdf' WHEN 1 THEN c_name || ' p.' || c_custkey ELSE c_name || ' rows ' || c_custkey || '-' || (c_custkey + 2) END AS label FROM customer")
def _prj05(spark, d):
    k = F.col("c_custkey")
    unit, start, end = F.when(k % 3 == 1, "page").otherwise("row"), F.when(k % 3 > 0, k), F.when(k % 3 == 2, k + 2)
    return load(spark, d, "customer").select("c_custkey", short_label(F.concat("c_name", F.lit(".pdf")), unit, start, end).alias("label"))


@query("prj16_duration", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3600 ELSE 86400 END AS BIGINT) END AS seconds FROM orders")
def _prj16(spark, d):
    o = load(spark, d, "orders").withColumn("s", F.expr("if(o_orderstatus = 'F', 'completed', 'failed')"))
    at = F.col("o_orderdate")
    return o.select("o_orderkey", duration(F.col("s"), at + F.expr("interval 1 day"), F.when(F.col("o_orderkey") % 2 == 0, at + F.expr("interval 23 hours")), at).alias("seconds"))


_FAST = "nx AS (SELECT doc_id, ord, title, level, CASE WHEN ord % 2 = 1 THEN '' ELSE text END AS text FROM ti JOIN pg USING (doc_id, page)), pa AS (SELECT *, (SELECT max(b.ord) FROM nx b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent_ord FROM nx a), ch AS (SELECT doc_id, parent_ord AS ord, string_agg(title, '；' ORDER BY ord) AS kids FROM (SELECT a.*, b.title AS pt, row_number() OVER (PARTITION BY a.doc_id, a.parent_ord ORDER BY a.ord) AS i FROM pa a JOIN nx b ON b.doc_id = a.doc_id AND b.ord = a.parent_ord) WHERE i <= 5 AND title <> '' AND title <> pt GROUP BY 1, 2)"


@query("prj19_summary", f"WITH {TOC}, {_FAST}, b AS (SELECT pa.doc_id, pa.ord, title, CASE WHEN trim(replace(text[1:200], chr(10), ' ')) <> '' THEN trim(replace(text[1:200], chr(10), ' ')) ELSE coalesce(kids, '') END AS body FROM pa LEFT JOIN ch ON ch.doc_id = pa.doc_id AND ch.ord = pa.ord) SELECT doc_id, ord, CASE WHEN body = '' THEN title ELSE title || '。' || body END AS summary FROM b")
def _prj19(spark, d):
    from .hierarchy import parents_by_level

    n = toc_items(spark, d).join(page_text(spark, d), ["doc_id", "page"]).withColumn("text", F.expr("if(ord % 2 = 1, '', text)"))
    return fast_summaries(parents_by_level(n)).select("doc_id", "ord", "summary")


@query("cls03_ocr_pages", f"WITH {PAGES} SELECT doc_id, page FROM pg WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND page % 2 = 1) OR page % 7 = 0")
def _cls03(spark, d):
    kind = F.expr("case doc_id % 3 when 0 then 'ocr' when 1 then 'hybrid' else 'text' end")
    return page_text(spark, d).where(pages_to_ocr(kind, F.col("page") % 2, F.col("page") % 7 == 0, F.lit(False))).select("doc_id", "page")


_LAYERS = "ly AS (SELECT doc_id, page, CASE WHEN page % 2 = 0 AND page % 6 <> 0 THEN 'ocr' ELSE 'text_layer' END AS source, CASE WHEN page % 2 = 0 AND page % 6 <> 0 THEN 'reliable' WHEN trim(text) = '' THEN 'empty' WHEN page % 2 = 0 THEN 'partial' ELSE 'reliable' END AS quality FROM pg)"


def _layers(spark, d) -> DataFrame:
    p = page_text(spark, d).withColumn("wanted", F.col("page") % 2 == 0)
    return merge_layers(p, p.where("page % 2 = 0").select("doc_id", "page", F.expr("if(page % 6 = 0, ' ', concat('seen ', page))").alias("text")))


@query("cls04_layers", f"WITH {PAGES}, {_LAYERS} SELECT * FROM ly")
def _cls04(spark, d):
    return _layers(spark, d).select("doc_id", "page", "source", "quality")


@query("agg10_layers", f"WITH {PAGES}, {_LAYERS} SELECT source, quality, count(*) AS n FROM ly GROUP BY 1, 2")
def _agg10(spark, d):
    return _layers(spark, d).groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("cls12_trailing", rf"WITH {PAGES} SELECT doc_id, count(*) FILTER (page % 3 = 0 OR regexp_matches(text, '[.…·\s]\s*\d{{1,4}}\s*$')) >= 3 AS numbered FROM pg GROUP BY 1")
def _cls12(spark, d):
    return trailing_numbers(page_text(spark, d).withColumn("text", F.expr("if(page % 3 = 0, concat('Part .... ', page), text)")))


@query("src02_paragraphs", f"WITH {PAGES}, k AS (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN '' ELSE text END AS l FROM pg), g AS (SELECT *, sum((trim(l) = '')::INT) OVER (PARTITION BY doc_id ORDER BY page) AS g FROM k) SELECT doc_id, min(page) AS start_line, max(page) AS end_line, string_agg(l, chr(10) ORDER BY page)[1:12000] AS text FROM g WHERE trim(l) <> '' GROUP BY doc_id, g")
def _src02(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 0, F.lit("")).otherwise(x)), "\n").alias("text"))
    return paragraphs(t)


@query("src11_chunks", f"WITH {PAGES} SELECT doc_id, CAST((page - 1) // 3 * 3 + 1 AS INT) AS start_line, max(page) AS end_line, string_agg(text, chr(10) ORDER BY page) AS text FROM pg GROUP BY doc_id, (page - 1) // 3")
def _src11(spark, d):
    return line_chunks(load(spark, d, "documents"), size=3)


@query("src12_headings", f"WITH {TOC}, k AS (SELECT doc_id, ord, level, title, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM ti WHERE contains(title, '#') = false AND title = trim(title) AND title <> '') SELECT doc_id, CAST(i * 4 - 3 AS INT) AS line, level, title, CAST(i * 4 AS INT) AS end_line FROM k")
def _src12(spark, d):
    t = toc_items(spark, d).where("not contains(title, '#') and title = trim(title) and title <> ''")
    line = F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("title"), F.lit("\n```\n# no heading\n```"))
    m = t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x.l), "\n").alias("text"))
    return markdown_headings(m)


@query("src06_row_chunks", "WITH k AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer) SELECT c_mktsegment, (i - 1) // 10 AS chunk, min(i) AS first_row, max(i) AS last_row FROM k WHERE (i - 1) // 10 < 20 GROUP BY 1, 2")
def _src06(spark, d):
    return row_chunks(load(spark, d, "customer"), "c_mktsegment", ["c_custkey"], 10)


@query("toc05_lines")
def _toc05(spark, d):
    """Every page's own text, with a contents line added to it."""
    lines = F.concat(F.col("text"), F.lit("\n1.2 First part ..... "), F.col("page").cast("string"))
    return page_text(spark, d).select("doc_id", F.col("page").alias("on_page"), F.explode(toc_lines(lines)).alias("x")).select("doc_id", "on_page", "x.*")


@query("map01_title_page", rf"WITH {TOC}, p AS (SELECT doc_id, page, regexp_replace(lower(text), '[^0-9a-zA-Z\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS f FROM pg), t AS (SELECT doc_id, ord, regexp_replace(lower(title), '[^0-9a-zA-Z\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS t FROM ti) SELECT t.doc_id, ord, coalesce(min(page) FILTER (f = t), min(page)) AS found, CASE WHEN bool_or(f = t) THEN 0.95 ELSE 0.9 END::DOUBLE AS score FROM t JOIN p ON p.doc_id = t.doc_id AND contains(f, t) WHERE t <> '' GROUP BY 1, 2")
def _map01(spark, d):
    return first_title_page(toc_items(spark, d), page_text(spark, d))


@query("map12_repeats", rf"WITH {TOC}, p AS (SELECT doc_id, page, regexp_replace(lower(text), '[^0-9a-zA-Z\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS f FROM pg), t AS (SELECT DISTINCT doc_id, regexp_replace(lower(title), '[^0-9a-zA-Z\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS t FROM ti) SELECT p.doc_id, page, CAST(count(*) AS INT) AS titles FROM p JOIN t ON t.doc_id = p.doc_id AND contains(f, t) WHERE t <> '' GROUP BY 1, 2 HAVING count(*) >= 2")
def _map12(spark, d):
    return repeated_catalogs(toc_items(spark, d), page_text(spark, d), 2)


_LOC = "lc AS (SELECT doc_id, page, contains(lower(text), 'of the') AS p, len(string_split(lower(text), 'the')) - 1 AS a, len(string_split(lower(text), 'and')) - 1 AS b FROM pg)"


@query("tool5_locate", f"WITH {PAGES}, {_LOC} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, (a > 0 AND b > 0) DESC, (a > 0)::INT + (b > 0)::INT DESC, a + b DESC, page) AS place FROM lc WHERE p OR (a > 0 AND b > 0)")
def _tool5(spark, d):
    return located(page_text(spark, d), "of the", ["the", "and"]).select("doc_id", "page", "place")


@query("sea15_recall", r"SELECT conv_id, turn, CAST((contains(lower(text), 'the'))::INT + (contains(lower(text), 'and'))::INT AS INT) AS score FROM conversations")
def _sea15(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", recall(F.col("text"), F.array(*map(F.lit, ["the", "a", "and", "the"]))).alias("score"))


@query("sea05_doc_best", "WITH g AS (SELECT l_orderkey, max(l_discount * 10) AS s FROM lineitem GROUP BY 1), k AS (SELECT l_orderkey, round(CASE WHEN l_orderkey % 2 = 0 THEN least(1.0, s + 0.08) ELSE s END, 6) AS score FROM g) SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM k")
def _sea05(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_discount") * 10).alias("s"))
    s = F.when(F.col("l_orderkey") % 2 == 0, F.least(F.lit(1.0), F.col("s") + 0.08)).otherwise(F.col("s"))
    return g.select("l_orderkey", F.round(s, 6).alias("score")).withColumn("confidence", confidence(F.col("score")))


@query("qlt06_empty", f"WITH {TOC} SELECT doc_id, sum((ord % 3 = 0 OR trim(title) = '')::INT)::BIGINT AS empty, round(avg((ord % 3 = 0 OR trim(title) = '')::INT), 4) AS ratio FROM ti GROUP BY 1")
def _qlt06(spark, d):
    return empty_nodes(toc_items(spark, d).withColumn("node_text", F.expr("if(ord % 3 = 0, null, title)")))


@query("qlt12_path", f"WITH {FILES} SELECT id, CASE WHEN status = 'completed' THEN 'BRANCH_A' WHEN updated > 0 THEN 'BRANCH_B' ELSE 'REPAIR' END AS path FROM fi")
def _qlt12(spark, d):
    return files(spark, d).select("id", path_taken(F.col("status") == "completed", F.col("updated") > 0).alias("path"))


@query("tool4_pages", f"WITH {PAGES} SELECT doc_id, page, text[1:50] AS text, length(text) > 50 AS cut FROM pg WHERE page IN (1, 2, 3, 6) AND doc_id % 4 > 0")
def _tool4(spark, d):
    asked = load(spark, d, "documents").select("doc_id", F.expr("if(doc_id % 4 = 0, '3-1', '6,1-3,2')").alias("request"))
    return page_content(page_text(spark, d), asked, 50)


@query("tool3_structure", f"WITH {_SPAN} SELECT doc_id, ord, level, title, CASE WHEN start_page = end_page THEN CAST(start_page AS VARCHAR) ELSE start_page || '-' || end_page END AS pages FROM nd QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 20")
def _tool3(spark, d):
    n = spans(spark, d).withColumn("i", F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))).where("i <= 20")
    return n.select("doc_id", "ord", "level", "title", F.expr("if(start_page = end_page, cast(start_page as string), concat(start_page, '-', end_page))").alias("pages"))


@query("tool2_browse", f"WITH {FILES} SELECT id, row_number() OVER (PARTITION BY folder_id ORDER BY name, id) AS place FROM fi")
def _tool2(spark, d):
    return browse(files(spark, d)).select("id", "place")
