"""Smaller rules: title and position forms, question predicates, retrieval plans, evidence, payloads and cache keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import FILES, PAGES, TOC, files, page_text, toc_items
from ..sources.tables import load

# Characters that common prose is made of.
READABLE = r"[一-鿿0-9A-Za-z \n\t.,:;!?()\[\]{}<>_/\\'\"%&+*#@$·—：，。、；（）【】“”‘’-]"
# Phrases that speak of the asker's documents, in lower case.
_THING = "(document|documents|file|files|pdf|pdfs|attachment|attachments)"
ABOUT_DOCUMENTS = (
    rf"\b(uploaded|attached|current|selected|available|all)\s+{_THING}\b",
    rf"\b(my|our|the|this|these)\s+{_THING}\b",
    rf"\b{_THING}\s+(i|we)\s+(uploaded|attached|selected)\b",
    rf"\b{_THING}\s+(content|contents|summary|summaries|analysis|evidence)\b",
    r"\b(in|from|within|inside)\s+(the|this|these|my|our|uploaded|attached|current|selected)\s+(document|documents|file|files|pdf|pdfs|library|folder)\b",
    r"\b(document|file|pdf)\s+library\b",
    r"\bcurrent\s+(scope|folder|library)\b",
    r"\b(according to|based on)\b.*\b(document|file|pdf|attachment|upload|library)\b",
    "上传的文档|上传的文件|我的文档|我的文件|当前文档|当前文件|选中文档|选中的文档|文档库|文件夹|当前范围|这篇|这份|这个文件|这些文档|这些文件|附件|资料",
)
ABOUT_TABLES = r"\b(count|sum|avg|average|group by|total)\b|统计|汇总|总数|平均|分组|多少"
ABOUT_PLACES = "where|which page|find|locate|mentioned|contains|在哪|哪一页|哪页|哪个章节|提到|出现|查找|搜索|定位|包含"
# Other names of capabilities, and their order.
ALIASES = {
    "function_calling": "tool_calling", "tools": "tool_calling", "tool": "tool_calling", "image": "vision", "visual": "vision", "vl": "vision",
    "vlm": "vision", "vision_language": "vision", "vision_language_model": "vision", "reason": "reasoning", "thinking": "reasoning", "text_embedding": "embedding",
}
CAPABILITIES = ["llm", "vision", "ocr", "embedding", "reasoning", "tool_calling"]
# Titles of catalogs by kind.
CATALOGS = {"contents": "main", "目录": "main", "list of figures": "figure", "图目录": "figure", "list of tables": "table", "表目录": "table"}
#: Tools whose answers are evidence by themselves.
EVIDENT = ("get_page_image", "get_document_image", "web_search", "search_within_document", "aggregate_tables")


def title_key(title: Column) -> Column:
    """FN03: a title without white space and punctuation, in lower case."""
    return F.lower(F.regexp_replace(title, r"[\s\p{P}]+", ""))


def squeezed(text: Column) -> Column:
    """FN04: without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def one_line(text: Column) -> Column:
    """FN04: trimmed, each run of white space one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def chunks(text: Column) -> Column:
    """FN08: all stretches of four characters, then of three, then of two."""
    part = lambda n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(part(4), part(3), part(2))


def slide_title(title: Column) -> Column:
    """FN12: a slide's title without the number that an export put before it; default sections and bare numbers are empty."""
    t = one_line(title)
    for word in ("幻灯片", "(?i:slide)", "(?i:page)"):
        t = F.regexp_replace(t, rf"^\s*{word}\s*\d+\s*[:：-]?\s*", "")
    return F.when(F.lower(one_line(title)).isin("默认节", "default section"), "").otherwise(one_line(t))


def position_unit(unit: Column) -> Column:
    """FN14: one name for each unit of a citation's position."""
    u = F.lower(unit)
    return F.when(u.isin("page", "pages", "页"), "p").when(u == "lines", "line").when(u == "rows", "row").when(u.isin("paragraph", "paragraphs"), "para").when(u == "slides", "slide").otherwise(u)


def first_number(text: Column) -> Column:
    """FN14: the first number of a text, 1 at least; 0 without one."""
    n = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(n == "", 0).otherwise(F.greatest(F.lit(1), n.try_cast("int")))


def readable_ratio(text: Column) -> Column:
    """FN17: the share of characters that common prose is made of; 0 for an empty text."""
    n = F.char_length(text)
    return F.when(n > 0, F.round((n - F.char_length(F.regexp_replace(text, READABLE, ""))) / n, 6)).otherwise(0.0)


def iso(ts: Column) -> Column:
    """FN25."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def minutes_left(now: Column, until: Column) -> Column:
    """FN25: whole minutes, begun ones counted, until a lock ends; 0 after it."""
    return F.greatest(F.lit(0), F.ceil((F.unix_timestamp(until) - F.unix_timestamp(now)) / 60)).cast("int")


def first_present(*values: Column) -> Column:
    """FN26, FN29: the first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def as_arguments(text: Column) -> Column:
    """FN28: a JSON object as it is, anything else as the ``value`` of one; nothing is an empty object."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "{}").when(t.rlike(r"^\{") & F.get_json_object(t, "$").isNotNull(), t).otherwise(F.to_json(F.struct(t.alias("value"))))


def catalog_kind(title: Column) -> Column:
    """FN31: the kind of catalog that a title names, by table; null for others."""
    table = F.create_map(*[F.lit(x) for kv in CATALOGS.items() for x in kv])
    return F.try_element_at(table, F.lower(one_line(title)))


def citation_numbers(text: Column) -> Column:
    """FN33: for each [[label]] of an answer its number, counted by first mention."""
    labels = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    order = F.array_distinct(labels)
    return F.transform(labels, lambda x: F.array_position(order, x).cast("int"))


def asks_documents(text: Column) -> Column:
    """FLT15: whether a question is about the asker's documents."""
    q = F.lower(F.trim(text))
    return F.coalesce(reduce(lambda a, b: a | b, [q.rlike(p) for p in ABOUT_DOCUMENTS]), F.lit(False))


def asks_table(text: Column) -> Column:
    """FLT15: whether it asks for a count, a sum or the like."""
    return F.coalesce(F.lower(text).rlike(ABOUT_TABLES), F.lit(False))


def asks_place(text: Column) -> Column:
    """FLT15: whether it asks where something is."""
    return F.coalesce(F.lower(text).rlike(ABOUT_PLACES), F.lit(False))


def plan_route(text: Column, n_docs: Column, folder: Column, strict: Column) -> tuple[Column, Column]:
    """SEA20: (route, first tool) of a question, by its words and the scope chosen: ``n_docs`` null where none was named."""
    n, scoped = F.coalesce(n_docs, F.lit(0)), (F.coalesce(n_docs, F.lit(0)) > 0) | folder.isNotNull()
    bound = F.coalesce(strict, scoped)
    one = (n == 1) & folder.isNull()
    search = "browse_documents"
    rules = [
        (F.trim(text) == "", "agent_fallback", None),
        (n_docs.isNotNull() & (n == 0) & folder.isNull(), "agent_fallback", None),
        (asks_table(text) & (scoped | asks_documents(text)), "table_aggregation", search),
        ((n > 0) & bound & one & asks_place(text), "selected_document", "search_within_document"),
        ((n > 0) & bound & one, "selected_document", "get_document_structure"),
        ((n > 0) & bound, "selected_document", search),
        (folder.isNotNull() & bound, "selected_folder", search),
        (scoped, "user_library", search),
        (asks_documents(text), "user_library", search),
    ]
    route, tool = F.lit("agent_fallback"), F.lit(None).cast("string")
    for when, r, t in reversed(rules):
        route, tool = F.when(when, r).otherwise(route), F.when(when, F.lit(t).cast("string")).otherwise(tool)
    return route, tool


def sufficient(evidence: DataFrame, key: str) -> DataFrame:
    """FLT17: whether any entry of a run is evidence: by its tool, or as a page that can be read."""
    text = first_present(F.col("text"), F.col("snippet")).isNotNull()
    page = (F.col("tool") == "get_page_content") & (text | (F.coalesce(~F.col("visual"), F.lit(True)) & F.coalesce("told", F.lit(False))))
    return evidence.groupBy(key).agg(F.coalesce(F.bool_or(F.col("tool").isin(*EVIDENT) | page), F.lit(False)).alias("sufficient"))


def rank_candidates(candidates: DataFrame, key: str) -> DataFrame:
    """SRT05: candidates by score, then hint, then source."""
    w = W.partitionBy(key).orderBy(F.col("score").desc(), F.col("hint").desc(), "source")
    return candidates.withColumn("place", F.row_number().over(w))


def structure_key(structure: Column) -> Column:
    """SRT07: the numbers of a dotted structure, which order by number and not as text."""
    return F.transform(F.split(structure, "[.]"), lambda x: x.try_cast("int"))


def keep_first(items: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """SET09: the first item of each structure; items without one all stay."""
    i = F.row_number().over(W.partitionBy(key, by).orderBy(order))
    return items.withColumn("__i", i).where((F.col("__i") == 1) | F.col(by).isNull() | (F.col(by) == "")).drop("__i")


def merge_sources(items: DataFrame, noisy: Column, key: str, most: float = 0.2) -> DataFrame:
    """SET13: bookmarks and links together, but links with more than ``most`` of noise are left out where there are bookmarks."""
    w = W.partitionBy(key)
    share = F.avg(F.when(F.col("source") == "links", noisy.cast("double"))).over(w)
    other = F.max((F.col("source") == "bookmarks").cast("int")).over(w) == 1
    return items.withColumn("__s", share).withColumn("__o", other).where((F.col("source") != "links") | ~F.col("__o") | (F.col("__s") <= most)).drop("__s", "__o")


def page_features(lines: DataFrame, key: list[str], width: float, height: float) -> DataFrame:
    """AGG19: of a page's lines (x0, y0, x1, y1, text) their count, height, density, numbers at the right, and a contents score."""
    tall, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    word = F.coalesce(F.bool_or(F.lower("text").rlike("目录|contents")), F.lit(False))
    right = F.count_if(F.col("text").rlike(r"\d{1,4}\s*$") & (F.col("x1") >= 0.65 * width))
    d = lines.groupBy(*key).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.median(F.when(tall > 0, tall)).alias("median_height"),
        F.round(F.least(F.lit(1.0), F.sum(F.greatest(F.lit(0.0), tall * wide)) / (width * height)), 6).alias("density"),
        F.round(F.avg((F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) <= 0.12 * width).cast("double")), 6).alias("centered"),
        right.alias("right_numbers"),
        word.alias("named"),
    )
    score = F.when(F.col("named"), 0.45).otherwise(0.0) + F.least(F.lit(0.35), F.col("right_numbers") * 0.18) + F.when(F.col("line_count") >= 3, 0.15).otherwise(0.0)
    return d.withColumn("toc_score", F.round(F.least(F.lit(1.0), score), 4)).drop("named")


def best_ranges(nodes: DataFrame, key: list[str]) -> DataFrame:
    """ADD03: of catalog nodes with the same title the one with the best range: a valid one, then the narrowest, then the first."""
    ok = (F.col("start_page") >= 1) & (F.col("end_page") >= F.col("start_page"))
    w = W.partitionBy(*key, title_key(F.col("title"))).orderBy(ok.desc(), F.col("end_page") - F.col("start_page"), "ord")
    return nodes.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def should_retry(requested: Column, initial: Column, final: Column, reasons: Column) -> Column:
    """ADD06: whether a fast attempt with faults is tried again in balanced mode."""
    return (F.size(reasons) > 0) & requested.isin("smart", "fast") & (initial == "fast") & (final == "fast")


def may_retain(path: Column, source: Column, initial: Column, final: Column, reasons: Column) -> Column:
    """ADD06: whether a candidate may stay after a failed retry: embedded contents whose only faults are long leaves."""
    mild = F.forall(reasons, lambda r: r.rlike("unexpanded_long_leaf_after_expansion|visible_no_page_long_chapter_without_children"))
    grave = F.exists(reasons, lambda r: r.rlike("^(content_mapping:|(balanced_quality_gate|quality_report):(invalid_page_range|page_out_of_range)|quality_report:(toc_content_mapping_failed|toc_page_leakage|collapsed_single_entry))"))
    return (F.size(reasons) > 0) & (path == "embedded_toc") & (source == "code_toc") & (initial == "fast") & (final == "fast") & mild & ~grave


def valid_anchor(page: Column, box: Column, path: Column, said: Column, snippet: Column) -> tuple[Column, Column]:
    """ADD12: (type, whether it had to fall back): a page with a box of four, else a path, else a snippet of its own or the binding's."""
    pdf, md = (page >= 1) & (F.size(box) == 4), F.size(path) > 0
    own = F.trim(said) != ""
    kind = F.when(F.coalesce(pdf, F.lit(False)), "pdf_anchor").when(F.coalesce(md, F.lit(False)), "md_anchor").otherwise("snippet_fallback")
    return kind, (kind == "snippet_fallback") & ~F.coalesce(own, F.lit(False))


def ordered_capabilities(names: Column) -> Column:
    """ADD13: capabilities by their usual names, with what they imply, each once and in order; unknown ones go."""
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    plain = F.transform(names, lambda n: F.regexp_replace(F.lower(F.trim(n)), "[- ]", "_"))
    known = F.transform(plain, lambda n: F.coalesce(F.try_element_at(table, n), n))
    has = lambda *xs: F.arrays_overlap(known, F.array(*map(F.lit, xs)))
    more = F.when(has("ocr"), F.array(F.lit("llm"), F.lit("vision"))).when(has("vision"), F.array(F.lit("llm"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(known, more)
    return F.filter(F.array(*map(F.lit, CAPABILITIES)), lambda c: F.array_contains(every, c))


def page_vote(verdict: Column, confidence: Column, kind: Column) -> tuple[Column, Column, Column]:
    """ADD16: (whether a page is contents, score, kind) from a model's answer: yes, true and 1 say so; scores stay within 0 and 1."""
    yes = F.coalesce(F.lower(F.trim(verdict)).isin("yes", "true", "1"), F.lit(False))
    told = confidence.try_cast("double")
    score = F.when(told.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), told))).otherwise(yes.cast("double"))
    known = F.when(kind.isin("main_toc", "figure_catalog", "table_catalog", "other_toc"), kind).when(kind.isNull() | (kind == "mixed_toc") | (kind == ""), "main_toc").otherwise("other_toc")
    return yes, score, F.when(yes, known).otherwise("none")


def cache_key(*parts: Column) -> Column:
    """PRJ08: a key of named parts, null ones empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def carry_heading(lines: DataFrame, key: str, order: str, kind: Column) -> DataFrame:
    """WIN13: each line with the catalog whose heading came last before it; ``main`` before the first."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("catalog", F.coalesce(F.last(kind, ignorenulls=True).over(w), F.lit("main")))


# --- queries -------------------------------------------------------------------------------------------------------

_KEY = r"lower(regexp_replace(title, '[\s\p{P}]+', '', 'g'))"


@query("fn03_title_key", rf"WITH {TOC} SELECT doc_id, ord, {_KEY} AS key FROM ti")
def _fn03(spark, d):
    return toc_items(spark, d).select("doc_id", "ord", title_key(F.col("title")).alias("key"))


@query("fn04_spaces", r"SELECT page_id, regexp_replace(html, '\s+', '', 'g') AS squeezed, trim(regexp_replace(html, '\s+', ' ', 'g')) AS line FROM pages")
def _fn04(spark, d):
    return load(spark, d, "pages").select("page_id", squeezed(F.col("html")).alias("squeezed"), one_line(F.col("html")).alias("line"))


_GRAM = lambda n: f"CASE WHEN length(n_name) >= {n} THEN list_transform(range(1, length(n_name) - {n} + 2), lambda i: n_name[i:i + {n} - 1]) ELSE [] END"


@query("fn08_chunks", f"SELECT n_nationkey, array_to_string({_GRAM(4)} || {_GRAM(3)} || {_GRAM(2)}, '|') AS chunks FROM nation")
def _fn08(spark, d):
    return load(spark, d, "nation").select("n_nationkey", F.array_join(chunks(F.col("n_name")), "|").alias("chunks"))


_SLIDE = "CASE c_custkey % 5 WHEN 0 THEN '幻灯片 ' || c_custkey || ': ' || c_name WHEN 1 THEN 'SLIDE ' || c_custkey || '  -  ' || c_name WHEN 2 THEN 'Default Section' WHEN 3 THEN 'Page 7' ELSE ' ' || c_name END"


@query("fn12_slide_title", rf"WITH s AS (SELECT c_custkey, {_SLIDE} AS t FROM customer), c AS (SELECT c_custkey, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM s) SELECT c_custkey, CASE WHEN lower(t) IN ('默认节', 'default section') THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(t, '^\s*幻灯片\s*\d+\s*[:：-]?\s*', ''), '^\s*(?i:slide)\s*\d+\s*[:：-]?\s*', ''), '^\s*(?i:page)\s*\d+\s*[:：-]?\s*', '')) END AS title FROM c")
def _fn12(spark, d):
    return load(spark, d, "customer").select("c_custkey", slide_title(F.expr(_SLIDE)).alias("title"))


_UNIT = "CASE c_custkey % 7 WHEN 0 THEN 'Pages' WHEN 1 THEN 'lines' WHEN 2 THEN 'rows' WHEN 3 THEN 'Paragraph' WHEN 4 THEN 'slides' WHEN 5 THEN '页' ELSE 'Sheet' END"


@query("fn14_position", rf"WITH s AS (SELECT c_custkey, lower({_UNIT}) AS u, c_phone_like FROM (SELECT *, c_name || '/' || c_custkey AS c_phone_like FROM customer)) SELECT c_custkey, CASE WHEN u IN ('page', 'pages', '页') THEN 'p' WHEN u = 'lines' THEN 'line' WHEN u = 'rows' THEN 'row' WHEN u IN ('paragraph', 'paragraphs') THEN 'para' WHEN u = 'slides' THEN 'slide' ELSE u END AS unit, CASE WHEN regexp_extract(c_phone_like, '(\d+)', 1) = '' THEN 0 ELSE greatest(1, CAST(regexp_extract(c_phone_like, '(\d+)', 1) AS INT)) END AS number FROM s")
def _fn14(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", position_unit(F.expr(_UNIT)).alias("unit"), first_number(F.expr("c_name || '/' || c_custkey")).alias("number"))


@query("fn17_readable", f"WITH {PAGES} SELECT doc_id, page, CASE WHEN length(text) > 0 THEN round((length(text) - length(regexp_replace(text, '{READABLE.replace(chr(39), chr(39) * 2)}', '', 'g'))) / length(text), 6) ELSE 0 END AS ratio FROM pg")
def _fn17(spark, d):
    return page_text(spark, d).select("doc_id", "page", readable_ratio(F.col("text")).alias("ratio"))


@query("fn25_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CAST(greatest(0, ceil((epoch(CAST(ts + INTERVAL 15 MINUTE AS TIMESTAMP)) // 1 - epoch(ts + INTERVAL (event_id % 1200) SECOND) // 1) / 60)) AS INT) AS minutes FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def _fn25(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.date_trunc("second", "ts"))
    now, until = F.expr("ts + make_dt_interval(0, 0, 0, event_id % 1200)"), F.expr("ts + INTERVAL 15 MINUTE")
    return e.select("event_id", iso(F.col("ts")).alias("at"), minutes_left(now.cast("timestamp"), until.cast("timestamp")).alias("minutes"))


@query("fn26_citation", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, 'unknown') AS label FROM customer")
def _fn26(spark, d):
    return load(spark, d, "customer").select("c_custkey", first_present(F.expr("if(c_custkey % 3 = 0, c_name, ' ')"), F.expr("if(c_custkey % 5 > 0, c_mktsegment, '')"), F.lit("unknown")).alias("label"))


@query("fn28_arguments", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{\"value\":\"' || event_type || '\"}' ELSE '{}' END AS arguments FROM events")
def _fn28(spark, d):
    return load(spark, d, "events").select("event_id", as_arguments(F.expr("case event_id % 3 when 0 then props when 1 then event_type end")).alias("arguments"))


@query("fn29_unique", f"WITH {TOC}, t AS (SELECT doc_id, list(split_part(title, ' ', 1) ORDER BY ord) AS l FROM ti GROUP BY 1) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS firsts FROM t")
def _fn29(spark, d):
    t = toc_items(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.split_part("title", F.lit(" "), F.lit(1)).alias("w")))).alias("l"))
    return t.select("doc_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x.w)), "|").alias("firsts"))


_CATALOG = "CASE c_custkey % 5 WHEN 0 THEN ' Contents ' WHEN 1 THEN '图目录' WHEN 2 THEN 'List of  tables' WHEN 3 THEN '目录' ELSE c_name END"


@query("fn31_catalog", rf"SELECT c_custkey, CASE lower(trim(regexp_replace({_CATALOG}, '\s+', ' ', 'g'))) WHEN 'contents' THEN 'main' WHEN '目录' THEN 'main' WHEN 'list of figures' THEN 'figure' WHEN '图目录' THEN 'figure' WHEN 'list of tables' THEN 'table' WHEN '表目录' THEN 'table' END AS kind FROM customer")
def _fn31(spark, d):
    return load(spark, d, "customer").select("c_custkey", catalog_kind(F.expr(_CATALOG)).alias("kind"))


_CITED = "'see [[b p.' || (turn % 3) || ']] and [[a]] then [[b p.' || (conv_id % 3) || ']]'"


@query("fn33_numbers", rf"WITH l AS (SELECT conv_id, turn, regexp_extract_all({_CITED}, '\[\[([^\]]+)\]\]', 1) AS l FROM conversations), u AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM l) SELECT conv_id, turn, array_to_string(list_transform(l, lambda x: list_position(u, x)), ',') AS numbers FROM u")
def _fn33(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(citation_numbers(F.expr(_CITED)).cast("array<string>"), ",").alias("numbers"))


_ASKED = "CASE turn % 6 WHEN 0 THEN 'In my files, where is ' || text WHEN 1 THEN 'What is the total of all documents?' WHEN 2 THEN '上传的文件在哪' WHEN 3 THEN 'Count them' WHEN 4 THEN '' ELSE text END"
_DOCS = "(" + " OR ".join(f"regexp_matches(lower(trim(q)), '{p}')" for p in ABOUT_DOCUMENTS) + ")"
_TABLE, _PLACE = f"regexp_matches(lower(q), '{ABOUT_TABLES}')", f"regexp_matches(lower(q), '{ABOUT_PLACES}')"


@query("flt15_asks", f"WITH a AS (SELECT conv_id, turn, {_ASKED} AS q FROM conversations) SELECT conv_id, turn, coalesce({_DOCS}, false) AS documents, coalesce({_TABLE}, false) AS tables, coalesce({_PLACE}, false) AS places FROM a")
def _flt15(spark, d):
    q = F.expr(_ASKED)
    return load(spark, d, "conversations").select("conv_id", "turn", asks_documents(q).alias("documents"), asks_table(q).alias("tables"), asks_place(q).alias("places"))


@query("sea20_plan", f"""WITH a AS (SELECT conv_id, turn, {_ASKED} AS q, CASE conv_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS n, CASE WHEN turn % 4 = 3 THEN 'f' END AS folder, CASE WHEN turn % 5 = 2 THEN false END AS strict FROM conversations WHERE text IS NOT NULL),
b AS (SELECT *, coalesce(n, 0) > 0 OR folder IS NOT NULL AS scoped, coalesce(strict, coalesce(n, 0) > 0 OR folder IS NOT NULL) AS bound FROM a),
c AS (SELECT *, CASE WHEN trim(q) = '' OR (n = 0 AND folder IS NULL) THEN 0 WHEN {_TABLE} AND (scoped OR {_DOCS}) THEN 1 WHEN n = 1 AND folder IS NULL AND bound AND {_PLACE} THEN 2 WHEN n = 1 AND folder IS NULL AND bound THEN 3 WHEN n > 0 AND bound THEN 4 WHEN folder IS NOT NULL AND bound THEN 5 WHEN scoped OR {_DOCS} THEN 6 ELSE 0 END AS k FROM b)
SELECT conv_id, turn, ['agent_fallback', 'table_aggregation', 'selected_document', 'selected_document', 'selected_document', 'selected_folder', 'user_library'][k + 1] AS route, [NULL, 'browse_documents', 'search_within_document', 'get_document_structure', 'browse_documents', 'browse_documents', 'browse_documents'][k + 1] AS tool FROM c""")
def _sea20(spark, d):
    c = load(spark, d, "conversations").where("text is not null")
    route, tool = plan_route(F.expr(_ASKED), F.expr("case conv_id % 4 when 1 then 0 when 2 then 1 when 3 then 2 end"), F.expr("if(turn % 4 = 3, 'f', null)"), F.expr("if(turn % 5 = 2, false, null)"))
    return c.select("conv_id", "turn", route.alias("route"), tool.alias("tool"))


@query("flt17_sufficient", "WITH e AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN 'browse_documents' WHEN 1 THEN 'get_page_content' ELSE 'get_document_structure' END AS tool, CASE WHEN (conv_id + turn) % 4 = 1 THEN ' ' ELSE text END AS text, conv_id % 2 = 0 AS visual, turn % 2 = 1 AS told FROM conversations WHERE turn < conv_id % 4) SELECT conv_id, coalesce(bool_or(tool = 'get_page_content' AND (coalesce(trim(text) <> '', false) OR (NOT visual AND told))), false) AS sufficient FROM e GROUP BY 1")
def _flt17(spark, d):
    e = load(spark, d, "conversations").where("turn < conv_id % 4")
    e = e.selectExpr("conv_id", "case turn % 3 when 0 then 'browse_documents' when 1 then 'get_page_content' else 'get_document_structure' end as tool", "if((conv_id + turn) % 4 = 1, ' ', text) as text", "cast(null as string) as snippet", "conv_id % 2 = 0 as visual", "turn % 2 = 1 as told")
    return sufficient(e, "conv_id")


@query("srt05_candidates", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber % 2 DESC, l_linestatus || l_linenumber) AS place FROM lineitem")
def _srt05(spark, d):
    c = load(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount as score", "l_linenumber % 2 as hint", "l_linestatus || l_linenumber as source")
    return rank_candidates(c, "l_orderkey").select("l_orderkey", "l_linenumber", "place")


@query("srt07_outline_order", f"WITH {TOC} SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page // 9, list_transform(string_split(structure, '.'), lambda x: CAST(x AS INT)) DESC, ord) AS place FROM ti")
def _srt07(spark, d):
    w = W.partitionBy("doc_id").orderBy(F.expr("page div 9"), structure_key(F.col("structure")).desc(), "ord")
    return toc_items(spark, d).select("doc_id", "ord", F.row_number().over(w).alias("place"))


@query("set09_structures", f"WITH {TOC}, s AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 4 THEN '' ELSE CAST(level AS VARCHAR) END AS s FROM ti) SELECT doc_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY ord) AS i FROM s) WHERE i = 1 OR s = ''")
def _set09(spark, d):
    t = toc_items(spark, d).withColumn("s", F.expr("if(ord % 5 = 4, '', cast(level as string))"))
    return keep_first(t, "doc_id", "s", "ord").select("doc_id", "ord")


@query("set13_sources", f"WITH {TOC}, s AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 0 AND doc_id % 5 > 0 THEN 'bookmarks' ELSE 'links' END AS source, length(title) < 14 AS noisy FROM ti), a AS (SELECT *, avg(CASE WHEN source = 'links' THEN noisy::INT END) OVER (PARTITION BY doc_id) AS share, bool_or(source = 'bookmarks') OVER (PARTITION BY doc_id) AS other FROM s) SELECT doc_id, ord, source FROM a WHERE source = 'bookmarks' OR NOT other OR share <= 0.2")
def _set13(spark, d):
    t = toc_items(spark, d).withColumn("source", F.expr("if(ord % 2 = 0 and doc_id % 5 > 0, 'bookmarks', 'links')"))
    return merge_sources(t, F.length("title") < 14, "doc_id").select("doc_id", "ord", "source")


_LINES = "doc_id, page div 4 AS p, CAST(page % 7 * 40 AS DOUBLE) AS x0, CAST(page * 12 AS DOUBLE) AS y0, CAST(page % 7 * 40 + 250 AS DOUBLE) AS x1, CAST(page * 12 + page % 5 AS DOUBLE) AS y1, CASE page % 6 WHEN 0 THEN 'Contents' WHEN 1 THEN text || ' 12' ELSE text END AS text"


@query("agg19_layout", rf"WITH {PAGES}, l AS (SELECT {_LINES.replace(' div ', ' // ')} FROM pg), a AS (SELECT doc_id, p, count(*) AS line_count, median(CASE WHEN y1 > y0 THEN y1 - y0 END) AS median_height, round(least(1.0, sum(greatest(0.0, (y1 - y0) * (x1 - x0))) / 480000.0), 6) AS density, round(avg((abs((x0 + x1) / 2 - 300) <= 72)::INT), 6) AS centered, count(*) FILTER (regexp_matches(text, '\d{{1,4}}\s*$') AND x1 >= 390) AS right_numbers, bool_or(regexp_matches(lower(text), '目录|contents')) AS named FROM l GROUP BY 1, 2) SELECT doc_id, p, line_count, median_height, density, centered, right_numbers, round(least(1.0, CASE WHEN named THEN 0.45 ELSE 0 END + least(0.35, right_numbers * 0.18) + CASE WHEN line_count >= 3 THEN 0.15 ELSE 0 END), 4) AS toc_score FROM a")
def _agg19(spark, d):
    lines = page_text(spark, d).selectExpr(*[x.strip() for x in _LINES.split(", ")])
    return page_features(lines, ["doc_id", "p"], 600.0, 800.0)


@query("add03_best_ranges", f"WITH {TOC}, n AS (SELECT doc_id, ord, level, CASE WHEN ord % 3 = 0 THEN 'Fig. 1' ELSE 'fig 1' END AS title, page AS s, page + 5 - 3 * (ord % 3) AS e FROM ti) SELECT doc_id, level, ord, s AS start_page, e AS end_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY (s >= 1 AND e >= s) DESC, e - s, ord) AS i FROM n) WHERE i = 1")
def _add03(spark, d):
    n = toc_items(spark, d).selectExpr("doc_id", "ord", "level", "if(ord % 3 = 0, 'Fig. 1', 'fig 1') as title", "page as start_page", "page + 5 - 3 * (ord % 3) as end_page")
    return best_ranges(n, ["doc_id", "level"]).select("doc_id", "level", "ord", "start_page", "end_page")


_FAULT = "CASE c_custkey % 4 WHEN 0 THEN 'gate:unexpanded_long_leaf_after_expansion:2' WHEN 1 THEN 'quality_report:toc_page_leakage' WHEN 2 THEN 'content_mapping:unexpanded_long_leaf_after_expansion' END"
_MODE = "CASE WHEN c_custkey % 3 = 0 THEN 'balanced' ELSE 'fast' END"


@query("add06_retry", f"WITH r AS (SELECT c_custkey, {_FAULT} AS f, {_MODE} AS m FROM customer) SELECT c_custkey, f IS NOT NULL AND m = 'fast' AS retry, coalesce(f LIKE 'gate:%', false) AND m = 'fast' AS retain FROM r")
def _add06(spark, d):
    reasons = F.filter(F.array(F.expr(_FAULT)), lambda x: x.isNotNull())
    fast = F.expr(_MODE)
    return load(spark, d, "customer").select("c_custkey", should_retry(F.lit("smart"), F.lit("fast"), fast, reasons).alias("retry"), may_retain(F.lit("embedded_toc"), F.lit("code_toc"), F.lit("fast"), fast, reasons).alias("retain"))


@query("add07_trace", f"WITH {TOC} SELECT doc_id, ord, 'page' AS unit, page AS start_page, page AS end_page, 'p.' || page AS label, 'structure' AS found_by FROM ti")
def _add07(spark, d):
    """ADD07: what a hit is traced by: its place, a label of it, and what found it."""
    p = F.col("page")
    return toc_items(spark, d).select("doc_id", "ord", F.lit("page").alias("unit"), p.alias("start_page"), p.alias("end_page"), F.concat(F.lit("p."), p.cast("string")).alias("label"), F.lit("structure").alias("found_by"))


@query("add10_candidates", "WITH f AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey % 4) AS s, list(l_partkey % 4 + 1 ORDER BY l_linenumber, l_suppkey, l_partkey % 4) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS documents, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i)[1:5], ',') AS pages FROM f")
def _add10(spark, d):
    """ADD10: documents and up to five pages that nested results name, each once, in order."""
    nested = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array("l_suppkey").alias("s"), F.array(F.expr("l_partkey % 4 + 1")).alias("p")))).alias("r"))
    some = lambda f: F.array_distinct(F.flatten(F.transform("r", f))).cast("array<string>")
    return nested.select("l_orderkey", F.array_join(some(lambda x: x.s), ",").alias("documents"), F.array_join(F.slice(some(lambda x: x.p), 1, 5), ",").alias("pages"))


@query("add11_registry", f"WITH {FILES}, w AS (SELECT o_custkey AS id, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i, o_orderpriority FROM orders), k AS (SELECT w.*, name, folder_id FROM w JOIN fi USING (id) WHERE folder_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY i) AS place FROM k) SELECT o_orderpriority, place, id, folder_id || '/' || name AS path FROM r WHERE place <= 8")
def _add11(spark, d):
    """ADD11: of each list of chosen ids the first eight that are in scope, in the order given, with their paths."""
    ids = load(spark, d, "orders").groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("ids"))
    one = ids.select("o_orderpriority", F.posexplode("ids").alias("i", "x")).select("o_orderpriority", "i", F.col("x.o_custkey").alias("id"))
    k = one.join(files(spark, d).where("folder_id is not null"), "id")
    k = k.withColumn("place", F.row_number().over(W.partitionBy("o_orderpriority").orderBy("i"))).where("place <= 8")
    return k.select("o_orderpriority", "place", "id", F.concat_ws("/", "folder_id", "name").alias("path"))


@query("add12_anchors", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'pdf_anchor' WHEN c_custkey % 4 = 1 THEN 'md_anchor' ELSE 'snippet_fallback' END AS kind, c_custkey % 4 = 3 AS fell_back FROM customer")
def _add12(spark, d):
    box, path = F.expr("if(c_custkey % 4 = 0, array(1, 2, 3, 4), array(1, 2))"), F.expr("if(c_custkey % 4 = 1, array('a'), null)")
    kind, fell = valid_anchor(F.lit(3), box, path, F.expr("if(c_custkey % 4 = 2, 'said', ' ')"), F.col("c_name"))
    return load(spark, d, "customer").select("c_custkey", kind.alias("kind"), fell.alias("fell_back"))


@query("add13_capabilities", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'llm,vision' WHEN 1 THEN 'llm,vision,ocr,tool_calling' WHEN 2 THEN 'embedding,reasoning' ELSE '' END AS names FROM customer")
def _add13(spark, d):
    told = F.expr("case c_custkey % 4 when 0 then array('VLM') when 1 then array('Function-Calling', 'ocr', 'tools') when 2 then array(' thinking', 'text embedding') else array('other') end")
    return load(spark, d, "customer").select("c_custkey", F.array_join(ordered_capabilities(told), ",").alias("names"))


@query("add16_votes", "WITH v AS (SELECT c_custkey, c_custkey % 3 < 2 AS yes, CASE c_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 END AS s, c_custkey % 4 AS k FROM customer) SELECT c_custkey, yes, CAST(coalesce(s, yes::INT) AS DOUBLE) AS score, CASE WHEN NOT yes THEN 'none' WHEN k = 0 THEN 'table_catalog' WHEN k = 3 THEN 'other_toc' ELSE 'main_toc' END AS kind FROM v")
def _add16(spark, d):
    yes, score, kind = page_vote(
        F.expr("case c_custkey % 3 when 0 then ' Yes' when 1 then 'TRUE' else 'no' end"),
        F.expr("case c_custkey % 5 when 0 then '7' when 1 then '-1' when 2 then '0.25' when 3 then 'high' end"),
        F.expr("case c_custkey % 4 when 0 then 'table_catalog' when 1 then 'mixed_toc' when 2 then null else 'strange' end"),
    )
    return load(spark, d, "customer").select("c_custkey", yes.alias("yes"), score.alias("score"), kind.alias("kind"))


@query("add17_visual_pages", f"WITH {PAGES}, a AS (SELECT doc_id, list_filter([1, 4, 6], lambda x: x <= count(*)) AS ocr, list_filter([2, 4], lambda x: x <= count(*)) AS img FROM pg GROUP BY 1) SELECT pg.doc_id, page, (list_contains(img, page))::INT AS images, list_contains(img, page) OR list_contains(ocr, page) AS visual FROM pg JOIN a USING (doc_id)")
def _add17(spark, d):
    """ADD17: a document's images on a page, and whether the page needs to be looked at: it has one, or was recognized."""
    p = page_text(spark, d)
    marks = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).selectExpr("doc_id", "filter(array(1, 4, 6), x -> x <= n) as ocr", "transform(filter(array(2, 4), x -> x <= n), x -> named_struct('page', x, 'ref', 'i' || x)) as img")
    j = p.join(marks, "doc_id")
    mine = F.filter("img", lambda x: x.page == F.col("page"))
    return j.select("doc_id", "page", F.size(mine).alias("images"), ((F.size(mine) > 0) | F.array_contains("ocr", F.col("page"))).alias("visual"))


@query("add19_appendix", f"WITH {TOC} SELECT pg.doc_id, pg.page FROM pg WHERE NOT EXISTS (SELECT 1 FROM ti WHERE ti.doc_id = pg.doc_id AND pg.page = ti.page) AND page % 3 = 2")
def _add19(spark, d):
    """ADD19: pages that no section has and whose title is one of an appendix."""
    p = page_text(spark, d).withColumn("title", F.expr("if(page % 3 = 2, 'Appendix', text)"))
    return p.join(toc_items(spark, d).select("doc_id", "page"), ["doc_id", "page"], "left_anti").where(F.trim("title").isin("Appendix", "附录", "Thank you")).select("doc_id", "page")


@query("prj08_cache_keys", f"WITH {TOC} SELECT doc_id, sha1(doc_id || '|ocr|' || string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) || '|') AS key FROM ti GROUP BY 1")
def _prj08(spark, d):
    t = toc_items(spark, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("page")).cast("array<string>"), ",").alias("p"))
    return t.select("doc_id", cache_key(F.col("doc_id"), F.lit("ocr"), F.col("p"), F.lit(None)).alias("key"))


@query("win13_context", f"WITH {PAGES} SELECT doc_id, page, coalesce(last_value(CASE page % 6 WHEN 2 THEN 'figure' WHEN 5 THEN 'table' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING), 'main') AS catalog FROM pg")
def _win13(spark, d):
    p = page_text(spark, d).withColumn("text", F.expr("case page % 6 when 2 then 'List of Figures' when 5 then '表目录' else 'x' end"))
    return carry_heading(p, "doc_id", "page", catalog_kind(F.col("text"))).select("doc_id", "page", "catalog")
