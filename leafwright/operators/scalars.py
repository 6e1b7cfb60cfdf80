"""Scalar functions: numbers, names, page requests, labels and the predicates of retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import FILES, PAGES, TOC, files, page_text, toc_items
from ..sources.tables import load
from .text import tokens

MOST_PAGES = 10
#: The digits of Chinese numerals.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def positive_int(value: Column) -> Column:
    """FN20: a string of digits as a positive integer; null for anything else."""
    n = F.when(F.trim(value).rlike(r"^[0-9]{1,18}$"), F.trim(value).try_cast("long"))
    return F.when(n > 0, n)


def bounded(value: Column) -> Column:
    """FN21: a number held between 0 and 1, 0 where it is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def chinese_number(text: Column) -> Column:
    """FN18: a Chinese numeral below one hundred, null where it is none or zero."""
    digit = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    t = F.trim(text)
    left, right = F.split(t, "十", 2)[0], F.get(F.split(t, "十", 2), F.lit(1))
    tens = F.when(left == "", 1).otherwise(F.coalesce(F.try_element_at(digit, left), F.lit(1)))
    plain = F.translate(t, "".join(NUMERALS), "".join(map(str, NUMERALS.values())))
    whole = F.when(plain.rlike("^[0-9]{1,9}$") & ~t.rlike("[0-9]"), plain.try_cast("int"))
    n = F.when(F.contains(t, F.lit("百")), None).when(F.contains(t, F.lit("十")), tens * 10 + F.coalesce(F.try_element_at(digit, right), F.lit(0))).otherwise(whole)
    return F.when(n > 0, n)


def count_with_k(value: Column) -> Column:
    """ADD14: ``32k`` as 32,000; separators are dropped."""
    t = F.regexp_replace(F.lower(F.trim(value)), ",", "")
    n = F.regexp_extract(t, "^([0-9]{1,15})k?$", 1).try_cast("long")
    return n * F.when(F.endswith(t, F.lit("k")), 1000).otherwise(1)


def strip_extension(name: Column) -> Column:
    """FN10: a name without its last suffix of up to eight letters or digits."""
    return F.regexp_replace(name, r"\.[A-Za-z0-9]{1,8}$", "")


def extension(name: Column) -> Column:
    """FN10: the lower-case suffix, empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,8})$", 1))


def safe_name(name: Column, most: int = 80) -> Column:
    """FN11: a name fit for any file system."""
    t = F.regexp_replace(F.trim(name), r"[^0-9A-Za-z._-]+", "_")
    t = F.regexp_replace(t, "^[._]+|[._]+$", "")
    return F.when(t == "", "file").otherwise(F.substring(t, 1, most))


def uppercase_ratio(line: Column) -> Column:
    """FN15: upper-case letters over letters, 0 without any."""
    letters = F.char_length(F.regexp_replace(line, r"\P{L}", ""))
    return F.coalesce(F.char_length(F.regexp_replace(line, r"\P{Lu}", "")) / F.nullif(letters, F.lit(0)), F.lit(0.0))


def overlap_of_left(left: Column, right: Column) -> Column:
    """FN24: shared tokens over those of the left side, 0 where either has none."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.size(left))


def file_size(n: Column) -> Column:
    """FN34: bytes in the largest unit that leaves one or more, one decimal."""
    k, m = 1024, 1024 * 1024
    return F.when(n < k, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < m, F.format_string("%.1f KB", F.round(n / k, 1))).otherwise(F.format_string("%.1f MB", F.round(n / m, 1)))


def short_hash(*parts: Column) -> Column:
    """FN30: the first 16 hex digits of the parts' SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def page_request(asked: Column, most: int = MOST_PAGES) -> Column:
    """FLT06: ``1-3,8`` as pages, in order and once each; null where a part is no page or runs down.

    Full-width commas and dashes count as plain ones. Of a range, ten times ``most`` pages are
    enough: fewer than ``most`` of them can have been named before.
    """
    parts = F.filter(F.transform(F.split(F.translate(asked, "，–—", ",--"), ","), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\d{1,9})", 1).try_cast("int").alias("a"), F.regexp_extract(x, r"(\d{1,9})$", 1).try_cast("int").alias("b")))
    good = F.forall(parts, lambda x: x.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$")) & F.forall(ends, lambda e: e.a <= e.b)
    pages = F.flatten(F.transform(ends, lambda e: F.sequence(e.a, F.least(e.b, e.a + 10 * most))))
    return F.when(good, F.slice(F.array_distinct(F.filter(pages, lambda p: p > 0)), 1, most))


def page_label(pages: Column) -> Column:
    """WIN10: ascending pages as ``1-3,8``."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))

    def closed(s):
        part = F.when(s.a == s.b, s.a.cast("string")).otherwise(F.concat_ws("-", s.a.cast("string"), s.b.cast("string")))
        return F.when(s.a.isNull(), s.out).when(s.out == "", part).otherwise(F.concat_ws(",", s.out, part))

    def step(s, p):
        joins = F.coalesce(p == s.b + 1, F.lit(False))
        return F.struct(F.when(joins, s.out).otherwise(closed(s)).alias("out"), F.when(joins, s.a).otherwise(p).alias("a"), p.alias("b"))

    return F.aggregate(pages, start, step, closed)


def pages_in_label(label: Column) -> Column:
    """AGG23: how many pages a label such as ``1-3,8`` names."""
    parts = F.filter(F.split(label, ","), lambda x: x.rlike(r"^\d{1,9}(-\d{1,9})?$"))
    return F.aggregate(parts, F.lit(0), lambda n, x: n + F.regexp_extract(x, r"(\d+)$", 1).cast("int") - F.regexp_extract(x, r"^(\d+)", 1).cast("int") + 1)


def failure_code(message: Column) -> Column:
    """PRJ15: ``PREFIX: …`` as a lower-case code, ``indexing`` without one."""
    prefix = F.regexp_extract(F.coalesce(message, F.lit("")), r"^\s*([A-Z_]+)\s*:", 1)
    return F.when(F.contains(message, F.lit("OCR_ROUTE_NOT_CONFIGURED")), "ocr_not_configured").when(prefix != "", F.lower(prefix)).otherwise("indexing")


def expand_query(query_text: Column) -> Column:
    """FLT18: one word shorter than 12 characters is worth expanding."""
    q = F.coalesce(F.trim(query_text), F.lit(""))
    return (q != "") & ~F.contains(q, F.lit(" ")) & (F.char_length(q) < 12)


def control_garbled(text: Column, most: float = 0.15) -> Column:
    """FLT08: more than ``most`` replacement or control characters, tabs and line ends apart."""
    bad = F.char_length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]", ""))
    return F.coalesce(bad / F.nullif(F.char_length(text), F.lit(0)) > most, F.lit(False))


def noise_title(title: Column) -> Column:
    """FLT09: numbers only, or shorter than 2 or longer than 120 characters."""
    t = F.coalesce(F.trim(title), F.lit(""))
    return t.rlike(r"^[0-9\s.+±-]*$") | ~F.char_length(t).between(2, 120)


def snippet(text: Column, focus: Column, radius: int = 48) -> Column:
    """SEA11: the text around the first match, cut ends marked; its start without a match."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.instr(F.lower(t), F.lower(focus)) - 1
    a = F.greatest(F.lit(0), at - radius)
    b = F.least(F.char_length(t), at + F.char_length(focus) + radius)
    found = F.concat(F.when(a > 0, "...").otherwise(""), F.substr(t, a + 1, b - a), F.when(b < F.char_length(t), "...").otherwise(""))
    return F.when((at < 0) | (focus == ""), F.substring(t, 1, 2 * radius)).otherwise(found)


def tier(task: Column, tokens_in: Column, vision: Column, complexity: Column, most: int = 4000) -> Column:
    """HOOK5: the model tier of a call."""
    return F.when(vision | (task == "vision") | (complexity == "complex") | (tokens_in >= most), "plus").otherwise("flash")


def bounded_range(start: Column, end: Column, most: int) -> Column:
    """INT05: (start, end) from 1 upwards, in order, ``most`` units at the most."""
    a = F.greatest(F.lit(1), F.coalesce(start, F.lit(1)))
    b = F.greatest(a, F.coalesce(end, a))
    return F.struct(a.alias("start"), F.least(b, a + most - 1).alias("end"))


def heading_structure(title: Column) -> Column:
    """TOC06: ``Chapter 3`` as 3, ``3.2 …`` as 3.2 and ``Appendix B`` as A2."""
    t = F.trim(title)
    chapter = F.regexp_extract(t, r"(?i)^chapter\s+(\d{1,3})\b", 1)
    han = chinese_number(F.regexp_extract(t, r"^第([零〇一二两三四五六七八九十]{1,3})章", 1))
    section, letter = F.regexp_extract(t, r"^(\d{1,2}\.\d{1,2})(\D|$)", 1), F.upper(F.regexp_extract(t, r"(?i)^appendix\s+([a-z])\b", 1))
    return F.when(chapter != "", chapter.cast("int").cast("string")).when(han.isNotNull(), han.cast("string")).when(section != "", section).when(letter != "", F.concat(F.lit("A"), (F.ascii(letter) - 64).cast("string")))


def progress(status: Column) -> Column:
    """FN35: percent done by status."""
    return F.when(status.isin("completed", "indexed"), 100).when(F.startswith(status, F.lit("failed")), 0).when(status == "processing:queued", 5).otherwise(50)


def parts_done(status: Column, stages: tuple = ("uploaded", "parsing", "outline", "index", "completed")) -> Column:
    """PRJ17: the five stages, each done, active or pending."""
    i = F.when(status == "completed", 5).when(status == "indexed", 4).when(F.startswith(status, F.lit("processing")), 1).otherwise(0)
    return F.array(*[F.concat(F.lit(s + ":"), F.when(i > n, "done").when(i == n, "active").otherwise("pending")) for n, s in enumerate(stages)])


@query("fn20_positive", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS BIGINT) END AS n FROM part")
def _fn20(spark, d):
    raw = F.expr("case p_partkey % 4 when 0 then '0' when 1 then concat(' ', p_size, ' ') when 2 then concat('-', p_size) else 'x' end")
    return load(spark, d, "part").select("p_partkey", positive_int(raw).alias("n"))


@query("fn21_bounded", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, s_acctbal / 5000)) END AS share FROM supplier")
def _fn21(spark, d):
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.lit("n/a")).otherwise((F.col("s_acctbal") / 5000).cast("string"))
    return load(spark, d, "supplier").select("s_suppkey", bounded(raw).alias("share"))


_HAN = "['一','二','三','四','五','六','七','八','九']"


@query("fn18_chinese", f"WITH k AS (SELECT DISTINCT p_size AS n FROM part), h AS (SELECT n, CASE WHEN n // 10 > 1 THEN {_HAN}[n // 10] ELSE '' END || CASE WHEN n >= 10 THEN '十' ELSE '' END || CASE WHEN n % 10 > 0 THEN {_HAN}[n % 10] ELSE '' END AS t FROM k) SELECT t AS numeral, CAST(n AS INT) AS number FROM h")
def _fn18(spark, d):
    n, han = F.col("p_size"), F.array(*[F.lit(x) for x in "一二三四五六七八九"])
    t = F.concat(F.when(n >= 20, F.get(han, F.expr("p_size div 10 - 1").cast("int"))).otherwise(""), F.when(n >= 10, "十").otherwise(""), F.when(n % 10 > 0, F.get(han, n % 10 - 1)).otherwise(""))
    return load(spark, d, "part").select("p_size").distinct().select(t.alias("numeral")).withColumn("number", chinese_number(F.col("numeral")).cast("int"))


@query("add14_counts", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) * 1000 ELSE 1000 + CAST(p_size AS BIGINT) END AS n FROM part")
def _add14(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size"), F.lit("K"))).otherwise(F.concat(F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0")))
    return load(spark, d, "part").select("p_partkey", count_with_k(raw).alias("n"))


@query("fn10_extension", "SELECT c_custkey, c_name AS stem, CASE c_custkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE '' END AS suffix FROM customer")
def _fn10(spark, d):
    c = load(spark, d, "customer").withColumn("n", F.concat("c_name", F.expr("case c_custkey % 3 when 0 then '.PDF' when 1 then '.docx' else '' end")))
    return c.select("c_custkey", strip_extension(F.col("n")).alias("stem"), extension(F.col("n")).alias("suffix"))


@query("fn11_safe", r"WITH t AS (SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name || ' / ' || p_brand), '[^0-9A-Za-z._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS t FROM part) SELECT p_partkey, t[1:80] AS name FROM t")
def _fn11(spark, d):
    return load(spark, d, "part").select("p_partkey", safe_name(F.concat_ws(" / ", "p_name", "p_brand")).alias("name"))


@query("fn15_uppercase", r"SELECT doc_id, round(length(regexp_replace(text, '\P{Lu}', '', 'g')) / length(regexp_replace(text, '\P{L}', '', 'g')), 6) AS ratio FROM documents WHERE regexp_matches(text, '\p{L}') UNION ALL SELECT doc_id, 0.0 FROM documents WHERE NOT regexp_matches(text, '\p{L}')")
def _fn15(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.round(uppercase_ratio(F.col("text")), 6).alias("ratio"))


@query("fn24_overlap", r"WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{4e00}-\x{9fff}]')) AS a, lead(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{4e00}-\x{9fff}]'))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END AS overlap FROM t WHERE b IS NOT NULL")
def _fn24(spark, d):
    t = load(spark, d, "conversations").withColumn("a", F.array_distinct(tokens(F.col("text")))).withColumn("b", F.expr("lead(a) over (partition by conv_id order by turn)"))
    return t.where("b is not null").select("conv_id", "turn", F.round(overlap_of_left(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("fn34_size", "SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024, 1)) ELSE printf('%.1f MB', round(b / 1048576, 1)) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey % 7 * 512 * o_orderkey AS BIGINT) AS b FROM orders)")
def _fn34(spark, d):
    return load(spark, d, "orders").select("o_orderkey", file_size(F.expr("o_orderkey % 7 * 512 * o_orderkey")).alias("size"))


@query("fn30_hash", f"WITH {PAGES} SELECT doc_id, page, substr(sha1(doc_id || '|' || page), 1, 16) AS key FROM pg")
def _fn30(spark, d):
    return page_text(spark, d).select("doc_id", "page", short_hash(F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("key"))


_ASK = "case p_partkey % 3 when 0 then concat(p_size, '-', p_size + 2, '，', p_size + 1, ', ', p_size + 9) when 1 then concat(p_size + 5, '–', p_size) else concat(p_size, ',x') end"


@query("flt06_pages", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || ',' || (p_size + 1) || ',' || (p_size + 2) || ',' || (p_size + 9) END AS pages FROM part")
def _flt06(spark, d):
    return load(spark, d, "part").withColumn("p", page_request(F.expr(_ASK))).select("p_partkey", F.when(F.col("p").isNotNull(), F.array_join("p", ",")).alias("pages"))


@query("win10_label", f"WITH {PAGES}, k AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM pg WHERE page % 5 <> 0), r AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM k GROUP BY doc_id, g) SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS label, CAST(sum(b - a + 1) AS INT) AS pages FROM r GROUP BY 1")
def _win10(spark, d):
    p = page_text(spark, d).where("page % 5 <> 0").groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("p"))
    return p.select("doc_id", page_label(F.col("p")).alias("label")).withColumn("pages", pages_in_label(F.col("label")))


@query("agg23_label_pages", "SELECT o_orderkey, 4 + CAST(o_orderkey % 5 AS INT) AS pages FROM orders")
def _agg23(spark, d):
    return load(spark, d, "orders").select("o_orderkey", pages_in_label(F.expr("concat(o_orderkey, '-', o_orderkey + 2 + o_orderkey % 5, ',9')")).alias("pages"))


@query("prj15_failure", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '_failed' WHEN 1 THEN 'indexing' ELSE 'ocr_not_configured' END AS code FROM events")
def _prj15(spark, d):
    m = F.expr("case event_id % 3 when 0 then concat(upper(event_type), '_FAILED: why') when 1 then 'no prefix here' else 'x OCR_ROUTE_NOT_CONFIGURED: y' end")
    return load(spark, d, "events").select("event_id", failure_code(m).alias("code"))


@query("flt18_expand", "SELECT p_partkey, NOT contains(p_name, ' ') AND length(p_name) < 12 AS worth FROM part UNION ALL SELECT -item_id, NOT contains(trim(text), ' ') AND length(trim(text)) < 12 AND trim(text) <> '' FROM benchmark")
def _flt18(spark, d):
    a = load(spark, d, "part").select("p_partkey", expand_query(F.col("p_name")).alias("worth"))
    return a.unionAll(load(spark, d, "benchmark").select(-F.col("item_id"), expand_query(F.col("text"))))


@query("flt08_control", "SELECT event_id, event_id % 5 > 1 AS garbled FROM events")
def _flt08(spark, d):
    return load(spark, d, "events").select("event_id", control_garbled(F.expr(r"concat('eight ch', repeat('\u0001', cast(event_id % 5 as int)), '\t')")).alias("garbled"))


@query("flt09_noise", rf"WITH {PAGES} SELECT doc_id, page, regexp_full_match(trim(t), '[0-9\s.+±-]*') OR length(trim(t)) NOT BETWEEN 2 AND 120 AS noise FROM (SELECT doc_id, page, CASE WHEN page % 4 = 0 THEN '2024.' || page ELSE text END AS t FROM pg)")
def _flt09(spark, d):
    t = F.when(F.col("page") % 4 == 0, F.concat(F.lit("2024."), F.col("page"))).otherwise(F.col("text"))
    return page_text(spark, d).select("doc_id", "page", noise_title(t).alias("noise"))


@query("sea11_snippet", r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), m AS (SELECT doc_id, t, instr(lower(t), 'the') - 1 AS i FROM t), k AS (SELECT *, greatest(0, i - 48) AS a, least(length(t), i + 51) AS b FROM m) SELECT doc_id, CASE WHEN i < 0 THEN t[1:96] ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || t[a + 1:b] || CASE WHEN b < length(t) THEN '...' ELSE '' END END AS snippet FROM k")
def _sea11(spark, d):
    return load(spark, d, "documents").select("doc_id", snippet(F.col("text"), F.lit("the")).alias("snippet"))


@query("hook5_tier", "SELECT conv_id, turn, CASE WHEN role = 'system' OR length(text) >= 200 OR turn % 5 = 0 THEN 'plus' ELSE 'flash' END AS tier FROM conversations")
def _hook5(spark, d):
    task = F.when(F.col("role") == "system", "vision").otherwise("chat")
    level = F.when(F.col("turn") % 5 == 0, "complex").otherwise("simple")
    return load(spark, d, "conversations").select("conv_id", "turn", tier(task, F.char_length("text") * 20, F.lit(False), level).alias("tier"))


@query("int05_bounded", "SELECT o_orderkey, greatest(1, o_orderkey % 50 - 5) AS first, least(greatest(greatest(1, o_orderkey % 50 - 5), o_orderkey % 90), greatest(1, o_orderkey % 50 - 5) + 19) AS last FROM orders")
def _int05(spark, d):
    r = load(spark, d, "orders").withColumn("r", bounded_range(F.expr("o_orderkey % 50 - 5"), F.expr("o_orderkey % 90"), 20))
    return r.select("o_orderkey", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


@query("toc06_structure", f"WITH {TOC} SELECT doc_id, ord, CASE ord % 4 WHEN 0 THEN CAST(page AS VARCHAR) WHEN 1 THEN (ord % 90) || '.1' WHEN 2 THEN 'A' || (ord % 26 + 1) END AS found FROM ti")
def _toc06(spark, d):
    t = F.expr("case ord % 4 when 0 then concat('Chapter ', page, ' x') when 1 then concat(ord % 90, '.1 x') when 2 then concat('Appendix ', char(65 + ord % 26)) else 'plain' end")
    return toc_items(spark, d).select("doc_id", "ord", heading_structure(t).alias("found"))


@query("fn35_progress", f"WITH {FILES} SELECT id, CASE WHEN status IN ('completed', 'indexed') THEN 100 WHEN status LIKE 'failed%' THEN 0 ELSE 5 END AS percent FROM fi")
def _fn35(spark, d):
    return files(spark, d).select("id", progress(F.col("status")).alias("percent"))


@query("prj17_timeline", f"WITH {FILES} SELECT id, CASE WHEN status = 'completed' THEN 'uploaded:done,parsing:done,outline:done,index:done,completed:done' WHEN status = 'indexed' THEN 'uploaded:done,parsing:done,outline:done,index:done,completed:active' WHEN status LIKE 'processing%' THEN 'uploaded:done,parsing:active,outline:pending,index:pending,completed:pending' ELSE 'uploaded:active,parsing:pending,outline:pending,index:pending,completed:pending' END AS stages FROM fi")
def _prj17(spark, d):
    return files(spark, d).select("id", F.array_join(parts_done(F.col("status")), ",").alias("stages"))
