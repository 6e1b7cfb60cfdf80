"""Projections and scalar functions over text, numerals and anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import PAGES, page_text
from ..sources.tables import load


def collapse(text: Column) -> Column:
    """White space runs become one space; none stays at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def summary(text: Column, most: int = 180) -> Column:
    """PRJ01: collapsed text, cut to one below ``most`` with an ellipsis of three dots."""
    t = collapse(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("..."))).otherwise(t)


def truncate(text: Column, most: int, mark: str = "...") -> Column:
    """FN06: the first ``most`` characters and a mark, where the text is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def match_form(text: Column) -> Column:
    """FN01: lower case, only ASCII letters, digits and CJK ideographs; accents go with their letters."""
    return F.regexp_replace(F.lower(text), r"[^0-9a-zA-Z一-鿿]+", "")


def tokens(text: Column) -> Column:
    """FN07: distinct ASCII words or single ideographs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+|[一-鿿]"), F.lit(0)))


def token_overlap(left: Column, right: Column) -> Column:
    """FN24: the share of the left's tokens found at the right."""
    return F.size(F.array_intersect(left, right)) / F.greatest(F.lit(1), F.size(left))


def stable_id(*parts: Column) -> Column:
    """PRJ07."""
    return F.concat(F.lit("node_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def estimate_tokens(text: Column) -> Column:
    """FN22: seven tenths of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) * 0.7)).cast("int")


def conversation_title(text: Column, most: int = 32) -> Column:
    """PRJ18."""
    t = collapse(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…"))).otherwise(t)


def mask_key(key: Column) -> Column:
    """FN16: all but the ends of a long key."""
    return F.when(F.coalesce(key, F.lit("")) == "", "").when(F.length(key) <= 8, "***").otherwise(F.concat(F.substring(key, 1, 3), F.lit("..."), F.substring(key, -4, 4)))


def safe_url(url: Column) -> Column:
    """FLT13: http or https with a host."""
    return F.coalesce(F.trim(url).rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def garbled(text: Column) -> Column:
    """FLT07: thirty characters or more of which less than half are ASCII or CJK."""
    n = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[^\u0000-\u007f一-鿿]", ""))
    return (n >= 30) & (plain / n < 0.5)


def language(text: Column) -> Column:
    """CLS16: Chinese by its share of ideographs and kana, else English by ASCII letters, else Chinese."""
    n = F.greatest(F.length(text), F.lit(1))
    cjk = F.length(F.regexp_replace(text, r"[^぀-ヿ一-鿿]", ""))
    return F.when(cjk / n >= 0.15, "zh").when(F.length(F.regexp_replace(text, "[^a-zA-Z]", "")) / n > 0.5, "en").otherwise("zh")


def sentences(text: Column) -> Column:
    """SEA16: stretches up to and with a sentence's end mark, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^。！？；.!?;\n]+[。！？；.!?;]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def anchor_label(unit: Column, start: Column, end: Column, sheet: Column) -> Column:
    """PRJ03: page, line, row, paragraph or slide range as readers see it."""
    span = F.when(end.isNull() | (end == start), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    return (
        F.when(unit == "page", F.concat(F.lit("p."), span))
        .when(unit == "line", F.concat(F.lit("lines "), span))
        .when(unit == "row", F.concat(F.coalesce(F.concat(sheet, F.lit(" ")), F.lit("")), F.lit("rows "), span))
        .when(unit == "paragraph", F.concat(F.lit("paragraphs "), span))
        .when(unit == "slide", F.concat(F.lit("slide "), span))
    )


_COL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("prj01_summary", f"WITH c AS (SELECT doc_id, {_COL} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 180 THEN t[1:179] || '...' ELSE t END AS summary FROM c")
def _prj01(spark, d):
    return load(spark, d, "documents").select("doc_id", summary(F.col("text")).alias("summary"))


@query("prj07_stable_id", f"WITH {PAGES} SELECT doc_id, page, 'node_' || substr(sha1(doc_id || '|' || page || '|' || text), 1, 16) AS node_id FROM pg")
def _prj07(spark, d):
    return page_text(spark, d).select("doc_id", "page", stable_id(F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col("text")).alias("node_id"))


@query("prj18_title", f"WITH c AS (SELECT conv_id, turn, {_COL} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) > 32 THEN rtrim(t[1:32]) || '…' ELSE t END AS title FROM c")
def _prj18(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", conversation_title(F.col("text")).alias("title"))


@query("fn01_match_form", r"SELECT doc_id, regexp_replace(lower(text), '[^0-9a-zA-Z\x{4e00}-\x{9fff}]+', '', 'g') AS form FROM documents")
def _fn01(spark, d):
    return load(spark, d, "documents").select("doc_id", match_form(F.col("text")).alias("form"))


@query("fn07_tokens", r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{4e00}-\x{9fff}]'))) AS INT) AS n FROM documents")
def _fn07(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n"))


@query("fn16_mask", "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '***' ELSE c_name[1:3] || '...' || c_name[-4:] END AS masked FROM customer")
def _fn16(spark, d):
    return load(spark, d, "customer").select("c_custkey", mask_key(F.col("c_name")).alias("masked"))


@query("fn22_tokens", "SELECT doc_id, CAST(greatest(1, floor(length(text) * CAST(0.7 AS DOUBLE))) AS INT) AS tokens FROM documents")
def _fn22(spark, d):
    return load(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("flt07_garbled", r"SELECT doc_id, length(text) >= 30 AND length(regexp_replace(text, '[^\x00-\x7f\x{4e00}-\x{9fff}]', '', 'g')) / length(text) < 0.5 AS garbled FROM documents")
def _flt07(spark, d):
    return load(spark, d, "documents").select("doc_id", garbled(F.col("text")).alias("garbled"))


@query("flt13_safe_url", r"SELECT page_id, regexp_matches(trim(url), '^https?://[^/?#\s]+') AS safe FROM pages")
def _flt13(spark, d):
    return load(spark, d, "pages").select("page_id", safe_url(F.col("url")).alias("safe"))


@query("fn13_html_title", r"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_text FROM pages")
def _fn13(spark, d):
    strip = collapse(F.regexp_replace("html", "<[^>]*>", " "))
    return load(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.length(strip).cast("long").alias("n_text"))


@query("cls16_language", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(length(text), 1) > 0.5 THEN 'en' ELSE 'zh' END AS language FROM documents")
def _cls16(spark, d):
    return load(spark, d, "documents").select("doc_id", language(F.col("text")).alias("language"))


@query("sea16_sentences", r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;\n]+[。！？；.!?;]?'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, CAST(len(s) AS INT) AS n, s[1] AS first FROM s")
def _sea16(spark, d):
    s = load(spark, d, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.try_element_at("s", F.lit(1)).alias("first"))


@query("prj03_label", f"WITH {PAGES} SELECT doc_id, page, CASE page % 4 WHEN 0 THEN 'p.' || page WHEN 1 THEN 'lines ' || page || '-' || (page + 2) WHEN 2 THEN 'S rows ' || page || '-' || (page + 2) ELSE 'slide ' || page END AS label FROM pg")
def _prj03(spark, d):
    p = page_text(spark, d)
    unit = F.expr("case page % 4 when 0 then 'page' when 1 then 'line' when 2 then 'row' else 'slide' end")
    end = F.when(F.col("page") % 4 == 0, F.col("page")).when(F.col("page") % 4 == 3, F.lit(None)).otherwise(F.col("page") + 2)
    return p.select("doc_id", "page", anchor_label(unit, F.col("page"), end, F.lit("S")).alias("label"))
