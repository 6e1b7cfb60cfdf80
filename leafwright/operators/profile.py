"""Page and document classification, outline lines, and quality of outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import PAGES, TOC, page_text, toc_items

# Titles of outline pages.
CONTENTS = r"(?i)^\s*(contents|table of contents|目录|目 录)\s*$"
#: A title, leaders or a gap, and a page number.
TOC_LINE = r"^\s*(.+?)[\s.·…]{2,}(\d{1,4})\s*$"
HEADING = r"^\s*(\d+(?:\.\d+)*)[.\s]+(\S.*)$"


def page_class(text: Column, images: Column) -> Column:
    """CLS01: text, image_only, or empty; garbled is told apart by its own predicate."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n > 0, "text").when(F.coalesce(images, F.lit(0)) > 0, "image_only").otherwise("empty")


def document_profile(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """AGG09: page counts, the share of pages with text, and a class of it."""
    has = (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).cast("double")
    d = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(has), 4).alias("coverage"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"))
    return d.withColumn("quality", F.when(F.col("coverage") >= 0.8, "good").when(F.col("coverage") >= 0.3, "mixed").otherwise("poor"))


def text_quality(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """AGG08: the shares of short pages and of letters."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return pages.groupBy(doc).agg(
        F.round(F.avg((F.length("text") < 50).cast("double")), 4).alias("fragment_ratio"),
        F.round(F.sum(letters) / F.greatest(F.sum(F.length("text")), F.lit(1)), 4).alias("meaningful_ratio"),
    )


def chapter_dividers(pages: DataFrame, doc: str = "doc_id", most: int = 60, least: int = 2) -> DataFrame:
    """CLS06: short page texts that repeat with gaps: count, spread, and breaks between repeats."""
    d = pages.where((F.length("text") > 0) & (F.length("text") <= most))
    w = W.partitionBy(doc, "text").orderBy("page")
    d = d.withColumn("__gap", (F.col("page") - F.lag("page").over(w) > 1).cast("int"))
    d = d.groupBy(doc, "text").agg(F.count(F.lit(1)).alias("repeats"), (F.max("page") - F.min("page")).alias("spread"), F.sum(F.coalesce("__gap", F.lit(0))).alias("breaks"))
    return d.where(F.col("repeats") >= least)


def outline_features(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """CLS07: per page, marks of an outline: a contents title, leader lines, numbered lines, and a score."""
    lines = F.filter(F.split("text", r"(?<=[.])\s+|\n"), lambda x: F.trim(x) != "")
    d = pages.withColumn("__l", lines)
    n = F.greatest(F.size("__l"), F.lit(1))
    leaders, numbered = F.size(F.filter("__l", lambda x: x.rlike(TOC_LINE))), F.size(F.filter("__l", lambda x: x.rlike(HEADING)))
    title = F.exists("__l", lambda x: x.rlike(CONTENTS))
    score = F.round(F.least(F.lit(1.0), title.cast("double") * 0.5 + 0.4 * leaders / n + 0.2 * numbered / n), 4)
    return d.select(doc, "page", title.alias("has_title"), leaders.alias("leaders"), numbered.alias("numbered"), score.alias("score"))


def parse_toc_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """TOC01: title and page of lines that end in one, and the structure their number gives."""
    title = F.trim(F.regexp_extract(text, TOC_LINE, 1))
    d = lines.withColumn("title", title).withColumn("target", F.expr(f"try_cast(regexp_extract({text}, '{TOC_LINE.replace(chr(92), chr(92) * 2)}', 2) as int)"))
    return d.where("title != '' and target is not null").withColumn("structure", F.nullif(F.regexp_extract("title", HEADING, 1), F.lit("")))


def outline_quality(items: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """QLT01, AGG16: coverage, repeated titles, anchors found, and a score of the outline."""
    key = F.lower(F.regexp_replace("title", r"\s+", ""))
    d = items.withColumn("__k", key)
    each = d.groupBy(doc).agg(F.count(F.lit(1)).alias("items"), F.countDistinct("__k").alias("titles"), F.countDistinct("page").alias("starts"), F.avg((F.col("title") != "").cast("double")).alias("__named"))
    total = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"))
    d = each.join(total, doc)
    dup = 1 - F.col("titles") / F.col("items")
    cov = F.col("starts") / F.col("pages")
    return d.select(doc, "items", F.round(dup, 4).alias("duplicate_ratio"), F.round(cov, 4).alias("coverage"), F.round(0.4 * cov + 0.2 * (1 - dup) + 0.4 * F.col("__named"), 4).alias("score"))


def title_on_page(items: DataFrame, pages: DataFrame, band: int = 5, doc: str = "doc_id") -> DataFrame:
    """JON15: the first page within ``band`` of the claimed one that holds the title; the band's pages meet by an equal join."""
    p = pages.select(doc, F.col("page").alias("at"), "text")
    near = items.where("title != ''").withColumn("at", F.explode(F.sequence(F.col("claimed") - band, F.col("claimed") + band)))
    j = near.join(p, [doc, "at"]).where(F.col("text").contains(F.col("title")))
    return j.groupBy(doc, "ord").agg(F.min("at").alias("found"))


def map_titles_in_order(items: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JON11: titles searched for one after another, each from the page where the last one was.

    The cursor is sequential, so a document's pages and titles meet in one group; its
    size is that of a document. Titles not found get no page and leave the cursor.
    """
    import pandas as pd

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("page")
        texts, numbers, cursor, out = list(right["text"]), list(right["page"]), 0, []
        for o, title in left.sort_values("ord")[["ord", "title"]].itertuples(index=False):
            hit = next((i for i in range(cursor, len(texts)) if title and title in (texts[i] or "")), None)
            cursor = cursor if hit is None else hit
            out.append((key[0], o, None if hit is None else numbers[hit]))
        return pd.DataFrame(out, columns=[doc, "ord", "found"]).astype({"found": "Int64"})

    return items.select(doc, "ord", "title").groupBy(doc).cogroup(pages.select(doc, "page", "text").groupBy(doc)).applyInPandas(run, f"{doc} long, ord int, found long")


@query("agg09_profile", f"WITH {PAGES}, a AS (SELECT doc_id, count(*) AS pages, round(avg((length(trim(text)) > 0)::INT), 4) AS coverage, round(avg(length(text)), 2) AS mean_chars FROM pg GROUP BY 1) SELECT *, CASE WHEN coverage >= 0.8 THEN 'good' WHEN coverage >= 0.3 THEN 'mixed' ELSE 'poor' END AS quality FROM a")
def _agg09(spark, d):
    return document_profile(page_text(spark, d))


@query("agg08_text_quality", rf"WITH {PAGES} SELECT doc_id, round(avg((length(text) < 50)::INT), 4) AS fragment_ratio, round(sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))) / greatest(sum(length(text)), 1), 4) AS meaningful_ratio FROM pg GROUP BY 1")
def _agg08(spark, d):
    return text_quality(page_text(spark, d))


@query("cls01_page_class", f"WITH {PAGES} SELECT doc_id, page, CASE WHEN length(trim(text)) > 0 THEN 'text' WHEN page % 2 = 1 THEN 'image_only' ELSE 'empty' END AS class FROM pg")
def _cls01(spark, d):
    return page_text(spark, d).select("doc_id", "page", page_class(F.col("text"), F.col("page") % 2).alias("class"))


@query("cls06_dividers", f"WITH {PAGES}, s AS (SELECT doc_id, page, text, coalesce((page - lag(page) OVER (PARTITION BY doc_id, text ORDER BY page) > 1)::INT, 0) AS gap FROM pg WHERE length(text) BETWEEN 1 AND 60) SELECT doc_id, text, count(*) AS repeats, max(page) - min(page) AS spread, CAST(sum(gap) AS BIGINT) AS breaks FROM s GROUP BY 1, 2 HAVING count(*) >= 2")
def _cls06(spark, d):
    return chapter_dividers(page_text(spark, d))


@query(
    "cls07_outline_features",
    rf"""WITH {PAGES}, l AS (SELECT doc_id, page, list_filter(string_split(regexp_replace(text || CASE WHEN page % 4 = 0 THEN chr(10) || 'Contents' || chr(10) || '1. First part ..... 3' ELSE '' END, '([.])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) != '') AS l FROM pg),
c AS (SELECT doc_id, page, greatest(len(l), 1) AS n, len(list_filter(l, lambda x: regexp_matches(x, '{TOC_LINE}'))) AS leaders, len(list_filter(l, lambda x: regexp_matches(x, '{HEADING}'))) AS numbered, len(list_filter(l, lambda x: regexp_matches(x, '{CONTENTS}'))) > 0 AS has_title FROM l)
SELECT doc_id, page, has_title, leaders, numbered, round(least(1.0, has_title::INT * 0.5::DOUBLE + 0.4::DOUBLE * leaders / n + 0.2::DOUBLE * numbered / n), 4) AS score FROM c""",
)
def _cls07(spark, d):
    """The pages, each fourth with a short table of contents below."""
    toc = F.when(F.col("page") % 4 == 0, "\nContents\n1. First part ..... 3").otherwise("")
    return outline_features(page_text(spark, d).withColumn("text", F.concat("text", toc)))


@query("toc01_lines", rf"WITH {PAGES}, l AS (SELECT doc_id, page, text || ' .... ' || page AS text FROM pg), x AS (SELECT doc_id, page, trim(regexp_extract(text, '^\s*(.+?)[\s.·…]{{2,}}(\d{{1,4}})\s*$', 1)) AS title, TRY_CAST(regexp_extract(text, '^\s*(.+?)[\s.·…]{{2,}}(\d{{1,4}})\s*$', 2) AS INT) AS target FROM l) SELECT * FROM x WHERE title <> '' AND target IS NOT NULL")
def _toc01(spark, d):
    lines = page_text(spark, d).withColumn("text", F.concat("text", F.lit(" .... "), F.col("page").cast("string")))
    return parse_toc_lines(lines).select("doc_id", "page", "title", "target")


@query("qlt01_outline", rf"WITH {TOC}, n AS (SELECT doc_id, count(*) AS pages FROM pg GROUP BY 1), e AS (SELECT doc_id, count(*) AS items, count(DISTINCT lower(regexp_replace(title, '\s+', '', 'g'))) AS titles, count(DISTINCT page) AS starts, avg((title <> '')::INT) AS named FROM ti GROUP BY 1) SELECT doc_id, items, round(1 - titles / items, 4) AS duplicate_ratio, round(starts / pages, 4) AS coverage, round(0.4 * (starts / pages) + 0.2 * (1 - (1 - titles / items)) + 0.4 * named, 4) AS score FROM e JOIN n USING (doc_id)")
def _qlt01(spark, d):
    return outline_quality(toc_items(spark, d), page_text(spark, d))


@query("jon15_band", f"WITH {TOC} SELECT ti.doc_id, ti.ord, min(pg.page) AS found FROM ti JOIN pg ON pg.doc_id = ti.doc_id AND abs(pg.page - (ti.page + 1)) <= 5 AND contains(pg.text, ti.title) WHERE ti.title <> '' GROUP BY 1, 2")
def _jon15(spark, d):
    return title_on_page(toc_items(spark, d).withColumn("claimed", F.col("page") + 1).drop("page"), page_text(spark, d))


@query(
    "jon11_title_cursor",
    f"""WITH RECURSIVE {TOC}, p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), x AS (SELECT doc_id, ord, title, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM ti),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS INT) AS ord, CAST(1 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS found FROM p
  UNION ALL SELECT doc_id, i, ord, coalesce(hit, cursor), hit FROM (
    SELECT x.doc_id, x.i, x.ord, f.cursor, list_filter(range(f.cursor, len(p.p) + 1), lambda k: x.title != '' AND contains(p.p[k], x.title))[1] AS hit
    FROM f JOIN x ON x.doc_id = f.doc_id AND x.i = f.i + 1 JOIN p ON p.doc_id = x.doc_id))
SELECT doc_id, ord, found FROM f WHERE i > 0""",
)
def _jon11(spark, d):
    return map_titles_in_order(toc_items(spark, d), page_text(spark, d))
