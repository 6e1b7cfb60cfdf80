"""Stand-ins for pages, outlines, folders and runs, derived from the data tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, page, text): a document's lines as its pages, from 1."""
    d = load(spark, folder, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


PAGES = "pg AS (SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INT) AS page, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


def line_title(text: Column) -> Column:
    return F.array_join(F.slice(F.split(text, " ", 5), 1, 4), " ")


def outlined_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, items, pages): the rows of toc_items() and page_text() of a document in one, so that each text moves whole.

    ``items`` have ord, title and page, in order; ``pages`` holds the texts of pages from 1, a list for each row of the id.
    """
    d = load(spark, folder, "documents").where("text is not null").groupBy("doc_id").agg(F.collect_list("text").alias("t"))
    pages = F.transform("t", lambda t: F.split(t, "\n"))

    def every_third(p: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 3).cast("int"))
        return F.transform(at, lambda i: F.struct(i.alias("ord"), line_title(F.get(p, i * 3)).alias("title"), (i * 3 + 1).alias("page")))

    items = F.sort_array(F.flatten(F.transform("pages", every_third)))
    return d.select("doc_id", pages.alias("pages")).select("doc_id", items.alias("items"), "pages")


def toc_items(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """(doc_id, ord, title, page, level, structure): every third line, titled by its first four words; with ``more`` columns of its page."""
    p = page_text(spark, folder).where("page % 3 = 1")
    d = p.select("doc_id", F.expr("page div 3").cast("int").alias("ord"), line_title(F.col("text")).alias("title"), "page", *more)
    return d.withColumn("level", (F.col("ord") % 3 + 1).cast("int")).withColumn("structure", F.expr("concat(ord div 3 + 1, '.', ord % 3)"))


TOC = (
    PAGES
    + ", ti AS (SELECT doc_id, CAST(page // 3 AS INT) AS ord, array_to_string(string_split(text, ' ')[1:4], ' ') AS title, page, "
    + "CAST((page // 3) % 3 + 1 AS INT) AS level, CAST((page // 3) // 3 + 1 AS VARCHAR) || '.' || CAST((page // 3) % 3 AS VARCHAR) AS structure FROM pg WHERE page % 3 = 1)"
)


def folders(spark: SparkSession, folder: str) -> DataFrame:
    """(folder_id, parent_id, name, path): regions over nations."""
    r = load(spark, folder, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("folder_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.concat(F.lit("/"), F.col("r_name")).alias("path"))
    n = load(spark, folder, "nation").join(load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("folder_id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name"), F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name")).alias("path"))
    return r.unionByName(n)


FOLDERS = (
    "fo AS (SELECT 'r' || r_regionkey AS folder_id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, '/' || r_name AS path FROM region UNION ALL "
    "SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, '/' || r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, folder_id, user_id, status, updated): customers as stored files."""
    c = load(spark, folder, "customer")
    status = F.expr("case c_custkey % 4 when 0 then 'completed' when 1 then 'failed:parse' when 2 then 'processing:queued' else 'indexed' end")
    where = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("n"), F.col("c_nationkey")))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), where.alias("folder_id"), F.col("c_mktsegment").alias("user_id"), status.alias("status"), F.col("c_acctbal").alias("updated"))


FILES = (
    "fi AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'n' || c_nationkey END AS folder_id, c_mktsegment AS user_id, "
    "CASE c_custkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed:parse' WHEN 2 THEN 'processing:queued' ELSE 'indexed' END AS status, c_acctbal AS updated FROM customer)"
)
