"""Trees as flat tables: parents from levels, ordinals, ids, leaves, folders and path rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import FILES, FOLDERS, TOC, files, folders, toc_items

MAX_LEVEL = 6


def parents_by_level(items: DataFrame, doc: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """TRE02: the parent is the nearest row before with a smaller level.

    One window keeps, for each level, the last row at it; of the levels below one's own
    the latest is the parent. Levels go to ``MAX_LEVEL``.
    """
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w).alias(f"__l{k}") for k in range(1, MAX_LEVEL)]
    d = items.select("*", *last)
    known = F.array_compact(F.array(*[F.when(F.col(level) > k, F.col(f"__l{k}")) for k in range(1, MAX_LEVEL)]))
    return d.withColumn("parent_ord", F.array_max(known)).drop(*[f"__l{k}" for k in range(1, MAX_LEVEL)])


def ordinals(items: DataFrame, doc: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """WIN12: ``1.2.3`` counters; a row at a level resets those deeper.

    At level L the counter is the rows at L since the last one above it.
    """
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = items
    for k in range(1, MAX_LEVEL + 1):
        d = d.withColumn(f"__g{k}", F.coalesce(F.sum((F.col(level) < k).cast("int")).over(w), F.lit(0)))
    for k in range(1, MAX_LEVEL + 1):
        inner = W.partitionBy(doc, f"__g{k}").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        d = d.withColumn(f"__c{k}", F.sum((F.col(level) == k).cast("int")).over(inner))
    parts = [F.when(F.col(level) >= k, F.greatest(F.col(f"__c{k}"), F.lit(0)).cast("string")) for k in range(1, MAX_LEVEL + 1)]
    d = d.withColumn("ordinal", F.concat_ws(".", *parts))
    return d.drop(*[f"__{x}{k}" for k in range(1, MAX_LEVEL + 1) for x in "gc"])


def parent_structure(structure: Column) -> Column:
    """TRE04: ``1.2.3`` lies under ``1.2``; a root under nothing."""
    return F.when(F.instr(structure, ".") > 0, F.regexp_replace(structure, r"\.[^.]*$", ""))


def preorder_ids(items: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """TRE06: four-digit ids in depth-first order."""
    return items.withColumn("node_id", F.lpad((F.row_number().over(W.partitionBy(doc).orderBy(order)) - 1).cast("string"), 4, "0"))


def leaves(nodes: DataFrame, doc: str = "doc_id", node: str = "ord", parent: str = "parent_ord") -> DataFrame:
    """TRE05: nodes that are no one's parent."""
    inner = nodes.select(F.col(doc).alias("__d"), F.col(parent).alias("__p")).where("__p is not null").distinct()
    return nodes.join(inner, (F.col(doc) == F.col("__d")) & (F.col(node) == F.col("__p")), "left_anti")


def rename_path(path: Column, old: str, new: str) -> Column:
    """TRE09: ``old`` and all below it move under ``new``."""
    inside = (path == old) | path.startswith(old + "/")
    return F.when(inside, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def folder_depths(tree: DataFrame) -> DataFrame:
    """TRE07: depth of each folder, orphans as roots, by a recursive query."""
    tree.createOrReplaceTempView("__folders")
    return tree.sparkSession.sql("""
      WITH RECURSIVE t(folder_id, depth) AS (
        SELECT folder_id, 0 FROM __folders f WHERE parent_id IS NULL OR parent_id NOT IN (SELECT folder_id FROM __folders)
        UNION ALL SELECT f.folder_id, t.depth + 1 FROM __folders f JOIN t ON f.parent_id = t.folder_id)
      SELECT folder_id, depth FROM t""")


def folder_counts(tree: DataFrame, docs: DataFrame) -> DataFrame:
    """JON07: documents and child folders of each folder, 0 without."""
    n = docs.where("folder_id is not null").groupBy("folder_id").agg(F.count(F.lit(1)).alias("n_docs"))
    c = tree.where("parent_id is not null").groupBy(F.col("parent_id").alias("folder_id")).agg(F.count(F.lit(1)).alias("n_children"))
    d = tree.join(n, "folder_id", "left").join(c, "folder_id", "left")
    return d.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_docs", "n_children")})


_PARENT = f"{TOC}, pa AS (SELECT *, (SELECT max(b.ord) FROM ti b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent_ord FROM ti a)"


@query("tre02_parents", f"WITH {_PARENT} SELECT doc_id, ord, level, parent_ord FROM pa")
def _tre02(spark, d):
    return parents_by_level(toc_items(spark, d)).select("doc_id", "ord", "level", "parent_ord")


@query("tre05_leaves", f"WITH {_PARENT} SELECT doc_id, ord FROM pa a WHERE NOT EXISTS (SELECT 1 FROM pa b WHERE b.doc_id = a.doc_id AND b.parent_ord = a.ord)")
def _tre05(spark, d):
    return leaves(parents_by_level(toc_items(spark, d))).select("doc_id", "ord")


@query("tre06_ids", f"WITH {TOC} SELECT doc_id, ord, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS VARCHAR), 4, '0') AS node_id FROM ti")
def _tre06(spark, d):
    return preorder_ids(toc_items(spark, d)).select("doc_id", "ord", "node_id")


@query("win12_ordinals", f"""WITH {TOC}, g AS (SELECT doc_id, ord, level, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3, sum((level = 1)::INT) OVER w AS c1 FROM ti WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY ord ROWS UNBOUNDED PRECEDING) AS c2, sum((level = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY ord ROWS UNBOUNDED PRECEDING) AS c3 FROM g)
SELECT doc_id, ord, CASE level WHEN 1 THEN CAST(c1 AS VARCHAR) WHEN 2 THEN c1 || '.' || c2 ELSE c1 || '.' || c2 || '.' || c3 END AS ordinal FROM c""")
def _win12(spark, d):
    return ordinals(toc_items(spark, d)).select("doc_id", "ord", "ordinal")


@query("tre04_parent_structure", f"WITH {TOC} SELECT a.doc_id, a.ord, CASE WHEN b.n > 0 THEN regexp_replace(a.structure, '\\.[^.]*$', '') END AS parent FROM ti a LEFT JOIN (SELECT doc_id, structure, count(*) AS n FROM ti GROUP BY 1, 2) b ON b.doc_id = a.doc_id AND b.structure = regexp_replace(a.structure, '\\.[^.]*$', '')")
def _tre04(spark, d):
    t = toc_items(spark, d)
    have = t.select("doc_id", F.col("structure").alias("parent")).distinct()
    return t.select("doc_id", "ord", parent_structure(F.col("structure")).alias("parent")).join(have.withColumn("known", F.lit(True)), ["doc_id", "parent"], "left").select("doc_id", "ord", F.when(F.col("known"), F.col("parent")).alias("parent"))


@query("tre07_depths", "SELECT 'r' || r_regionkey AS folder_id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation")
def _tre07(spark, d):
    return folder_depths(folders(spark, d))


@query("tre09_rename", f"WITH {FOLDERS}, o AS (SELECT min(path) AS p FROM fo WHERE parent_id IS NULL) SELECT folder_id, CASE WHEN path = p OR starts_with(path, p || '/') THEN '/moved' || substr(path, length(p) + 1) ELSE path END AS path FROM fo, o")
def _tre09(spark, d):
    f = folders(spark, d)
    old = f.where("parent_id is null").agg(F.min("path").alias("p")).first().p
    return f.select("folder_id", rename_path(F.col("path"), old, "/moved").alias("path"))


@query("jon07_folder_counts", f"WITH {FOLDERS}, {FILES} SELECT folder_id, (SELECT count(*) FROM fi WHERE fi.folder_id = fo.folder_id) AS n_docs, (SELECT count(*) FROM fo c WHERE c.parent_id = fo.folder_id) AS n_children FROM fo")
def _jon07(spark, d):
    return folder_counts(folders(spark, d), files(spark, d)).select("folder_id", "n_docs", "n_children")
