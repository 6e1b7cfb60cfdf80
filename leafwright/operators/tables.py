"""Aggregation of string tables from a small declarative spec, and schema inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import load

#: What is trimmed off cells; a pattern would be matched at every place of each.
_SPACE = " \t\n\x0b\f\r"
_NUMERIC = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def to_number(cell: Column) -> Column:
    """A cell as a double: commas go, underscores between digits too; null where it is no number."""
    plain = F.regexp_replace(F.trim(cell.cast("string"), F.lit(_SPACE)), ",", "")
    word = F.lower(plain)
    special = F.when(word.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(word.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(word.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    return F.when(plain.rlike(_NUMERIC), F.regexp_replace(plain, "_", "").cast("double")).otherwise(special)


_METRICS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def aggregate(table: DataFrame, spec: dict) -> DataFrame:
    """Run ``spec``: operation count, sum, avg, min, max, concat or groupby.

    A count is of all rows; other metrics skip cells that are no numbers and give no row
    where none is left. Groups are of the trimmed text of the key, blank ones
    ``(empty)``; those without numbers vanish; the rest go by value, descending.
    """
    op, target, limit = spec.get("operation"), spec.get("target_column"), int(spec.get("limit", 100))
    if op == "count":
        return table.agg(F.count(F.lit(1)).alias("count"))
    if op in _METRICS:
        d = table.select(to_number(F.col(target)).alias("__n"))
        return d.agg(_METRICS[op]("__n").alias(target), F.count("__n").alias("__c")).where("__c > 0").drop("__c")
    if op == "concat":
        return table.select(target).limit(limit)
    if op == "groupby":
        key, metric = spec["group_by"], spec.get("metric", "count")
        text = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(_SPACE))
        d = table.withColumn("__k", F.when(text == "", "(empty)").otherwise(text))
        if metric == "count":
            out = d.groupBy(F.col("__k").alias(key)).agg(F.count(F.lit(1)).alias("count"))
            return out.orderBy(F.desc("count"), key).limit(limit)
        name = f"{metric}_{target}"
        d = d.withColumn("__n", to_number(F.col(target))).where("__n is not null")
        return d.groupBy(F.col("__k").alias(key)).agg(_METRICS[metric]("__n").alias(name)).orderBy(F.desc(name), key).limit(limit)
    return table.limit(0)


def infer_schema(table: DataFrame, order: list[str], sample: int = 50) -> DataFrame:
    """(column, type) by the first ``sample`` rows: a number if half of them at least parse."""
    head = table.orderBy(*order).limit(sample)
    n = F.count(F.lit(1))
    kinds = [F.when(F.count(to_number(F.col(c))) >= F.greatest(F.lit(1), F.floor(n / 2)), "number").otherwise("string").alias(c) for c in table.columns]
    names = ", ".join(f"'{c}', `{c}`" for c in table.columns)
    return head.agg(*kinds).selectExpr(f"stack({len(table.columns)}, {names}) as (column_name, column_type)")


@query("agg01_groupby_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1")
def _agg01(spark, d):
    out = aggregate(load(spark, d, "lineitem"), {"operation": "groupby", "group_by": "l_returnflag", "target_column": "l_extendedprice", "metric": "sum"})
    return out.withColumn("sum_l_extendedprice", F.round("sum_l_extendedprice", 2))


for _m in ("avg", "min", "max"):

    @query(f"agg03_groupby_{_m}", f"SELECT l_linestatus, round({_m}(l_quantity), 4) AS {_m}_l_quantity FROM lineitem GROUP BY 1")
    def _agg03(spark, d, m=_m):
        out = aggregate(load(spark, d, "lineitem"), {"operation": "groupby", "group_by": "l_linestatus", "target_column": "l_quantity", "metric": m})
        return out.withColumn(f"{m}_l_quantity", F.round(f"{m}_l_quantity", 4))

    @query(f"agg02_{_m}", f"SELECT round({_m}(o_totalprice), 4) AS o_totalprice FROM orders")
    def _agg02(spark, d, m=_m):
        return aggregate(load(spark, d, "orders"), {"operation": m, "target_column": "o_totalprice"}).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("agg03_groupby_count", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def _agg03c(spark, d):
    return aggregate(load(spark, d, "orders"), {"operation": "groupby", "group_by": "o_orderpriority", "metric": "count"})


@query("agg02_count", "SELECT count(*) AS count FROM lineitem")
def _agg02c(spark, d):
    return aggregate(load(spark, d, "lineitem"), {"operation": "count"})


@query("agg04_infer_schema", "SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS column_name, unnest(['number', 'string', 'string', 'string', 'number', 'number']) AS column_type")
def _agg04(spark, d):
    return infer_schema(load(spark, d, "part"), ["p_partkey"])


@query("set01_union", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _set01(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return union_tables([c, s])
