"""Operator 1, sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get dense global numbers 0..n-1 in an order fixed by their content. A keyed
permutation of that range then gives each row a place p; its shard is p mod the
number of shards and its slot p div that number. Both can be computed for any row
number, and ``invert`` gives the row number that lies at a shard and slot.

All of it is DataFrame expressions. The only data broadcast is one row for each
numbering bucket, whose count is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import load
from .common import fresh, without

ROUNDS = 8


def _sides(n: str) -> tuple[str, str]:
    a = f"cast(ceil(sqrt(cast(greatest({n}, 1L) as double))) as bigint)"
    return a, f"((greatest({n}, 1L) + {a} - 1) div {a})"


def _round(i: str, value: str, key: int) -> str:
    return f"xxhash64({value}, cast({i} as bigint), {key}L)"


def _once(x: str, n: str, key: int, back: bool) -> str:
    """One pass of the Feistel network over [0, a*b)."""
    a, b = _sides(n)
    sign = "-" if back else "+"
    order = f"sequence({ROUNDS - 1}, 0, -1)" if back else f"sequence(0, {ROUNDS - 1})"
    left = f"pmod(s.l {sign} pmod({_round('i', 's.r', key)}, {a}), {a})"
    right = f"pmod(s.r {sign} pmod({_round('i', 's.l', key)}, {b}), {b})"
    return (
        f"aggregate({order}, struct({x} div {b} as l, {x} % {b} as r), "
        f"(s, i) -> if(i % 2 = 0, struct({left} as l, s.r as r), struct(s.l as l, {right} as r)), "
        f"s -> s.l * {b} + s.r)"
    )


def permute_sql(x: str, n: str, key: int, back: bool = False) -> str:
    """SQL for the place of ``x`` in a keyed permutation of [0, n): steps until it lies inside.

    The domain a * b has fewer than a places beyond n, and a walk meets each of them once at
    most, so a steps always end inside. Only a share of less than n^-1/2 of all numbers
    walks at all, so the mean work for a row does not grow.
    """
    again = f"aggregate(sequence(1L, {_sides(n)[0]}), y, (z, k) -> if(z < {n}, z, {_once('z', n, key, back)}))"
    return f"aggregate(array(0), {_once(x, n, key, back)}, (y, j) -> if(y < {n}, y, {again}))"


def permute(x: str, n: str, key: int = 0) -> Column:
    """The place of row number ``x`` (a bigint column) in a keyed permutation of [0, n)."""
    return F.expr(permute_sql(x, n, key))


def invert(x: str, n: str, key: int = 0) -> Column:
    """The row number at place ``x``: the inverse of :func:`permute`."""
    return F.expr(permute_sql(x, n, key, True))


def number_rows(df: DataFrame, order: list[str], buckets: int = 16_384) -> DataFrame:
    """``df`` with ``row_number`` (dense from 0) and ``n_rows``.

    The order is (hash bucket of the ``order`` columns, those columns), so it depends
    on content alone: not on files, partitions or retries. Buckets are numbered apart
    and joined to their offsets, ``buckets`` rows at most. Rows that agree in all
    ``order`` columns are interchangeable.
    """
    df = without(df, "row_number", "n_rows")
    bucket, rn, offset = fresh(df, "__bucket", "__rn", "__offset")
    keyed = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias("c"))
    upto = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select(
        bucket,
        (F.sum("c").over(upto) - F.col("c")).alias(offset),
        F.sum("c").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n_rows"),
    )
    within = F.row_number().over(W.partitionBy(bucket).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return (
        keyed.withColumn(rn, within.cast("long"))
        .join(F.broadcast(offsets), bucket)
        .withColumn("row_number", F.col(offset) + F.col(rn) - 1)
        .drop(bucket, rn, offset)
    )


def shard_rows(df: DataFrame, order: list[str], n_shards: int = 8, key: int = 20241, buckets: int = 16_384) -> DataFrame:
    """``df`` with ``row_number``, ``n_rows``, ``shard`` and ``slot``: shuffled, counts at most one apart.

    Writing each shard sorted by slot gives the shuffled corpus. An empty table gives
    no rows; nulls in ``order`` come first; repeated rows each get a slot of their own.
    """
    numbered = number_rows(without(df, "shard", "slot"), order, buckets)
    (place,) = fresh(numbered, "__place")
    placed = numbered.withColumn(place, permute("row_number", "n_rows", key))
    return placed.withColumn("shard", F.pmod(place, F.lit(n_shards)).cast("int")).withColumn("slot", F.expr(f"{place} div {n_shards}")).drop(place)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 by the ``rows`` law.

    A null text has size 1 and the CRC of no bytes, 0. A null doc_id is a value as any
    other. Rows with the same doc_id and text share a numbering bucket.
    """
    docs = load(spark, sf_dir, "documents")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    return shard_rows(slim, ["doc_id", "text_hash"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
