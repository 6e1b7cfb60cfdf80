"""Pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator's own outputs would clash with."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has: working columns never clash with a table's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def join_hot(df: DataFrame, side: DataFrame, key: str, spread: list[str], rows: str, hottest: int = 1000, total: int | None = None) -> DataFrame:
    """``df`` left joined with ``side`` on ``key``, which is unique in ``side`` and may be hot in ``df``.

    ``side`` counts the rows of ``df`` that have its key in column ``rows``, which the result
    lacks, and ``total`` is their sum where the caller knows it. Keys with a share of more than one in ``hottest`` of all those rows are at most
    ``hottest``: only they are broadcast. All other rows meet by a plain join; hot ones take
    part in it under keys of their own, dealt out by the columns ``spread``, and find nothing.
    """
    carried = [c for c in side.columns if c not in (key, rows)]
    hot_key, plain_key, zero, salt, *names = fresh(df, "__hot_key", "__key", "__zero", "__salt", *(f"__hot_{c}" for c in carried), *(f"__plain_{c}" for c in carried))
    as_hot, as_plain = names[: len(carried)], names[len(carried) :]
    total = (side.agg(F.sum(rows)).first()[0] or 0) if total is None else total
    hot = side.where(F.col(rows) > total / hottest).select(F.col(key).alias(hot_key), *[F.col(c).alias(n) for c, n in zip(carried, as_hot, strict=True)])
    plain = side.where(F.col(rows) <= total / hottest).select(F.col(key).alias(plain_key), F.pmod(F.xxhash64(key), F.lit(1)).alias(zero), *[F.col(c).alias(n) for c, n in zip(carried, as_plain, strict=True)])
    # zero is no literal, which the optimiser would take out of the join's keys
    d = df.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")
    # rows without a key would all go to one task too
    apart = F.col(hot_key).isNotNull() | F.col(key).isNull()
    d = d.withColumn(salt, F.when(apart, 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(0))
    out = d.join(plain, (F.col(salt) == F.col(zero)) & (F.col(key) == F.col(plain_key)), "left")
    return out.select(*df.columns, *[F.coalesce(h, p).alias(c) for c, h, p in zip(carried, as_hot, as_plain, strict=True)])


def text_of(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds the Python objects of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
