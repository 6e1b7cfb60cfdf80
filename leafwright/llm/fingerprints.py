"""Operator 6, document fingerprints: SimHash, with permuted block tables for search.

A text's terms are its pairs of neighbouring lower-case words (its word, if it has
one only), each weighing as often as it occurs. The 64 bits of a term's hash vote, by
sign, on the bits of the fingerprint. Votes are counted four to a long, so a term
costs sixteen additions and not sixty-four.

The search cuts fingerprints into blocks. Two fingerprints within radius r agree in
all but r blocks at least, so a table for each choice of the others, keyed by those
blocks, brings every such pair together; the distance is checked as they meet.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import write_stage
from ..sources.tables import load
from .common import fresh, join_hot, text_of, without

#: Sixteen-bit counters hold this many votes.
CHUNK = 60_000
#: Bytes of text that a range of neighbours is to hold.
RANGE_BYTES = 64 << 20


def terms(text: str) -> Column:
    """Hashes of a text column's terms."""
    return F.expr(rf"""
      transform(array(transform(filter(split(lower({text}), '[\\x20\\x09-\\x0D]+'), w -> w != ''), w -> xxhash64(w))), h ->
        if(size(h) < 2, h, zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1), (a, b) -> xxhash64(a, b))))[0]""")


def simhash(hashes: str) -> Column:
    """The fingerprint, a long, of an array column of term hashes; no terms give 0."""
    zero = "struct(" + ", ".join(f"0L as c{j}" for j in range(16)) + ")"
    add = "struct(" + ", ".join(f"s.c{j} + (shiftright(h, {j}) & 281479271743489L) as c{j}" for j in range(16)) + ")"
    counters = "array(" + ", ".join(f"s.c{j}" for j in range(16)) + ")"
    chunk = f"aggregate(slice({hashes}, cast(c * {CHUNK} + 1 as int), {CHUNK}), {zero}, (s, h) -> {add}, s -> {counters})"
    votes = f"transform(array({chunk}), a -> transform(sequence(0, 63), k -> shiftright(a[k % 16], 16 * (k div 16)) & 65535L))[0]"
    total = f"aggregate(sequence(0, (size({hashes}) - 1) div {CHUNK}), array_repeat(0L, 64), (t, c) -> zip_with(t, {votes}, (x, y) -> x + y))"
    bits = f"aggregate(zip_with({total}, sequence(0, 63), (v, k) -> if(2 * v > size({hashes}), shiftleft(1L, k), 0L)), 0L, (x, y) -> x | y)"
    return F.expr(f"if(size({hashes}) > 0, {bits}, 0L)")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a non-null text column as long ``name``; texts of any length are read whole."""
    df = without(df, name)
    (made,) = fresh(df, "__terms")
    return df.withColumn(made, terms(text)).withColumn(name, simhash(made)).drop(made)


def as_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits on which two fingerprints agree."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_tables(df: DataFrame, fp: str, radius: int = 3, blocks: int = 6) -> DataFrame:
    """A row for each table and row of ``df``: ``__key`` holds the table's blocks, moved to the front, and its number."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for t, kept in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edge[b + 1] - edge[b])) - 1) << edge[b] for b in kept)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.xxhash64(F.lit(t), F.col(fp).bitwiseAND(F.lit(mask).cast("long"))))
    return df.withColumn("__key", F.explode(F.array(*keys)))


def within_radius(queries: DataFrame, base: DataFrame, fp: str, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query_fp, fp) of fingerprints at most ``radius`` bits apart, equal ones included, each once.

    Both inputs must hold distinct fingerprints in column ``fp``. Every such pair is
    found: it agrees in ``blocks - radius`` blocks, which are the key of some table.
    """
    q = block_tables(queries.select(F.col(fp).alias("query_fp")), "query_fp", radius, blocks)
    b = block_tables(base.select(F.col(fp).alias("fp")), "fp", radius, blocks)
    near = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))) <= radius
    return q.join(b.withColumnRenamed("__key", "__other"), (F.col("__key") == F.col("__other")) & near).select("query_fp", "fp").distinct()


def count_near(df: DataFrame, fp: str, asked: str, name: str = "n_near", radius: int = 3, blocks: int = 6) -> DataFrame:
    """``df`` with ``name``: for rows on which ``asked`` holds, how many other rows have a fingerprint within ``radius``.

    Rows with the same fingerprint count too, each; others get null. Fingerprints meet as
    distinct ones with their numbers of rows, so copies are not expanded into pairs.
    """
    df = without(df, name)
    members = df.groupBy(F.col(fp).alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(asked)).alias("asked"))
    members = write_stage(members, "members")
    found = within_radius(members.where("asked > 0"), members, "fp", radius, blocks).join(members.select("fp", "n"), "fp")
    found = found.groupBy("query_fp").agg((F.sum("n") - 1).alias(name)).join(members.select(F.col("fp").alias("query_fp"), "asked"), "query_fp")
    found = write_stage(found.withColumnRenamed("query_fp", fp), "near")
    first = join_hot(df.where(asked), found, fp, [c for c in df.columns if c != fp][:2], "asked")
    return first.unionByName(df.where(f"not coalesce({asked}, false)").withColumn(name, F.lit(None).cast("long")))


def ranges(df: DataFrame, key: str, tie: str, parts: int, buckets: int = 256) -> Column:
    """The number of a row's range: ranges follow one another in descending ``key``, nulls last, then ascending ``tie``.

    ``buckets`` quantiles of the key part its values, and each bucket is cut into
    ``parts``: by the key, or by the tie where it holds one value only. A value that is
    several quantiles gets a bucket of its own, so a hot key is cut by its ties.
    """
    row = df.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10000).alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    q = sorted(row.q or [])
    hot = {a for a, b in zip(q, q[1:], strict=False) if a == b}
    bounds = sorted({*q, *(x + 1 for x in hot if x < row.hi)}, reverse=True)
    by_tie = F.least(F.lit(parts - 1), F.floor((F.col(tie).cast("double") / 2.0**64 + 0.5) * parts)).cast("long")
    if row.lo is None:
        return by_tie
    longs = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    at = F.expr(f"size(filter({longs(bounds)}, x -> x > {key}))") if bounds else F.lit(0)
    # bucket i holds the keys from lows[i] up to, not with, highs[i]
    highs, lows = [row.hi + 1, *bounds], [*bounds, min(row.lo, bounds[-1] if bounds else row.lo)]
    high, low = F.element_at(F.expr(longs(highs)), at + 1), F.element_at(F.expr(longs(lows)), at + 1)
    by_key = F.floor((high - 1 - F.col(key)).cast("double") / F.greatest(high - low, F.lit(1)).cast("double") * parts)
    inside = F.when(high - low <= 1, by_tie).otherwise(F.greatest(F.lit(0), F.least(F.lit(parts - 1), by_key)))
    return F.when(F.col(key).isNull(), (len(bounds) + 1) * parts + by_tie).otherwise(at * parts + inside).cast("long")


def with_next(df: DataFrame, key: str, tie: str, carry: dict[str, str], parts: int = 1, prepare=lambda d: d) -> DataFrame:
    """``df`` with columns of the next row in descending ``key`` (nulls last), the first row following the last.

    ``carry`` maps columns to the names that the next row's values get. Rows are dealt to
    ``ranges`` of the key and ordered within them; the first row of each range is dealt to
    the range before it too, so that rows move once. Equal keys follow in the order of
    ``tie``. ``prepare`` adds columns to carry: it is applied once the few rows that are
    dealt twice are picked. A single row is its own next one; an empty table gives none.
    """
    at, ghost, hk, ht, to = fresh(df, "__range", "__ghost", "__hk", "__ht", "__to")
    d = df.withColumn(at, ranges(df, key, tie, parts))
    order = [F.col(key).desc_nulls_last(), F.col(tie).asc()]
    heads = d.groupBy(at).agg(F.max_by(F.struct(key, tie), F.struct(F.coalesce(F.col(key), F.lit(-(2**63)).cast("long")), -F.col(tie).cast("decimal(20,0)"))).alias("h"))
    cyc = W.orderBy(at)  # a row for each range
    before = F.coalesce(F.lag(at).over(cyc), F.max(at).over(W.partitionBy()))
    heads = heads.select(F.col(f"h.{key}").alias(hk), F.col(f"h.{tie}").alias(ht), before.alias(to))
    ghosts = d.join(F.broadcast(heads), F.col(key).eqNullSafe(F.col(hk)) & (F.col(tie) == F.col(ht))).dropDuplicates([to])
    ghosts = ghosts.withColumn(at, F.col(to)).withColumn(ghost, F.lit(1)).drop(to, hk, ht)
    both = prepare(d.withColumn(ghost, F.lit(0))).unionByName(prepare(ghosts))
    w = W.partitionBy(at).orderBy(F.col(ghost), *order)
    for have, name in carry.items():
        both = both.withColumn(name, F.lead(have).over(w))
    return both.where(F.col(ghost) == 0).drop(at, ghost)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    A null text is empty and has fingerprint 0, as a text without words. A single
    document is its own next one; repeated rows follow one another; an empty table gives
    no rows. ``n_near``, of documents whose id is divisible by 20, counts the other
    documents whose fingerprints are within 3 bits, equal ones included, found in the
    permuted block tables; it is null for the rest.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    d = docs.withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // (256 * RANGE_BYTES)
    d = with_next(d, "doc_id", "tie", {"text": "next_text", "fp": "next_fp"}, parts, prepare=lambda x: with_fingerprint(x, "text", "fp"))
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))")
    d = with_fingerprint(d.withColumn("edited", edited), "edited", "edited_fp")
    d = write_stage(d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "edited_fp", "next_fp"), "simhash")
    d = count_near(d, "fp", "doc_id % 20 = 0")
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("fp").alias("fingerprint"),
        as_hex("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )
