"""Operator 8, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is put in a permuted order by a keyed hash of its rows and cut into
blocks: ranges of that order. Its target, in words, is so many whole passes and a
part of one more, and so an exact quota of blocks, the last one cut short where the
words reach the target. A binary tree over the output shards then splits the quotas:
each node draws, by a hash of its own, a uniform choice of its blocks for its left
side, as many as that side has room for. So the blocks of each source that go left
are multivariate-hypergeometric. A leaf's blocks are disjoint from all others', and
their rows are ordered within the shard by a hash.

Nothing comes to the driver. The tree works on one row for each block, ranked in
parallel; rows of the corpus meet their block's draws by (source, block), so a source
with a third of them is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import write_stage
from ..sources.tables import load
from .common import fresh, n_words, without

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Hashes have 60 bits; the first 12 number the fine blocks.
FINE, FINE_BITS = 4096, 48


def _hash(text: Column) -> Column:
    """60 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def order_hash(seed: str, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The place of a row in its source's permuted order."""
    whole = F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return _hash(whole)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size), a row for each source, with its ``target``.

    Weights repeat over the sources in code point order, null last. Shares beyond
    ``cap`` times a source's size are dealt again by weight until none is above: the
    sources that stop are those whose cap per weight is lowest, found by prefix sums. All
    sources are ordered in one task: a row each, of some dozen bytes.
    """
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n)) + 1).cast("int"))
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = sizes.withColumn("weight", weight).withColumn("__most", F.lit(float(cap)) * F.col("source_size"))
    d = d.withColumn("__mass", F.lit(float(share)) * F.sum("source_size").over(whole)).withColumn("__rate", F.col("__most") / F.col("weight"))
    upto = W.orderBy("__rate", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("__stopped", F.sum("__most").over(upto) - F.col("__most"))
    d = d.withColumn("__left", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
    level = (F.col("__mass") - F.col("__stopped")) / F.col("__left")
    d = d.withColumn("__level", F.max(F.when(level <= F.col("__rate"), level)).over(whole))
    return d.select("source", "source_size", "weight", F.least("__most", F.coalesce(F.col("weight") * F.col("__level"), F.col("__most"))).alias("target"))


def split_units(units: DataFrame, n_shards: int, seed: str = SEED, buckets: int = 4096) -> DataFrame:
    """``units`` (source, unit), a row for each block of each source's quota, with its ``shard``.

    The tree halves the shards. A node of shards lo to hi orders its units by a hash that
    it alone has, and the first M * (mid - lo) / (hi - lo) of its M units go left. Ranks
    are counted within buckets of the hash, and by prefix sums over buckets.
    """
    d = units.select("source", "unit", F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"))
    for _ in range((n_shards - 1).bit_length()):
        told = F.concat_ws("|", F.lit(seed), "lo", "hi", "unit", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))
        d = write_stage(d.withColumn("k", _hash(told)), "tree")
        d = d.withColumn("bucket", F.expr(f"k div {2**60 // buckets}L"))
        node = W.partitionBy("lo", "hi")
        sums = d.groupBy("lo", "hi", "bucket").agg(F.count(F.lit(1)).alias("n"))
        sums = sums.select("lo", "hi", "bucket", (F.sum("n").over(node.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(node).alias("total"))
        rank = F.row_number().over(W.partitionBy("lo", "hi", "bucket").orderBy("k", F.col("source").asc_nulls_last(), "unit"))
        # a row for each bucket of a node
        d = d.withColumn("rank", rank).join(F.broadcast(sums), ["lo", "hi", "bucket"])
        mid = F.expr("(lo + hi) div 2").cast("int")
        left = F.col("before") + F.col("rank") <= F.expr("total * ((lo + hi) div 2 - lo) div (hi - lo)")
        narrow = F.col("hi") - F.col("lo") == 1
        d = d.select("source", "unit", F.when(narrow | left, F.col("lo")).otherwise(mid).alias("lo"), F.when(narrow | ~left, F.col("hi")).otherwise(mid).alias("hi"))
    return d.select("source", "unit", F.col("lo").alias("shard"))


def plan(slim: DataFrame, n_shards: int, seed: str, blocks: int, **law) -> DataFrame:
    """A row for each block of each source: source_size, target, cut, and ``units``: (unit, pass, shard) of its draws.

    ``slim`` has source, h (its :func:`order_hash`) and size. Of the last pass, rows up to
    the hash ``cut`` are drawn: those whose middle lies before the rest of the target.
    """
    fine = write_stage(slim.groupBy("source", F.shiftright("h", FINE_BITS).alias("fine")).agg(F.sum("size").alias("words")), "fine")
    sized = targets(fine.groupBy("source").agg(F.sum("words").alias("source_size")), **law)
    sized = sized.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sized = write_stage(sized.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "sized")
    upto = W.partitionBy("source").orderBy("fine").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = fine.withColumn("end", F.sum("words").over(upto)).withColumn("start", F.col("end") - F.col("words"))
    cut = ends.join(sized.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).where("rest > 0 and start < rest and end >= rest")
    cut = write_stage(cut.select(F.col("source").alias("__s"), F.col("fine").alias("__f"), "start", "rest"), "cut")
    near = slim.join(cut, F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("h", FINE_BITS) == F.col("__f")))
    near = near.groupBy("source", "h").agg(F.sum("size").alias("size"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    run = W.partitionBy("source").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = near.withColumn("middle", F.col("start") + F.sum("size").over(run) - F.col("size") / 2)
    hit = near.groupBy("source").agg(F.max(F.when(F.col("middle") < F.col("rest"), F.col("h"))).alias("last"))
    cuts = cut.join(hit, F.col("source").eqNullSafe(F.col("__s")), "left")
    # below the cut block all rows are drawn; in it, those up to the last hash
    cuts = cuts.select("__s", F.coalesce("last", F.shiftleft(F.col("__f"), FINE_BITS) - 1).alias("cut"))
    width = FINE // blocks
    sized = sized.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long")))
    quota = F.col("passes") * blocks + F.when(F.col("cut") < 0, 0).otherwise(F.expr(f"shiftright(cut, {FINE_BITS}) div {width} + 1"))
    sized = write_stage(sized.select("source", "source_size", "target", "passes", "cut", quota.cast("long").alias("quota")), "quotas")
    units = sized.where("quota > 0").select("source", F.explode(F.expr("sequence(0L, quota - 1)")).alias("unit"))
    placed = split_units(units, n_shards, seed).withColumn("block", F.pmod("unit", F.lit(blocks)))
    placed = placed.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("unit", F.expr(f"unit div {blocks}").alias("pass"), "shard"))).alias("units"))
    every = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    p = placed.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "units")
    every = every.join(p, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    return write_stage(every.select("source", "block", "source_size", "target", "passes", "cut", "units"), "draws")


def mix(df: DataFrame, size: str = "size", n_shards: int = 8, seed: str = SEED, blocks: int = 256, doc_id: str = "doc_id", text: str = "text", source: str = "source", **law) -> DataFrame:
    """``df`` with source_size, target and ``draws``: an entry (shard, unit, place) for each copy that the mix takes.

    ``size`` names the column with a row's words; ``shuffled`` gives the mix itself. Null
    sources form a source of their own; null or empty texts have size 0 and weigh nothing.
    Rows that agree in id and text share a fate. An empty table gives no rows.
    """
    df = without(df, "source_size", "target", "draws")
    h, block, s, b, passes, cut, units = fresh(df, "__h", "__block", "__s", "__b", "__passes", "__cut", "__units")
    d = df.withColumn(h, order_hash(seed, doc_id, text))
    slim = write_stage(d.select(F.col(source).alias("source"), F.col(h).alias("h"), F.col(size).alias("size")), "mix")
    made = plan(slim, n_shards, seed, blocks, **law).withColumnsRenamed({"source": s, "block": b, "passes": passes, "cut": cut, "units": units})
    width = (FINE // blocks).bit_length() - 1
    d = d.withColumn(block, F.shiftright(h, FINE_BITS + width))
    # some hundred rows for each source: Spark broadcasts the table while it is small, else rows meet it by block
    d = d.join(made, F.col(source).eqNullSafe(F.col(s)) & (F.col(block) == F.col(b)), "left")
    drawn = F.filter(F.coalesce(units, F.array()), lambda x: (x["pass"] < F.col(passes)) | (F.col(h) <= F.col(cut)))
    place = lambda x: _hash(F.concat_ws("|", F.lit(seed), x["shard"], x["unit"], F.col(h)))
    d = d.withColumn("draws", F.transform(drawn, lambda x: F.struct(x["shard"].alias("shard"), x["unit"].alias("unit"), place(x).alias("place"))))
    return d.drop(h, block, s, b, passes, cut, units)


def shuffled(mixed: DataFrame) -> DataFrame:
    """A row for each draw of :func:`mix`, with ``shard`` and ``place``; ranges of a shard lie together, in order of place."""
    drawn, part = fresh(mixed, "__draw", "__range")
    d = without(mixed, "shard", "place").withColumn(drawn, F.explode("draws"))
    d = d.drop("draws").select("*", f"{drawn}.shard", f"{drawn}.place").drop(drawn).withColumn(part, F.shiftright("place", 52))
    return d.repartition("shard", part).sortWithinPartitions("shard", "place").drop(part)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: ``taken`` is the words of the copies that the mix draws, ``draws`` their shard:place."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source").withColumn("size", n_words(F.col("text")))
    shown = F.array_join(F.transform("draws", lambda x: F.concat_ws(":", x["shard"], x["place"])), ",")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), shown.alias("draws"))


def _sql_hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


_H = _sql_hash(f"'{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')")
_K = _sql_hash(f"'{SEED}|' || lo || '|' || hi || '|' || unit || '|' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END")


def _sql_level(name: str, before: str) -> str:
    """A level of the tree over eight shards: all its nodes are as wide."""
    mid, left = "((lo + hi) // 2)", "r <= m * ((lo + hi) // 2 - lo) // (hi - lo)"
    return f"""{name}r AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY {_K}, source NULLS LAST, unit) AS r, count(*) OVER (PARTITION BY lo, hi) AS m FROM {before}
), {name} AS (SELECT source, unit, CASE WHEN {left} THEN lo ELSE {mid} END AS lo, CASE WHEN {left} THEN {mid} ELSE hi END AS hi FROM {name}r)"""


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, {_H} AS h, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0 * source_size AS most, 1.5 * sum(source_size) OVER () AS mass, 2.0 * source_size / weight AS rate FROM s
), p AS (
  SELECT *, sum(most) OVER (ORDER BY rate, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most AS stopped,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY rate, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS room FROM r
), v AS (
  SELECT *, max(CASE WHEN (mass - stopped) / room <= rate THEN (mass - stopped) / room END) OVER () AS level FROM p
), t AS (
  SELECT source, source_size, least(most, coalesce(weight * level, most)) AS target FROM v
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h
), m AS (
  SELECT source, h, sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto, size FROM g
), c AS (
  SELECT u.source, CASE WHEN u.target > u.passes * u.source_size THEN greatest(
      coalesce(max(m.h) FILTER (m.upto - m.size / 2.0 < u.target - u.passes * u.source_size), -1),
      ((min(m.h) FILTER (m.upto >= u.target - u.passes * u.source_size) >> 48) << 48) - 1) END AS cut
  FROM u JOIN m ON u.source IS NOT DISTINCT FROM m.source GROUP BY u.source, u.target, u.passes, u.source_size
)
, q AS (
  SELECT u.source, c.cut, u.passes, u.passes * 256 + CASE WHEN coalesce(c.cut, -1) < 0 THEN 0 ELSE (c.cut >> 52) + 1 END AS quota
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source
), l0 AS (SELECT source, unnest(range(0, quota)) AS unit, 0 AS lo, 8 AS hi FROM q
), {_sql_level("l1", "l0")}, {_sql_level("l2", "l1")}, {_sql_level("l3", "l2")}
, w AS (
  SELECT d.doc_id, d.h, d.source, l3.lo AS shard, l3.unit FROM (SELECT DISTINCT doc_id, h, source FROM d) d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  JOIN l3 ON l3.source IS NOT DISTINCT FROM d.source AND l3.unit % 256 = (d.h >> 52) AND (l3.unit // 256 < q.passes OR d.h <= q.cut)
), x AS (
  SELECT doc_id, h, source, count(*) AS n, string_agg(shard || ':' || {_sql_hash(f"'{SEED}|' || shard || '|' || unit || '|' || h")}, ',' ORDER BY unit) AS draws FROM w GROUP BY ALL
)
SELECT d.doc_id, d.size, u.source_size, CAST(u.target AS DOUBLE) AS target, CAST(d.size * coalesce(x.n, 0) AS BIGINT) AS taken, coalesce(x.draws, '') AS draws
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
LEFT JOIN x ON x.doc_id IS NOT DISTINCT FROM d.doc_id AND x.h = d.h AND x.source IS NOT DISTINCT FROM d.source
"""
