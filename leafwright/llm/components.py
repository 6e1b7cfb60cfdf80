"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .common import join_hot


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component's id is its least node.

    Large-star and small-star steps alternate until the edges stay as they are: each
    rewires neighbours to the least node they see, so a path of any length closes in
    logarithmically many rounds. Each round is a written table; only its count and
    checksum reach the driver.
    """
    e = write_stage(_clean(edges.select("a", "b")), "edges")
    last = _state(e)
    for _ in range(rounds):
        if not last[0]:
            break
        e = write_stage(_small_star(_large_star(e, last[0])), "edges")
        now = _state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    # now each edge goes from a node to its component's least
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _clean(e: DataFrame) -> DataFrame:
    """Each edge once, from the lesser node to the greater."""
    return e.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r.n, r.h


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Every node links its greater neighbours to the least of its neighbours and itself.

    ``e`` has ``n`` edges. The centre of a large component is a hot key of the join.
    """
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _clean(join_hot(e, least, "a", ["b"], "n", total=2 * n).select(F.col("m").alias("a"), "b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links itself and its lesser neighbours to the least of them."""
    least = e.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
    moved = e.join(least, F.col("b") == F.col("n")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return _clean(moved)
