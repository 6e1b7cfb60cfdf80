"""Operator 4, MinHash near-dedup: fast similarity sketches, banding and exact verification.

A text's set holds its distinct shingles of four lower-case words. The sketch fills t
coordinates in rounds: in round i every element is hashed to one bin and a value, and
a bin holds the least (round, value) that it gets; after t rounds, round t + j puts
all elements in bin j, so every coordinate fills. Documents with equal sets are one
node from the first shuffle on. Bands of coordinates key the buckets; each node links
to the least node of its buckets, and the components of those links are clusters of
candidates: two nodes that share any band are in one cluster.

Verification is exact and leaves out no pair of a cluster. A cluster's sets come to
one task, which counts intersections over an index of shingles. Pivots are compared
with all others at once, and a pair is skipped only if both are linked already, so no
list of pairs arises. Clusters above a bound are cut by levels of set size, each a
quarter up from the last, and levels above the bound into blocks. Sets two levels apart
cannot be near, so only blocks of one level or of neighbouring ones meet, each pair in a
task of its own, whose links (a forest, not pairs) are joined by components again.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import write_stage
from ..sources.tables import load
from .common import fresh, join_hot
from .components import connected_components

SHINGLE = 4
COORDINATES, ROWS = 128, 4
PERCENT = 80
#: Shingles, with repeats among sets, that one verification task holds of one block.
BLOCK_SHINGLES = 1_500_000
#: The ratio of set sizes from one level to the next: a little over 100 / PERCENT, so that rounding parts no near pair.
LEVEL = 1.000001 * 100 / PERCENT

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; none without words.

    Words are runs of anything but ASCII white space, A to Z in lower case. With fewer
    than ``width`` words the whole sequence is the one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: a row of ``t`` filled coordinates each.

    A coordinate is the round in its top byte and the hash value below it. Rounds 0 to
    t-1 place elements at random, t to 2t-1 force bin i - t, so none stays empty.
    """
    empty = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), empty)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        if not len(flat):
            break
        h = _mixed(flat + _U((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        bins = (h & _U(0xFFFF)) % _U(t) if i < t else np.full(len(h), i - t, np.uint64)
        value = _U(i << 56) | (_mixed(h) >> _U(8))
        at = owner * t + bins.astype(np.int64)
        fresh = out.ravel()[at] > _U(i << 56)  # bins that earlier rounds filled stay as they are
        np.minimum.at(out.reshape(-1), at[fresh], value[fresh])
        open_ = (out == empty).any(axis=1)
        keep = open_[owner]
        flat, owner = flat[keep], owner[keep]
    return out


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of ``rows`` coordinates, the band's number mixed in."""
    n, t = sketches.shape
    grouped = sketches.reshape(n, t // rows, rows)
    keys = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (n, t // rows)).copy()
    for j in range(rows):
        keys = _mixed(keys * _U(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return keys


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def _sketched(docs: DataFrame, t: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, keys) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingles(x) for x in b.column(2).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = bands(sketch([sets[i] for i in full], t), rows).view(np.int64)
                lists: list = [None] * len(sets)
                for i, k in zip(full, keys, strict=True):
                    lists[i] = k
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "node", "keys"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node binary, keys array<long>")


def linked(sets: list[np.ndarray], cut: int = 0) -> np.ndarray:
    """The components of ``sets`` under 100 * common >= 80 * union, as least indices.

    With ``cut``, only pairs of an index below it and one from it on are compared, by
    pivots of the smaller side, and those below it or from it on among themselves are left
    to other calls. A pivot meets all others by counts over an index, in time that grows
    with its hits alone; pivots go on until all sets that were none are in one component,
    so every pair not known as linked is compared. The smallest component is next, so that
    a large one is left to the end.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    order = np.argsort(ids, kind="stable")
    posting = np.repeat(np.arange(n), sizes)[order]
    first = np.searchsorted(ids[order], np.arange(len(ids) and ids.max() + 2))
    low = cut <= n - cut
    pivots = range(n) if not cut else range(cut) if low else range(cut, n)
    label = np.arange(n)
    members = {i: [i] for i in range(n)}
    todo = {i: [i] if i in pivots else [] for i in range(n)}
    # of each component, its sets that were no pivots yet; how many components have any
    alive, live = dict.fromkeys(range(n), 1), n
    heap = [(1, i) for i in pivots]
    while heap and live > 1:
        size, k = heappop(heap)
        if k not in members or alive[k] != size or not todo[k]:
            continue  # an entry from before the component changed
        p = todo[k].pop()
        alive[k] -= 1
        live -= not alive[k]
        mine = ids[ends[p] - sizes[p] : ends[p]]
        met, common = np.unique(np.concatenate([posting[first[x] : first[x + 1]] for x in mine]), return_counts=True)
        near = 100 * common >= PERCENT * (sizes[met] + sizes[p] - common)
        if cut:
            near &= (met < cut) != (p < cut)
        joined = {k, *label[met[near]].tolist()}
        root = max(joined, key=lambda x: len(members[x]))
        for x in joined - {root}:
            live -= bool(alive[x]) and bool(alive[root])
            label[members[x]] = root
            members[root] += members.pop(x)
            todo[root] += todo.pop(x)
            alive[root] += alive.pop(x)
        if todo[root]:
            heappush(heap, (alive[root], root))
    for ms in members.values():
        label[ms] = min(ms)
    return label


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each task key's sets; rows of a key follow one another."""
    key, sides = None, ({}, {})

    def flush() -> Iterator[tuple[bytes, bytes]]:
        both = key is not None and key[1] != key[2]
        if both and not (sides[0] and sides[1]):
            return
        names = [*sides[0], *sides[1]] if both else [*sides[0]]
        sets = [*sides[0].values(), *sides[1].values()] if both else [*sides[0].values()]
        if len(names) > 1:
            for i, root in enumerate(linked(sets, len(sides[0]) if both else 0)):
                if i != root:
                    yield names[root], names[i]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.binary()) for j in (0, 1)], ["a", "b"])

    out: list = []
    for b in batches:
        cols = [b.column(j) for j in range(5)]
        for i in range(b.num_rows):
            now = (cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py())
            if now != key:
                out += flush()
                key, sides = now, ({}, {})
            s = shingles(cols[4][i].as_py())
            if len(s):
                sides[int(cols[3][i].as_py() != now[1])].setdefault(_node(s), s)
        if len(out) > 10_000:
            yield batch(out)
            out = []
    out += flush()
    yield batch(out)


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(cluster, level, first, blocks, low, high) for each level of a cluster's ``members``.

    Its ``blocks`` are numbered from ``first``, and their sets can be near those of blocks
    ``low`` to ``high``. A cluster that fits into one block is one. A cluster has as many
    rows here as there are levels, some hundred at most.
    """
    sizes = members.groupBy("cluster", "level").agg(F.sum("n_shingles").alias("s"))
    sizes = sizes.withColumn("whole", F.sum("s").over(W.partitionBy("cluster")) <= block).withColumn("blocks", F.ceil(F.col("s") / block).cast("int"))
    up = W.partitionBy("cluster").orderBy("level")
    near = up.rangeBetween(-1, 1)
    sizes = sizes.withColumn("end", F.sum("blocks").over(up.rowsBetween(W.unboundedPreceding, 0)).cast("int")).withColumn("first", F.col("end") - F.col("blocks"))
    sizes = sizes.withColumn("low", F.min("first").over(near)).withColumn("high", F.max("end").over(near) - 1)
    one = lambda c, v: F.when(F.col("whole"), v).otherwise(F.col(c)).alias(c)
    return sizes.select("cluster", "level", one("first", 0), one("blocks", 1), one("low", 0), one("high", 0))


def near_components(docs: DataFrame, coordinates: int = COORDINATES, rows: int = ROWS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) for every row of ``docs`` (doc_id, text).

    ``component`` identifies the documents reachable over links, and ``component_id`` is
    their least doc_id; both are null where a text has no words (such texts link with
    nothing). Repeated rows are in one component; texts of any length are read whole; an
    empty table gives no rows. With 32
    bands of 4 a pair at similarity 0.8 shares none with probability 5e-8; what shares one
    is verified on full sets.
    """
    all_ = write_stage(_sketched(docs, coordinates, rows), "sketches")
    # a row for each distinct set; its text is fetched by the least (text_hash, doc_id)
    rep = F.min(F.struct("text_hash", "doc_id")).alias("rep")
    copies = F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")
    nodes = all_.where("node is not null").groupBy("node").agg(rep, *copies, F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    nodes = write_stage(nodes, "nodes")
    placed = nodes.select("node", F.explode("keys").alias("key"))
    least = placed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    star = placed.join(least, "key").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    clusters = connected_components(star).withColumnRenamed("component", "cluster")
    members = clusters.join(nodes.select("node", "rep", "n_shingles"), "node")
    members = members.withColumn("level", F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(LEVEL))).cast("int"))
    members = members.join(_blocks(members, block), ["cluster", "level"])
    members = write_stage(members.select("cluster", "node", F.col("rep.text_hash").alias("h"), F.col("rep.doc_id").alias("d"), "first", "blocks", "low", "high"), "members")
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = found.join(members.hint("shuffle_hash"), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")))
    # a task for each pair of blocks that can hold a near pair
    found = found.withColumn("own", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence("low", "high")))
    tasks = found.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "text")
    tasks = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = write_stage(tasks.mapInArrow(_verify, "a binary, b binary"), "links")
    if members.where("low < high").limit(1).count():
        joined = connected_components(links)
    else:  # forests of whole clusters are stars already
        joined = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    # a component's nodes, and a node's documents, may be a third of all: both joins part hot keys
    classes = nodes.select("node", "copies", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = write_stage(classes, "classes")
    least = write_stage(classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    classes = write_stage(join_hot(classes.drop("least"), least, "component", ["node"], "n"), "classes")
    return join_hot(all_.drop("keys"), classes, "node", ["doc_id", "text_hash"], "copies").drop("node")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and ``kept`` for every row of ``docs``.

    ``component_id`` is the least doc_id reachable, itself included; a null doc_id is in
    no comparison and takes the least of the others, or null. ``kept`` is true on the
    rows whose doc_id that is.
    """
    d = near_components(docs, **how)
    d = d.withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return d.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(df: DataFrame, **how) -> DataFrame:
    """The rows of ``df`` (doc_id, text and any others) that stay: one of each component.

    It has the least doc_id of its component, a null one only if there is no other, and
    of texts under the same id the one with the least hash; of repeated rows with the
    same id and text one stays. Texts without words all stay, as they are near nothing.
    """
    keep_hash, keep_id, own, repeated = fresh(df, "__keep_hash", "__keep_id", "__hash", "__repeated")
    d = near_components(df.select("doc_id", "text"), **how).groupBy("component", "text_hash", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("first")
    one = d.where("component is not null").groupBy("component").agg(first).select("first.text_hash", "first.doc_id", (F.col("first.n") > 1).alias(repeated))
    kept = one.unionByName(d.where("component is null").select("text_hash", "doc_id", F.lit(False).alias(repeated)))
    kept = write_stage(kept.withColumnsRenamed({"text_hash": keep_hash, "doc_id": keep_id}), "kept")
    met = df.withColumn(own, F.xxhash64("text")).join(kept, (F.col(own) == F.col(keep_hash)) & F.col("doc_id").eqNullSafe(F.col(keep_id)))
    # only what repeats is dealt out once more
    out = met.where(~F.col(repeated)).unionByName(met.where(F.col(repeated)).dropDuplicates([own, "doc_id"]))
    return out.drop(own, keep_hash, keep_id, repeated)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate components."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- a pair at 80 % shares one of the rarest fifth of either's shingles
f AS (SELECT g, count(*) AS c FROM s GROUP BY g), r AS (
  SELECT s.doc_id, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.c, s.g) AS p, n.n FROM s JOIN f USING (g) JOIN n USING (doc_id) WHERE f.c > 1 OR true
), x AS (SELECT * FROM r WHERE p <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), e AS (
  SELECT c.a, c.b FROM c JOIN s s1 ON s1.doc_id = c.a JOIN s s2 ON s2.doc_id = c.b AND s2.g = s1.g GROUP BY c.a, c.b, c.na, c.nb
  HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))
), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a
), k AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, k.doc_id = k.component_id AS kept FROM k LEFT JOIN n USING (doc_id)
"""
