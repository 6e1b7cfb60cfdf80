"""Operator 10, secret scans with an incremental blob ledger.

Each version of a text at a path is addressed by the SHA-256 of its content. The
ledger holds, for each blob and rule version, what a scan has found in it, clean blobs
with empty findings too. Blobs that it lacks are found by their addresses before any
pattern runs; each is scanned once however many paths hold it, new rows join the
ledger, and findings are joined back to all paths.

A pre-filter, a pattern that every rule's matches satisfy, keeps texts that cannot
hold a secret from leaving the JVM: they have no findings under any rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_stage
from ..sources.tables import load
from .common import fresh, join_hot, slices, text_of, without

RULE_VERSION = "1"
#: Setting that names the ledger's folder; without it a scan begins a ledger of its own.
LEDGER = "spark.leafwright.secrets.ledger"
_KEYWORD = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
#: kind, pattern (its group 1 is measured), fewest characters. The first three are the base.
RULES = (
    ("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"(AKIA[A-Z0-9]+)", 18),
    ("hex", r"([0-9a-f]+)", 16),
    ("key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1),
    ("forge", r"(gh[opsu]_[A-Za-z0-9]+)", 40),
    ("chat", r"(xox[abprs]-[A-Za-z0-9-]+)", 15),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+)", 30),
    ("login", r"([a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._!$*+-]+@)", 12),
)
BASE = 3
#: Every match of every rule contains a match of this.
PREFILTER = (
    r"""[0-9a-f]{16}|AKIA[A-Z0-9]{14}|-----BEGIN |gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-|eyJ[A-Za-z0-9_-]|://[A-Za-z0-9._-]+:|"""
    + _KEYWORD
    + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
)
#: The same rules for long texts, as searches whose time grows with the text alone: a scheme's letters are tried
#: from their first one only, and a token's three parts are looked for among parts already split.
_LINEAR = {"login": r"(?<![a-z])([a-z]++://[A-Za-z0-9._-]++:[A-Za-z0-9._!$*+-]++@)"}
_COMPILED = [(re.compile(_LINEAR.get(k, p)), n) for k, p, n in RULES]
_PARTS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:[.][A-Za-z0-9_-]++)++")
_JWT = [k for k, _, _ in RULES].index("jwt")


def _jwts(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what the rule jwt matches."""
    for m in _PARTS.finditer(text) if "eyJ" in text else ():
        parts = m[0].split(".")
        ends, at = [], m.start()
        for p in parts:
            at += len(p)
            ends.append(at)
            at += 1
        i = 0
        while i + 2 < len(parts):
            k = parts[i].find("eyJ")
            if 0 <= k < len(parts[i]) - 3:
                yield ends[i] - len(parts[i]) + k, ends[i + 2]
                i += 3
            else:
                i += 1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of all secrets, by start and rule; end exclusive, in code points."""
    found = [(m.start(), i, m.end()) for i, (p, n) in enumerate(_COMPILED) if i != _JWT for m in p.finditer(text) if len(m[1]) >= n]
    return sorted([*found, *((a, _JWT, b) for a, b in _jwts(text) if b - a >= RULES[_JWT][2])])


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "<SECRET>") -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_LEDGER = f"blob string, rule_version string, spans {_SPANS}, redacted string"


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Scan (blob, text): a ledger row each with its spans, and its redacted text where there are any."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            found = [find(t) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([RULE_VERSION] * b.num_rows, pa.string()),
                    pa.array([[{"kind": RULES[i][0], "start": s, "end": e} for s, i, e in f] for f in found], span),
                    pa.array([redact(t, f) if f else None for t, f in zip(texts, found, strict=True)], pa.string()),
                ],
                ["blob", "rule_version", "spans", "redacted"],
            )

    suspect = F.when(F.col("text").rlike(PREFILTER), F.col("text"))
    return blobs.select("blob", suspect.alias("text")).mapInArrow(run, _LEDGER)


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The ledger in folder ``path``; None where there is none yet."""
    if not path:
        return None
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(df: DataFrame, text: str = "text", ledger: DataFrame | None = None, keep_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """Scan the versions in ``df``: (``df`` with blob, spans and ``redacted`` text; new ledger rows).

    ``ledger`` holds the rows that earlier calls returned, repeated ones or not. No pattern
    meets a blob that it has under the present rule version; all others get a new row.
    ``spans`` is an empty array where nothing is found, and ``redacted`` the text itself.
    Null texts have the blob of the empty one and stay null; texts of any length are
    scanned whole; repeated rows have equal results. An empty table gives no rows and no
    ledger. Without ``keep_text`` the result lacks ``text`` and ``redacted``.
    """
    df = without(df, "blob", "spans", "redacted")
    versions = df.withColumn("blob", F.sha2(text_of(text), 256))
    unseen, known = versions.select("blob", text_of(text).alias("text")), None
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"])
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    # copies meet as one row for each task, and the hot blob as few
    new = write_stage(scan_blobs(unseen.groupBy("blob").agg(F.first("text").alias("text"))), "ledger")
    found = new if known is None else new.unionByName(known)
    paths = versions.groupBy("blob").agg(F.count(F.lit(1)).alias("paths"))
    hits = found.where(F.size("spans") > 0).join(paths, "blob").select("blob", "spans", "redacted", "paths")
    hits = write_stage(hits if keep_text else hits.drop("redacted"), "hits")
    (row,) = fresh(versions, "__row")
    out = join_hot((versions if keep_text else versions.drop(text)).withColumn(row, F.monotonically_increasing_id()), hits, "blob", [row], "paths").drop(row)
    out = out.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")))
    return (out.withColumn("redacted", F.coalesce("redacted", F.col(text))) if keep_text else out), new


def scan_with_ledger(df: DataFrame, text: str = "text", keep_text: bool = True, path: str | None = None) -> DataFrame:
    """:func:`scan` by the ledger in folder ``path``, by default the one that the setting ``LEDGER`` names; new rows are added to it."""
    spark = df.sparkSession
    path = path or spark.conf.get(LEDGER, None)
    found, new = scan(df, text, read_ledger(spark, path), keep_text)
    if path:
        new.write.mode("append").parquet(path)
    return found


def _joined(spans: str) -> F.Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a null text is empty. The ledger is the one that the session names, if any."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_with_ledger(docs, keep_text=False)
    found = found.withColumn("base", F.expr("filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        "blob",
    )


def _oracle() -> str:
    """The same by DuckDB: gaps and matches alternate, so their lengths sum to places."""
    cuts, spans = [], []
    for i, (kind, pattern, least) in enumerate(RULES):
        group = pattern.replace("'", "''")
        # without a capturing group, for the split
        whole = group.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+") if i == 0 else group[1:-1]
        cuts += [
            f"list_transform(string_split_regex(t, '{whole}'), lambda x: length(x)) AS g{i}",
            f"list_transform(regexp_extract_all(t, '{whole}'), lambda x: length(x)) AS w{i}",
            f"list_transform(regexp_extract_all(t, '{group}', 1), lambda x: length(x)) AS m{i}",
        ]
        spans.append(
            f"list_filter([{{'s': coalesce(list_sum(g{i}[1:x]), 0) + coalesce(list_sum(w{i}[1:x-1]), 0), 'o': {i}, 'k': '{kind}', 'n': w{i}[x], 'm': m{i}[x]}} "
            f"FOR x IN range(1, len(w{i}) + 1)], lambda r: r.m >= {least}) AS k{i}"
        )
    name = "lambda r: r.k || ':' || CAST(r.s AS BIGINT) || ':' || CAST(r.s + r.n AS BIGINT)"
    joined = lambda n: f"array_to_string(list_transform(list_sort(flatten([{', '.join(f'k{i}' for i in range(n))}])), {name}), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS MATERIALIZED (SELECT doc_id, sha256(t) AS blob, {", ".join(cuts)} FROM d),
f AS MATERIALIZED (SELECT doc_id, blob, {", ".join(spans)} FROM c)
SELECT doc_id, CAST(len(k0) AS BIGINT) AS n_assign, CAST(len(k1) AS BIGINT) AS n_access, CAST(len(k2) AS BIGINT) AS n_hex,
  sha256({joined(BASE)}) AS base_sha256, {joined(len(RULES))} AS spans, blob FROM f"""


OP10_SQL = _oracle()
