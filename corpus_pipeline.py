"""The corpus pipeline: five stages over documents, each on all that the one before kept.

quality     documents that the quality rules reject go
neardup     one document of each near-duplicate component stays
secrets     secrets in the texts are replaced by a mark, and n_chars follows
mixing      rows are repeated or left out to meet the sources' target weights
bpe         texts become token ids

All but the last return the columns of documents; other columns, whatever their names,
are left out. A stage copes with an empty table: its result is empty too. Null texts
fail the quality rules, null ids, languages and sources are values like any other.
Repeated rows fall to near-dedup, which keeps one; the mix may draw it twice. Texts of
any length are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm.bpe import encode
from leafwright.llm.common import n_words
from leafwright.llm.mixing import mix, shuffled
from leafwright.llm.neardup import deduplicate
from leafwright.llm.quality import score_quality
from leafwright.llm.secrets import scan_with_ledger
from leafwright.session import write_stage
from leafwright.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Tokenization can't be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return score_quality(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the least doc_id."""
    return deduplicate(docs.select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    found = scan_with_ledger(docs.select(COLUMNS))
    changed = F.size("spans") > 0
    n = F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n.alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, up to twice, in the shards' shuffled order."""
    sized = docs.select(COLUMNS).withColumn("size", n_words(F.col("text")))
    return shuffled(mix(sized)).select(COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("neardup", neardup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between them, tables in the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
