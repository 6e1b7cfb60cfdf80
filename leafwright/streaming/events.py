"""Event streams: validation, gapless numbering per run, and windowed latency percentiles."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, event_id long, ts timestamp, kind string, value double"
KINDS = ("started", "delta", "tool_call", "tool_result", "retract", "commit", "completed", "failed", "cancelled")


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the JSON event files that arrive in ``folder``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)


def valid(events: DataFrame) -> DataFrame:
    """Events of a known kind with all required fields."""
    return events.where(F.col("kind").isin(*KINDS) & F.col("run_id").isNotNull() & F.col("event_id").isNotNull() & F.col("ts").isNotNull())


def numbered(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each run's events numbered from 1 in order of arrival, without gaps.

    The count is keyed state, so each run has one writer. A batch's events of a run go by
    time and id. An event that comes again within ``late`` is passed over, so it keeps its number.
    """
    import pandas as pd

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        d = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        state.update((n + len(d),))
        yield pd.DataFrame({"run_id": key[0], "event_id": d["event_id"], "seq": range(n + 1, n + 1 + len(d))})

    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "event_id"])
    return once.groupBy("run_id").applyInPandasWithState(run, "run_id string, event_id long, seq long", "n long", "append", "NoTimeout")


def windowed_latency(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, p95 and p99 of each sliding window; events later than ``late`` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide))
    return w.agg(F.count("value").alias("n"), F.percentile("value", 0.95).alias("p95"), F.percentile("value", 0.99).alias("p99")).select("window.start", "window.end", "n", "p95", "p99")
