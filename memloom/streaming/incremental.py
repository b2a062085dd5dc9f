"""Incremental processing as Structured Streaming: what trackers and cron jobs remember, checkpoints do here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from memloom.functions.text import fact_hash


def idle_windows(messages: DataFrame, minutes: int = 30, ts: str = "timestamp", by: str = "session_id") -> DataFrame:
    """``session, started, ended, messages`` of conversations that have rested; late messages within the gap still count."""
    gap = f"{minutes} minutes"
    w = F.session_window(ts, gap)
    return messages.withWatermark(ts, gap).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("messages")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "messages")


def new_facts(facts: DataFrame, ts: str = "ts", late: str = "1 day", key: str = "key") -> DataFrame:
    """Facts whose normalised key was not seen within the watermark."""
    return facts.withColumn("fact_hash", fact_hash(key)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["fact_hash"])


def sightings(facts: DataFrame, key: str = "key") -> DataFrame:
    """``fact_hash, seen_count``, kept up to date."""
    return facts.groupBy(fact_hash(key).alias("fact_hash")).agg(F.count(F.lit(1)).alias("seen_count"))


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes what has come since the last run and stops. A batch counts as done only after ``step`` has returned, so steps must be idempotent by batch."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A step that writes a batch into a folder of its own, which a repeated batch overwrites."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step
