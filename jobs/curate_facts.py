"""Curates texts into a store of facts: gates, one fact for each normalised text, how often and where it was seen.

    python -m jobs.curate_facts --input /data/documents.parquet --output /data/facts

A run takes the rows whose id lies above the high-water mark of the last one. Texts that a gate rejects go
to ``rejected``, partitioned by ``upto`` (the run's mark) and ``rule``; the others are folded by the hash of
their normalised text into ``facts`` (``memloom.operators.snapshot``): the first text and its category, the
number of sightings, the first and the last id. Only the buckets that new facts touch are read and written.

Ids grow: a row with an id at or below the mark is not taken, nor is one without an id; both are
told in the log (``late``, when a row count no longer fits). The mark is the last thing that is written,
so a run that was cut off is simply run again, and a run without new rows changes nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cli
from memloom.functions.gates import junk_rule
from memloom.functions.text import fact_hash
from memloom.operators import snapshot
from memloom.shared import cut, dealt, drop, there_or_empty

NAME = "curate_facts"
FACTS = "fact_hash string, full_key string, category string, seen_count long, first_id long, last_id long"
log = logging.getLogger(NAME)


def fold(rows: DataFrame) -> DataFrame:
    """One row for each hash; of several the first id's text and category hold."""
    first = lambda c: F.min_by(c, F.struct("first_id", "full_key", "category")).alias(c)
    by = snapshot.keys(rows, "fact_hash")
    out = rows.groupBy(*by).agg(first("full_key"), first("category"), F.sum("seen_count").alias("seen_count"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    return out.select(*by, "full_key", "category", "seen_count", "first_id", "last_id")


def facts(spark: SparkSession, output: str) -> DataFrame:
    """The store as it stands."""
    return snapshot.current(spark, f"{output}/facts", FACTS)


def rejected(spark: SparkSession, output: str) -> DataFrame:
    """``id, rule`` of all texts that gates have rejected, of whole runs."""
    from_runs = F.broadcast(snapshot.marks(spark, f"{output}/facts").distinct())  # a row a run; what a run that was cut off has left is none of theirs
    rows = there_or_empty(spark, f"{output}/rejected", "id long, upto long, rule string")
    return rows.join(from_runs, "upto", "left_semi").select("id", "rule")


def run(spark: SparkSession, settings: dict) -> dict:
    """Curate the rows that are new. Returns what was read and written."""
    output, home = settings["output"].rstrip("/"), f"{settings['output'].rstrip('/')}/facts"
    mark = snapshot.mark(spark, home)
    key: Column = F.col(settings["id"]).cast("long")
    source = spark.read.parquet(settings["input"])
    new = source.filter(key.isNotNull() if mark is None else key > mark)
    upto = new.agg(F.max(key)).first()[0]
    if upto is None:
        log.info("nothing in %s above the mark %s", settings["input"], mark)
        return {"rows": 0, "facts": 0, "rejected": 0, "buckets": 0, "mark": mark}
    rows = dealt(new.filter(key <= upto).select(key.alias("id"), F.col(settings["text"]).alias("text"), F.col(settings["category"]).cast("string").alias("category")), "id")
    rows = cut(rows.withColumn("rule", junk_rule("text")), "curated")
    # This run's folders alone are overwritten, if it was cut off before.
    rows.filter("rule IS NOT NULL").select("id", F.lit(upto).cast("long").alias("upto"), "rule").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto", "rule").parquet(f"{output}/rejected")
    kept = rows.filter("rule IS NULL").select(fact_hash("text").alias("fact_hash"), F.col("text").alias("full_key"), "category", F.lit(1).cast("long").alias("seen_count"), F.col("id").alias("first_id"), F.col("id").alias("last_id"))
    buckets = snapshot.advance(spark, home, kept, upto, "fact_hash", fold, settings["buckets"])
    n, passed = rows.agg(F.count(F.lit(1)), F.count_if(F.col("rule").isNull())).first()
    drop(rows)
    told = {"rows": n, "facts": passed, "rejected": n - passed, "buckets": buckets, "mark": upto}
    log.info("read %d rows of %s above the mark %s; %d go to facts in %d buckets of %s, %d are rejected; the mark is %d now", n, settings["input"], mark, passed, buckets, output, n - passed, upto)
    return told


if __name__ == "__main__":
    cli.main(NAME, run)
