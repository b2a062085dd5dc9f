"""A fold that is kept as a snapshot and moved on by what is new, in buckets of the hash of its key.

A run folds the new rows alone, reads the buckets that they touch, merges both and writes those
buckets again; others are neither read nor written. So an increment costs what is new and the
buckets that it meets, whatever has been folded before.

Each bucket has two slots. A run writes the slot that is not in use, by dynamic partition
overwrite, with the high-water mark up to which it folds in the column ``upto``; it holds once that mark
is appended to ``marks``, which is the last thing that a run does. A run that was cut off has changed
nothing that is read, and the next one writes the same slots again. Two slots are all that is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.shared import cut, drop, there_or_empty

BUCKETS = 64
Fold = Callable[[DataFrame], DataFrame]


def keys(rows: DataFrame, key: str) -> list[str]:
    """What a fold groups by: the key, and the bucket that goes with it where rows have it."""
    return [c for c in ("bucket", key) if c in rows.columns]


def marks(spark: SparkSession, path: str) -> DataFrame:
    """``upto`` of all whole runs, a row each."""
    return there_or_empty(spark, f"{path}/marks", "upto long")


def mark(spark: SparkSession, path: str) -> int | None:
    """The high-water mark of the last whole run, or None before the first."""
    return marks(spark, path).agg(F.max("upto")).first()[0]


def _held(spark: SparkSession, path: str, schema: str, upto: int | None) -> dict[int, int]:
    """The slot in use of each bucket, as of a mark."""
    if upto is None:
        return {}
    rows = _rows(spark, path, schema).filter(F.col("upto") <= upto)
    # As many rows as buckets.
    return {r["bucket"]: r["slot"] for r in rows.groupBy("bucket").agg(F.max_by("slot", "upto").alias("slot")).collect()}


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return there_or_empty(spark, f"{path}/rows", f"{schema}, upto long, slot int, bucket int")


def _of(spark: SparkSession, path: str, schema: str, slots: dict[int, int]) -> DataFrame:
    """The rows of some buckets: the scan reads only their folders."""
    if not slots:
        return spark.createDataFrame([], schema)
    sides = [sorted(b for b, s in slots.items() if s == side) for side in (0, 1)]
    some = F.lit(False)
    for side, buckets in enumerate(sides):
        if buckets:
            some = some | ((F.col("slot") == side) & F.col("bucket").isin(buckets))
    return _rows(spark, path, schema).filter(some).drop("upto", "slot", "bucket")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fold as it stands."""
    return _of(spark, path, schema, _held(spark, path, schema, mark(spark, path)))


def advance(spark: SparkSession, path: str, new: DataFrame, upto: int, key: str, fold: Fold, buckets: int = BUCKETS) -> int:
    """Merge the folded rows of ``new`` into the snapshot and set the mark to ``upto``. Returns the number of buckets written.

    ``fold`` brings rows of a key together, and takes its own results as rows: ``fold(a + fold(b)) = fold(a + b)``.
    One that keeps a column ``bucket``, where rows have it, as a part of the key (``keys``) spares an exchange of all rows.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = cut(fold(new), "snapshot-new")
    touched = [r["bucket"] for r in fresh.select(bucket.alias("bucket")).distinct().collect()]  # ``buckets`` at most
    held = _held(spark, path, schema, mark(spark, path))
    old = _of(spark, path, schema, {b: held[b] for b in touched if b in held})
    slot = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for b in touched for x in (b, 1 - held.get(b, 1)))), F.col("bucket")), F.lit(0)) if touched else F.lit(0)
    if touched:
        rows = old.unionByName(fresh).withColumn("bucket", bucket)
        out = fold(rows.repartition("bucket"))  # buckets are folded where they are written
        if "bucket" not in out.columns:
            out = fold(rows.drop("bucket")).withColumn("bucket", bucket).repartition("bucket")
        out = out.withColumns({"upto": F.lit(upto).cast("long"), "slot": slot})
        out.sortWithinPartitions("slot", "bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "bucket").parquet(f"{path}/rows")
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{path}/marks")
    drop(fresh)
    return len(touched)
