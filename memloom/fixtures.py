"""The driver's tables as the store's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.plans.search import Memory
from memloom.shared import table

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as live facts; every third names its label twice, so contents repeat."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.col("vec_id").alias("id"), F.concat(F.lit("stored fact about topic "), "label", F.lit(" number "), F.col("vec_id") % 97).alias("full_key"), F.col("label").cast("string").alias("category"),
        "embedding", F.lit(None).cast("timestamp").alias("valid_to"), F.lit("2024-01-30 00:00:00").cast("timestamp").alias("created_at"), F.col("label"), (F.col("label") % 5 + 1).cast("int").alias("importance"),
        (F.col("label") % 10 / 10.0).alias("trust"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages, a minute a turn, ending before ``AS_OF``."""
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_micros(F.unix_micros(F.lit("2024-01-28 00:00:00").cast("timestamp")) + (F.col("turn") * 60 + F.col("conv_id") % 1000) * 1_000_000)
    return c.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), ts.alias("timestamp"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' suppliers as typed relations with a history."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("weight"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks, with a benchmark text for words."""
    items = table(spark, sf_dir, "benchmark")
    n = F.broadcast(items.agg((F.max("item_id") + 1).alias("n")))  # one row
    v = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").crossJoin(n)
    return v.join(items, F.expr("vec_id div 50 % n") == items["item_id"]).select(F.col("vec_id").alias("query_id"), F.col("text").alias("query"), "embedding")


def memory(spark: SparkSession, sf_dir: str) -> Memory:
    facts = vectors(spark, sf_dir)
    links = facts.select(F.col("id").alias("from_id"), ((F.col("id") * 7 + 3) % 499).alias("to_id"), F.lit("similar").alias("kind"), F.lit(0.83).alias("weight"))
    return Memory(facts, links, messages(spark, sf_dir))
