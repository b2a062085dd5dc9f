"""Fusion of ranked lists, time decay, deduplication by content and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import format_age
from memloom.shared import first_rows

K, GRAPH_WEIGHT, TEXT_WEIGHT, REPEAT = 60, 1.5, 1.0, 0.5
ECHO_SECONDS, ECHO_SHARE = 60, 0.85


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp with or without a zone (then in the session's)."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def decay(ts: Column, as_of: Column, rate: float = 0.01) -> Column:
    """e to the minus rate times the age in days; 1 without a time."""
    age = (seconds(as_of) - seconds(ts)) / 86400
    return F.when(ts.isNull() | (seconds(ts) <= 0), F.lit(1.0)).otherwise(F.exp(-rate * age))


def rrf(graph: DataFrame, text: DataFrame, query: str = "query_id", content: str = "content", rank: str = "rank", ts: str | None = None, as_of: Column | None = None, rate: float = 0.0, k: int = K) -> DataFrame:
    """``query, content, rrf_score, rank`` over two ranked lists.

    A content's first place in the graph list counts 1.5; later places there count
    nothing. A place in the text list counts 1 if the content is new, else half.
    """
    one = lambda df, list_no: df.select(query, content, F.col(rank).alias("_r"), F.lit(list_no).alias("_list"), (F.col(ts) if ts and ts in df.columns else F.lit(None)).cast("timestamp").alias("_ts"))
    both = one(graph, 0).unionByName(one(text, 1)).withColumn("_h", F.md5(content))
    nth = F.row_number().over(Window.partitionBy(query, "_h").orderBy("_list", "_r"))
    fade = decay(F.col("_ts"), as_of, rate) if rate > 0 and as_of is not None else F.lit(1.0)
    weight = F.when((F.col("_list") == 0) & (F.col("_n") == 1), F.lit(GRAPH_WEIGHT)).when(F.col("_list") == 0, F.lit(0.0)).when(F.col("_n") == 1, TEXT_WEIGHT * fade).otherwise(REPEAT * TEXT_WEIGHT * fade)
    scored = both.withColumn("_n", nth).withColumn("_s", weight / (k + F.col("_r")))
    fused = scored.groupBy(query, "_h").agg(F.first(content).alias(content), F.sum("_s").alias("rrf_score"), F.min(F.struct("_list", "_r")).alias("_at"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("rrf_score", 12)), "_at"))
    return fused.withColumn("rank", place).select(query, content, "rrf_score", "rank")


def place_score(place: Column, top: float, step: float = 0.03) -> Column:
    """A stand-in similarity from a place counted from 0."""
    return F.lit(top) - step * place


def keep_first(rows: DataFrame, content: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first row of each content."""
    return first_rows(rows, [*(F.col(c) for c in by or []), F.md5(content)], order)


def in_window(ts: Column, as_of: Column, max_age_days: float, echo: float = ECHO_SECONDS) -> Column:
    """Neither so new that it may be an echo of the query, nor too old."""
    age = seconds(as_of) - seconds(ts)
    return (age >= echo) & (age <= max_age_days * 86400)


def is_echo(text: Column, query: Column, share: float = ECHO_SHARE) -> Column:
    """The text holds nearly all words of a query of more than three."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))
    asked = words(query)
    return (F.size(asked) > 3) & (F.size(F.array_intersect(asked, words(text))) / F.size(asked) > share)


def of_agent(rows: DataFrame, agent: str | None, column: str = "agent_id") -> DataFrame:
    return rows if agent in (None, "all", "*") else rows.filter(F.col(column) == agent)


def render(rows: DataFrame, as_of: Column, most: int = 5, by: str = "query_id") -> DataFrame:
    """``query, context``: the best rows of each query as lines ``- [score][source] content``."""
    age = format_age(seconds(as_of) - seconds(F.col("timestamp")))
    source = F.when(F.col("type") == "session", F.concat(F.lit("session"), F.when(F.col("timestamp").isNotNull(), F.concat(F.lit(":"), age)).otherwise("")))
    source = source.when(F.col("type") == "fact", F.concat(F.lit("graph:"), F.col("project"), F.when(F.col("expanded"), "·1hop").otherwise(""))).otherwise(F.col("type"))
    line = F.format_string("- [%.2f][%s] %s", F.col("rrf_score"), source, F.col("content"))
    top = rows.filter(F.col("rank") <= most).select(by, "rank", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return top.groupBy(by).agg(F.concat(F.lit("## Memory Context\n\n"), F.array_join(lines, "\n")).alias("context"))
