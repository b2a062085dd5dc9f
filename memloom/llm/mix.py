"""Mixing sources to target weights. DataFrame functions only.

Tokens are aggregated per source, each source's repetition rate follows from its
target, and every document is emitted ``floor(rate)`` times, plus one more copy
by a Bernoulli draw with the fraction as its probability. The draw hashes the
seed and the document's id, so reruns agree and no state is kept.

Targets: the sources, in code-point order with null last, weigh ``weights`` in
turn and share ``share`` times all tokens. A target stops at ``cap`` times its
source's size and the excess goes to the others by weight, until none is above.
That has a closed form: in order of ``cap * size / weight`` the sources fill up
one after another, and the level of the rest is what is left over their weights.

The table of sources is aggregated before anything is joined. It is broadcast
while it has at most ``BROADCAST_SOURCES`` rows, which is checked; beyond that the
join is a plain shuffle join, in which Spark splits a hot source's rows.

Defined results: a null text has size 0 and a null source is a source of its
own; sources of size 0 have target 0; null ids draw as the id ``null``; rows that
repeat an id draw alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.shared import cut

BROADCAST_SOURCES = 10_000
SEED = "mix-1"


def words(text: Column) -> Column:
    """The number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(id_: Column, seed: str) -> Column:
    """Uniform in [0, 1), from the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column], most: int) -> DataFrame:
    """``rows`` with sums over the rows before each, in ``order``.

    Up to ``most`` rows, which are counted, one task adds them up; more are dealt by ranges of the order, and each
    range adds the sums of the ranges before it, of which there are as many as shuffle partitions.
    """
    before = lambda w: {n: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n, c in sums.items()}
    if rows.limit(most + 1).count() <= most:
        return rows.withColumns(before(Window.orderBy(*order)))
    held = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    part = held.groupBy("range").agg(*(F.sum(c).alias(f"part_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.select("range", *(F.coalesce(F.sum(f"part_{n}").over(earlier), F.lit(0)).alias(f"start_{n}") for n in sums))
    out = held.withColumns(before(Window.partitionBy("range").orderBy(*order))).join(F.broadcast(starts), "range")
    return out.select(*rows.columns, *((F.col(n) + F.col(f"start_{n}")).alias(n) for n in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, most: int = BROADCAST_SOURCES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source."""
    s = _running(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"turn": F.lit(1)}, most)
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double")
    s = s.withColumns({"w": w, "limit": F.col("source_size") * F.lit(cap)})
    s = _running(s, [(F.col("limit") / F.col("w")).asc(), F.col("turn").asc()], {"full": F.col("limit"), "taken_w": F.col("w")}, most)
    whole = s.agg((F.sum("source_size") * F.lit(share)).alias("all"), F.sum("w").alias("all_w"))  # one row
    s = s.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("all") - F.col("full")) / (F.col("all_w") - F.col("taken_w")))
    # The first source below its limit sets the level for all after it.
    level = s.agg(F.max(F.when(F.col("limit") >= F.col("level") * F.col("w"), F.col("level"))).alias("level"))  # one row
    s = s.drop("level").crossJoin(F.broadcast(level))
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("w"))).alias("target"))


def _rated(rows: DataFrame, seed: str, **how) -> DataFrame:
    """``_id, _size, _source`` rows with their source's figures and ``_copies``."""
    sizes = cut(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), "mix-sizes-of-sources")
    rates = cut(targets(sizes, **how), "mix-sources")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    out = rows.join(rates, F.col("_source").eqNullSafe(F.col("source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.col("_id"), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn("_copies", F.floor(rate) + extra)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words(F.col(text_col)).alias("_size")), "mix-sizes")
    out = _rated(rows, seed, **how)
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("source_size"), F.col("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with its own columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words(F.col(text_col)).alias("_size"))
    out = _rated(rows, seed, **how).filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return out.select("_row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][turn % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
  FROM w WINDOW b AS (ORDER BY lim / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN lim >= lv * w THEN lv END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN lim ELSE least(lim, level * w) END AS target FROM m),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken FROM r
"""
