"""Connected components of an edge table, by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) point every node at the
smallest one that it can see until nothing changes. Minima are taken by partial
aggregates, so a node with a huge number of neighbours costs one row a task, and
the joins back are plain equi-joins that adaptive execution splits when skewed.
Each round ends in a written table; only one count a round reaches the driver. A
table that, counted, has few edges is finished in one task instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memloom.shared import cut, drop

#: Edges that one task may hold: some 50 MB.
MOST_LOCAL = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``u > v``: every pair it makes again has ``u > v``."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(low, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "u", b: str = "v", rounds: int = 60, most: int = MOST_LOCAL) -> DataFrame:
    """``node, label`` of every node of an edge that isn't a loop; ``label`` is the component's smallest node."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = cut(e, "edges")
    # The pairs' number and a sum over them; they stay the same when no pair changes.
    seen = lambda: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = seen()
    if before[0] <= most:
        return _in_one_task(e)
    for _ in range(rounds):
        former, e = e, cut(_star(_star(e, True), False), "star")
        drop(former)
        now = seen()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = dict(edges.dtypes)["u"]
    arrow = to_arrow_type(edges.schema["u"].dataType)

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=pa.schema([("u", arrow), ("v", arrow)]))
        nodes, label = smallest(held.column("u").to_numpy(), held.column("v").to_numpy())
        yield pa.record_batch([pa.array(nodes, arrow), pa.array(label, arrow)], names=["node", "label"])

    return cut(edges.coalesce(1).mapInArrow(solve, f"node {kind}, label {kind}"), "components")


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least = low.copy()
        np.minimum.at(least, low[a], low[b])
        np.minimum.at(least, low[b], low[a])
        while not np.array_equal(jump := least[least], least):
            least = jump
        if (least == low).all():
            return nodes, nodes[low]
        low = least[low]
