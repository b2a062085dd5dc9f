"""Vector search and similarity joins.

One query vector is a literal and needs no join. Sets of vectors are dealt into
cells of bounded size; a cell multiplies two blocks as matrices in an Arrow
worker, so neither side has to fit anywhere as a whole, and no pair of rows is
made that does not pass the threshold or the top-k selection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.vectors import cosine

BLOCK = 4096
#: Components of a block that has more rows: 16 MB.
WIDE = 1 << 21
#: Products that a worker holds at a time: 32 MB.
HELD = 1 << 22


def top_k(vectors: DataFrame, query: list[float], k: int = 5, least: float = 0.5, id_col: str = "id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k rows closest to one vector, with ``similarity``; equal ones by id. ``where`` (a category, a live row) is pushed to the scan."""
    rows = vectors if where is None else vectors.filter(where)
    rows = rows.filter(F.col(vector_col).isNotNull()).withColumn("similarity", cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))))
    return rows.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), id_col).limit(k)


def close_to(vectors: DataFrame, query: list[float], least: float, vector_col: str = "embedding") -> DataFrame:
    """All rows at least so close to one vector, with ``similarity`` of twelve places."""
    near = F.round(cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))), 12)
    return vectors.filter(F.col(vector_col).isNotNull()).withColumn("similarity", near).filter(F.col("similarity") >= least)


def _units(rows: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.concat_arrays(rows.column("v").chunks) if rows.num_rows else pa.array([], pa.list_(pa.float32()))
    out = np.zeros((rows.num_rows, dims))
    at = np.arange(dims)[None, :] < np.diff(lists.offsets.to_numpy())[:, None]
    out[at] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return rows.column("id").to_numpy(), out / np.where(length > 0, length, 1)


def _rows(vectors: DataFrame, id_col: str, vector_col: str, by: str | None = None) -> DataFrame:
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x))
    return vectors.filter(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), *([F.col(by).alias("of")] if by else []))


def block_of(n: int, dims: int) -> int:
    """Rows of a block for all pairs: each row is sent once for each block, so a tenth of all while a block stays small; ``BLOCK`` at least."""
    return max(BLOCK, min(-(-n // 10), WIDE // max(1, dims)))


def _measure(rows: DataFrame, block: int | None) -> tuple[int, int]:
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return max(1, -(-n // (block or block_of(n, dims or 0)))), dims or 0


def similar_pairs(vectors: DataFrame, least: float, below: float = 2.0, id_col: str = "id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """``src < dst, weight`` of all pairs with ``least <= cosine < below``. What a cell finds leaves the worker in parts, so no cell's pairs are held."""
    rows = _rows(vectors, id_col, vector_col)
    many, dims = _measure(rows, block)
    own = F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    cells = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    cells = cells.select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        ids, unit = _units(cell, dims)
        own, i, j = (cell.column(c).to_numpy() for c in ("own", "i", "j"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        yield from found_pairs(ids[left], unit[left], ids[right], unit[right], least, below, bool(i[0] == j[0]))

    return cells.groupBy("i", "j").applyInArrow(multiply, "src long, dst long, weight double")


def cross_pairs(left: DataFrame, right: DataFrame, least: float, below: float = 2.0, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``src < dst, weight`` of all pairs of a row on the left and one on the right; those with one id are no pair."""
    a, b = _rows(left, id_col, vector_col), _rows(right, id_col, vector_col)
    (many, dims), (more, wide) = _measure(a, block), _measure(b, block)
    dims = max(dims, wide)
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        (ids, u), (others, v) = _units(x, dims), _units(y, dims)
        return _pairs(ids, u, others, v, least, below, False)

    x, y = a.withColumn("i", spread(many)).withColumn("j", every(more)), b.withColumn("j", spread(more)).withColumn("i", every(many))
    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(multiply, "src long, dst long, weight double")


def found_pairs(ids: np.ndarray, unit: np.ndarray, others: np.ndarray, with_: np.ndarray, least: float, below: float, once: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks whose cosine is in range, some rows' at a time; ``once``: the blocks are one, and each pair is made once."""
    step = max(1, min(512, HELD // max(1, len(others))))
    for a in range(0, len(ids) if len(others) else 0, step):
        after = a if once else 0
        s = unit[a : a + step] @ with_[after:].T
        x, y = np.nonzero((s >= least) & (s < below))
        u, v = ids[a + x], others[after + y]
        good = (u != v) & (y > x) if once else u != v
        yield pa.record_batch([np.minimum(u, v)[good], np.maximum(u, v)[good], s[x, y][good]], names=["src", "dst", "weight"])


def _pairs(*how) -> pa.Table:
    """All of ``found_pairs``."""
    none = pa.record_batch([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], names=["src", "dst", "weight"])
    return pa.Table.from_batches([none, *found_pairs(*how)])


def new_pairs(new: DataFrame, old: DataFrame, least: float, below: float = 2.0, **how) -> DataFrame:
    """The pairs that ``new`` rows add to those of ``old`` ones: new with old and new with new. Old pairs are not looked at again."""
    return cross_pairs(new, old, least, below, **how).unionByName(similar_pairs(new, least, below, **how))


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, least: float = -2.0, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK, own_too: bool = False, by: str | None = None, count: bool = False
) -> DataFrame:
    """``query_id, rank, id, similarity``: each query's k closest rows, its own left out unless ``own_too``; with ``by``, among the rows that are equal to it there.

    With ``count``, ``close`` tells how many rows are close enough in all.
    """
    q, rows = _rows(queries, id_col, vector_col, by), _rows(vectors, id_col, vector_col, by)
    many, dims = _measure(rows, block)
    groups, other = _measure(q, block)
    dims = max(dims, other)
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.withColumn("c", spread(many)).withColumn("g", every(groups))
    left = q.withColumn("g", spread(groups)).withColumn("c", every(many))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        (qids, x), (ids, y) = _units(a, dims), _units(b, dims)
        order = np.argsort(ids, kind="stable")
        ids, y = ids[order], y[order]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for at in range(0, len(qids) if len(ids) else 0, 512):
            s = x[at : at + 512] @ y.T
            if not own_too:
                s[ids[None, :] == qids[at : at + 512, None]] = -3.0
            s[s < least] = -3.0
            # A stable sort keeps ids in order among equals; a partition first, where the block is wide.
            wide = s.shape[1] > 4 * k
            cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if wide else -2.5
            r, c = np.nonzero((s >= cut) & (s > -2.5))
            # The number of all that are close goes with a query's first row.
            many = np.where(np.concatenate([[True], r[1:] != r[:-1]])[: len(r)], (s > -2.5).sum(axis=1)[r], 0) if count else np.zeros(len(r), np.int64)
            out.append((qids[at + r], ids[c], s[r, c], many))
        u, v, w, n = (np.concatenate(z) for z in zip(*out))
        return pa.table({"query_id": u, "id": v, "similarity": w, "close": n})

    cell = ["g", "c"] if by is None else ["of", "g", "c"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "query_id long, id long, similarity double, close long")
    # Rounded before ranking, so that equal vectors tie whatever block they were in.
    found = found.withColumn("similarity", F.round("similarity", 12))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    if count:
        found = found.withColumn("close", F.sum("close").over(Window.partitionBy("query_id")))  # k rows a cell
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity", *(["close"] if count else []))
