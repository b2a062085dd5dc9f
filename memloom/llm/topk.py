"""Exact top-k search over sparse integer vectors, term at a time.

Each component x of a vector becomes the integer weight ``floor(scale * x)``;
zero weights are absent terms. Candidates are dealt into cells of bounded size,
and so are queries. A cell builds one postings list per term, and every query
row scatters its weighted postings into a dense array of scores, one term after
another; then the k best of the cell are selected by partition. The cells'
selections are merged per query by score and id. All pairs are scored: nothing
is pruned and no index is fitted.

A cell holds ``CELL`` candidates and ``ENTRIES`` components at most, and as many
query components, give or take the spread of a hash, so memory follows neither the
rows nor the width of the vectors; a query's row goes to each cell of candidates,
which is the stated query set against all rows. Rows are dealt by id and vector.
Only where an id repeats are rows counted first, and equal ones sent once, with a
count: a query can be answered by k of them at most, and asks k times at most.

Scores are exact. Pairs whose product could leave a long are few and are multiplied
in Python's integers, all others in 32 or 64 bits, whichever the weights allow.

Defined results: vectors that are null or hold null or non-finite components
take no part; missing trailing components count as 0; equal scores go to the
smaller id; a query with fewer candidates gets all; an inner product beyond a long
is ranked by its exact value and shown as the nearest long; null ids take no part;
rows that repeat an id are one candidate each, and none of them is a candidate of
its own id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 65_536
FINE = 2_048
QUERIES = 16_384
ENTRIES = 1 << 20
BLOCK = 64
LONG = (1 << 63) - 1
#: Exact values beyond a long travel as bytes that sort like them: 65 limbs hold any product of doubles.
_WIDE, _BYTES = 1 << 2300, 289
_SCHEMA = "query_id long, vec_id long, copies long, score long, beyond int, exact binary"


def _finite(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & good


class Rows:
    """Ids in order, how often each row counts, and the weights of its terms."""

    def __init__(self, rows: pa.Table, scale: float):
        self.ids = rows.column("vec_id").to_numpy()
        self.copies = rows.column("copies").to_numpy()
        lists = rows.column("embedding").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        x = lists.flatten().to_numpy().astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.copies = self.ids[order], self.copies[order]
        # Components in the order of the ids: row, term, weight; absent terms are left out.
        sizes, starts = sizes[order], starts[order]
        term = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        x = x[np.repeat(starts, sizes) + term]
        row = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        with np.errstate(over="ignore"):
            weight = np.floor(scale * x)
        some = weight != 0
        self.row, self.term, self.weight = row[some], term[some], weight[some]
        self.over = {(int(r), int(t)): int(v) * int(scale) for r, t, v in zip(row[np.isinf(weight)], term[np.isinf(weight)], x[np.isinf(weight)])}
        self.n, self.width = len(order), int(sizes.max(initial=0))
        self.largest = np.zeros(self.n)
        np.maximum.at(self.largest, self.row, np.abs(self.weight))
        self.bounds = np.searchsorted(self.row, np.arange(self.n + 1))

    def exact(self, i: int) -> dict[int, int]:
        """A row's terms and weights as Python integers."""
        some = slice(self.bounds[i], self.bounds[i + 1])
        return {t: self.over[i, t] if math.isinf(w) else int(w) for t, w in zip(self.term[some].tolist(), self.weight[some].tolist())}


def postings(rows: Rows, plain: np.ndarray, kind: type) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """Per term the rows that have it, of the ``plain`` ones, and their weights; a long list is kept with its zeros, as the weights of all rows."""
    some = plain[rows.row]
    row, term, weight = rows.row[some], rows.term[some], rows.weight[some].astype(kind)
    order = np.argsort(term.astype(np.uint16) if rows.width <= 1 << 16 else term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    out = {}
    for t, a, b in _groups(term):
        if 2 * (b - a) > rows.n:
            column = np.zeros(rows.n, kind)
            column[row[a:b]] = weight[a:b]
            out[t] = None, column
        else:
            out[t] = row[a:b], weight[a:b]
    return out


def _groups(ordered: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, start and end of each run of equal values."""
    if not len(ordered):
        return []
    heads = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
    return [(int(ordered[a]), int(a), int(b)) for a, b in zip(heads, heads[1:])]


def scores(queries: Rows, block: np.ndarray, lists: dict[int, tuple[np.ndarray | None, np.ndarray]], n: int, kind: type) -> np.ndarray:
    """Dense scores of a block of query rows, gathered term at a time."""
    acc = np.zeros((len(block), n), kind)
    lo, hi = queries.bounds[block[0]], queries.bounds[block[-1] + 1]
    place = np.full(block[-1] + 1 - block[0], -1)
    place[block - block[0]] = np.arange(len(block))
    at = place[queries.row[lo:hi] - block[0]]
    order = np.argsort(queries.term[lo:hi], kind="stable")
    order = order[at[order] >= 0]
    at, term, weight = at[order], queries.term[lo:hi][order], queries.weight[lo:hi][order].astype(kind)
    for t, a, b in _groups(term):
        if (found := lists.get(t)) is None:
            continue
        (rows, weights), q, w = found, at[a:b], weight[a:b]
        if 2 * len(q) > len(block):
            every = np.zeros(len(block), kind)
            every[q] = w
            q, w = None, every
        if rows is None:
            if q is None:
                acc += w[:, None] * weights
            else:
                acc[q] += w[:, None] * weights
        else:
            acc[np.ix_(np.arange(len(block)) if q is None else q, rows)] += w[:, None] * weights
    return acc


def _told(q: int, copies: int, found: list[tuple[int, int, int]]) -> list[tuple]:
    """Rows of a query's candidates ``(exact score, id, copies)``."""
    out = []
    for s, i, c in found:
        beyond = (s > LONG) - (s < -LONG - 1)
        out.append((q, i, copies * c, max(-LONG - 1, min(LONG, s)), beyond, (s + _WIDE).to_bytes(_BYTES, "big") if beyond else None))
    return out


def best(queries: Rows, cands: Rows, k: int) -> pa.Table:
    """The k best candidates of each query row in a cell."""
    width = max(1, queries.width, cands.width)
    limit = math.isqrt((1 << 62) // width)
    plain_q, plain_c = queries.largest <= limit, cands.largest <= limit
    most = float(queries.largest[plain_q].max(initial=0)) * float(cands.largest[plain_c].max(initial=0)) * width
    kind = np.int32 if most < 1 << 31 else np.int64
    lists, n = postings(cands, plain_c, kind), cands.n
    wide_c = [(int(cands.ids[i]), int(cands.copies[i]), cands.exact(int(i))) for i in np.flatnonzero(~plain_c)]
    parts, rest = [], []
    some = np.flatnonzero(plain_q)
    for a in range(0, len(some), BLOCK):
        block = some[a : a + BLOCK]
        acc = scores(queries, block, lists, n, kind).astype(np.int64)
        out = (cands.ids[None, :] == queries.ids[block, None]) | ~plain_c[None, :]
        if most < 1 << 31:
            key = acc * (1 << 32) + (n - 1 - np.arange(n))  # larger score, then smaller id
            key[out] = np.iinfo(np.int64).min
            at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), (len(block), n))
        else:
            at = np.stack([np.lexsort((np.arange(n), -r, o))[:k] for r, o in zip(acc, out, strict=True)])
        row = np.arange(len(block))[:, None]
        good = ~out[row, at]
        parts.append((np.broadcast_to(queries.ids[block, None], at.shape)[good], cands.ids[at][good], (queries.copies[block, None] * cands.copies[at])[good], acc[row, at][good]))
        for i in block if wide_c else ():
            q, own = queries.exact(int(i)), int(queries.ids[i])
            rest += _told(own, int(queries.copies[i]), [(sum(w * c.get(t, 0) for t, w in q.items()), j, m) for j, m, c in wide_c if j != own])
    wide_q = np.flatnonzero(~plain_q)
    every = [(int(cands.ids[i]), int(cands.copies[i]), cands.exact(i)) for i in range(n)] if len(wide_q) else []
    for i in wide_q:
        q, own = queries.exact(int(i)), int(queries.ids[i])
        found = sorted(((sum(w * c.get(t, 0) for t, w in q.items()), -j, m) for j, m, c in every if j != own), reverse=True)[:k]
        rest += _told(own, int(queries.copies[i]), [(s, -j, m) for s, j, m in found])
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
    near = pa.table({"query_id": cols[0], "vec_id": cols[1], "copies": cols[2], "score": cols[3], "beyond": pa.array(np.zeros(len(cols[0]), np.int32)), "exact": pa.nulls(len(cols[0]), pa.binary())})
    return pa.concat_tables([near, pa.table([pa.array([r[c] for r in rest], f.type) for c, f in enumerate(near.schema)], schema=near.schema)])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best candidates."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _finite(F.col("embedding"))).withColumn("copies", F.lit(1).cast("long"))
    size = F.size("embedding")
    of_ids = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"), F.sum(size).alias("size"), F.sum(F.when(F.col("asks"), size)).alias("asked_size"))
    n, asked, size, asked_size, most = of_ids.agg(F.sum("n"), F.sum("asked"), F.sum("size"), F.sum("asked_size"), F.max("n")).first()
    n, asked = n or 0, asked or 0
    if (most or 0) > 1:
        # More than k equal rows can't answer, nor ask, more often than k times.
        held = F.least(F.count(F.lit(1)), F.lit(k).cast("long")).alias("copies")
        rows = rows.groupBy("vec_id", "embedding").agg(F.first("asks").alias("asks"), held)
    cells = max(1, -(-n // CELL), -(-(size or 0) // ENTRIES), min(-(-n // FINE), 4 * spark.sparkContext.defaultParallelism))
    groups = max(1, -(-asked // QUERIES), -(-(asked_size or 0) // ENTRIES))
    spread = lambda salt, many: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "embedding"), F.lit(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    cands = rows.select("vec_id", "embedding", "copies", spread("c", cells).alias("cell")).withColumn("set", every(groups))
    queries = rows.filter("asks").select("vec_id", "embedding", "copies", spread("q", groups).alias("set")).withColumn("cell", every(cells))

    def search(cand: pa.Table, query: pa.Table) -> pa.Table:
        return best(Rows(query, scale), Rows(cand, scale), k)

    found = cands.groupBy("cell", "set").cogroup(queries.groupBy("cell", "set")).applyInArrow(search, _SCHEMA)
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("exact"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
