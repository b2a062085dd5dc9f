"""Exact mining of hard negatives, with candidates discarded by partial products in an orthogonal PCA rotation.

Each component x becomes the integer ``floor(scale * x)``; scores are integer inner products.
An anchor's positives are its best other rows of the same label; for each positive the best rows
of other labels within a band of the positive's score are its hard negatives.

The second moments of all vectors are summed on the executors; their eigenvectors rotate the
integer vectors so that leading components carry most of a product. Candidates are dealt into
cells of bounded size and anchors into groups, and a cell works on blocks of both: it adds up the
products of leading components, stage after stage. What the other components can add is bounded by
the product of the residual norms, and what rounding can change by a slack, a multiple of the
norms' product that follows from the width and from how far the rotation is from orthogonal as
computed. A pair whose upper bound is below what it must reach (the worst of the best so far, or
the band's floor), or whose lower bound is above the band, is discarded early. Survivors are
verified by integer products, so results are exact whatever the rotation.

Anchors meet every cell: they are a stated query set against all rows. Nothing else is sent twice,
and a cell holds ``CELL`` rows and ``ENTRIES`` components at most, give or take the spread of a
hash. The moments, of a square of the width, are the only thing that the driver holds.

Defined results: null labels, null ids and vectors that are null or hold null or non-finite
components take no part; missing trailing components count as 0; ties go to the smaller id; rows
that repeat an id are a candidate each, and never one of their own id's anchor; rows that repeat an
anchor's id with another vector or label are anchors of their own, equal ones are one; an anchor
without positives or a positive without rows in its band gives no row; a product beyond a long is
ranked by its exact value and shown as the nearest long; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.batches import tidied
from memloom.llm.topk import _BYTES, _WIDE, LONG, _finite
from memloom.shared import cut

CELL = 65_536
FINE = 2_048
ENTRIES = 1 << 21
GROUP = 8_192
#: Anchors and candidates that are multiplied at once, and pairs of which components are gathered at once.
BLOCK, SLAB, PAIRS = 128, 4_096, 16_384
#: Below this share of open pairs, single pairs are followed instead of whole blocks.
SPARSE = 0.1
_MOMENTS = 8
_FOUND = "anchor_id long, anchor long, place int, vec_id long, score long, beyond int, exact binary"


def _integers(lists: pa.Array, width: int, scale: float) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Weights of rows, padded with zeros; those whose products could leave a long are zero rows, and kept as Python integers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    x = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(x)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    with np.errstate(over="ignore"):
        w = np.floor(scale * x)
    limit = math.isqrt((1 << 62) // max(1, width))
    wide = np.zeros(len(sizes), bool)
    wide[row[np.abs(w) > limit]] = True
    out = np.zeros((len(sizes), width))
    some = ~wide[row]
    out[row[some], at[some]] = w[some]
    exact = {}
    for r in np.flatnonzero(wide).tolist():
        mine = row == r
        exact[r] = [int(v) * int(scale) if math.isinf(s) else int(s) for v, s in zip(x[mine].tolist(), w[mine].tolist())]
    return out, exact


class Rotation:
    """An orthogonal basis by falling variance, where products are looked at, and how far rounding can lead."""

    def __init__(self, moments: np.ndarray):
        width = len(moments)
        self.basis = np.linalg.eigh(moments)[1][:, ::-1] if width else np.zeros((0, 0))
        self.stops = sorted({0, *(-(-width * i // 8) for i in (1, 2, 4, 6, 8))})
        off = float(np.linalg.norm(self.basis.T @ self.basis - np.eye(width))) if width else 0.0
        self.slack = 4 * (off + 16 * (width + 8) ** 1.5 * 2.0**-53)


class Rows:
    """Rows of a cell: ids, labels, integer weights, and the same rotated, with residual norms at each stop."""

    def __init__(self, rows: pa.Table, rotation: Rotation, scale: float, labels: dict[str, int]):
        self.ids = rows.column("vec_id").to_numpy()
        self.labels = np.array([labels.setdefault(x, len(labels)) for x in rows.column("label").to_pylist()], np.int64)
        self.weights, self.exact = _integers(rows.column("embedding"), len(rotation.basis), scale)
        self.wide = np.zeros(len(self.ids), bool)
        self.wide[list(self.exact)] = True
        self.turned = self.weights @ rotation.basis
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        rest = np.concatenate([squares, np.zeros((len(squares), 1))], axis=1)
        self.rest = np.sqrt(rest[:, rotation.stops[1:]]) if rotation.stops[1:] else rest
        self.norm = np.sqrt((self.weights**2).sum(axis=1))

    def integers(self, i: int) -> list[int]:
        return self.exact[i] if self.wide[i] else [int(x) for x in self.weights[i].tolist()]


def survivors(a: Rows, i: np.ndarray, c: Rows, j: np.ndarray, low: np.ndarray, high: np.ndarray, barred: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in ``i`` and ``j``) whose score may lie in one of the anchor's ranges, [low, high] by column."""
    x, y = a.turned[i], c.turned[j]
    slack = np.outer(rotation.slack * a.norm[i], c.norm[j])
    low, high = np.nextafter(low.astype(np.float64), -np.inf), np.nextafter(high.astype(np.float64), np.inf)
    total, pairs = np.zeros((len(i), len(j))), None
    for stage, (at, to) in enumerate(zip(rotation.stops, rotation.stops[1:])):
        if pairs is None:
            total += x[:, at:to] @ y[:, at:to].T
            reach = np.outer(a.rest[i, stage], c.rest[j, stage]) + slack
            least, most = total - reach, total + reach
            open_ = np.zeros(total.shape, bool)
            for k in range(low.shape[1]):
                open_ |= (most >= low[:, k, None]) & (least <= high[:, k, None])
            open_ &= ~barred
            if open_.mean() < SPARSE or to == len(rotation.basis):
                p, q = np.nonzero(open_)
                pairs = total[p, q]
        elif len(pairs):
            for s in range(0, len(pairs), PAIRS):
                some = slice(s, s + PAIRS)
                pairs[some] += np.einsum("ij,ij->i", x[p[some], at:to], y[q[some], at:to])
            reach = a.rest[i[p], stage] * c.rest[j[q], stage] + slack[p, q]
            open_ = ((pairs + reach)[:, None] >= low[p]) & ((pairs - reach)[:, None] <= high[p])
            some = open_.any(axis=1)
            p, q, pairs = p[some], q[some], pairs[some]
    return (p, q) if pairs is not None else np.nonzero(~barred)  # vectors without components: all products are 0


def products(a: Rows, i: np.ndarray, c: Rows, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    out = np.zeros(len(i), np.int64)
    for s in range(0, len(i), PAIRS):
        some = slice(s, s + PAIRS)
        out[some] = np.einsum("ij,ij->i", a.weights[i[some]].astype(np.int64), c.weights[j[some]].astype(np.int64))
    return out


class Best:
    """The k best of each of ``n`` lists, by score and id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.list, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        of, score, ids = (np.concatenate(x) for x in ((self.list, of), (self.score, score), (self.id, ids)))
        by = np.lexsort((ids, -score, of))
        of, score, ids = of[by], score[by], ids[by]
        first = np.arange(len(of)) - np.searchsorted(of, of) < self.k
        self.list, self.score, self.id = of[first], score[first], ids[first]

    def least(self) -> np.ndarray:
        """What a score must reach to enter each list; the smallest long while it is open to all."""
        out = np.full(self.n, -LONG - 1, np.int64)
        heads = np.searchsorted(self.list, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(heads) >= self.k)
        out[full] = self.score[heads[full + 1] - 1]
        return out


def _slabs(n: int) -> Iterator[slice]:
    """Small slabs first, so that later ones meet high limits."""
    at, size = 0, SLAB // 16 or 1
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, min(SLAB, 4 * size)


def _best(a: Rows, i: np.ndarray, c: Rows, j: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, rotation: Rotation) -> Best:
    """The best candidates of a block of anchors in each of their ranges; of the same label, or of others."""
    ranges = low.shape[1]
    best = Best(len(i) * ranges, k)
    for some in _slabs(len(j)):
        now = j[some]
        floor = np.maximum(low, best.least().reshape(low.shape))
        barred = (a.ids[i][:, None] == c.ids[now][None, :]) | ((a.labels[i][:, None] == c.labels[now][None, :]) != same)
        p, q = survivors(a, i, c, now, floor, high, barred, rotation)
        score = products(a, i[p], c, now[q])
        for r in range(ranges):
            good = (score >= low[p, r]) & (score <= high[p, r])
            best.add(p[good] * ranges + r, score[good], c.ids[now[q[good]]])
    return best


def _shown(s: int) -> tuple[int, int, bytes | None]:
    """The nearest long, on which side of the longs the score lies, and there bytes that sort like it."""
    beyond = (s > LONG) - (s < -LONG - 1)
    return max(-LONG - 1, min(LONG, s)), beyond, (s + _WIDE).to_bytes(_BYTES, "big") if beyond else None


def _rest(a: Rows, c: Rows, ranges: list[list[tuple[int, int]]], same: bool, k: int) -> Iterator[tuple[int, int, int, int]]:
    """``anchor row, range, id, score`` of pairs that need Python's integers."""
    for i in range(len(a.ids)):
        some = range(len(c.ids)) if a.wide[i] else np.flatnonzero(c.wide).tolist()
        if not some or not ranges[i]:
            continue
        mine, found = a.integers(i), []
        for j in some:
            if a.ids[i] != c.ids[j] and (a.labels[i] == c.labels[j]) == same:
                found.append((-sum(x * y for x, y in zip(mine, c.integers(j))), int(c.ids[j])))
        found.sort()
        for r, (low, high) in enumerate(ranges[i]):
            for s, j in [(-s, j) for s, j in found if low <= -s <= high][:k]:
                yield i, r, j, s


def _found(cand: pa.Table, asked: pa.Table, rotation: Rotation, scale: float, k: int, band: tuple[int, int] | None) -> pa.Table:
    """A cell's best of each anchor: of its label, or for each positive score of other labels within the band."""
    labels: dict[str, int] = {}
    c, a = Rows(cand, rotation, scale, labels), Rows(asked, rotation, scale, labels)
    anchor = asked.column("anchor").to_numpy()
    if band is None:
        ranges = [[(-(1 << 2400), 1 << 2400)]] * len(a.ids)
    else:
        scores = [[int.from_bytes(p["exact"], "big") - _WIDE if p["exact"] else p["score"] for p in x] for x in asked.column("positives").to_pylist()]
        ranges = [[(-(-band[0] * s // 100), band[1] * s // 100) for s in x] for x in scores]
    most = max(map(len, ranges), default=0)
    held = lambda x: max(-LONG - 1, min(LONG, x))
    low, high = np.full((len(a.ids), most), LONG), np.full((len(a.ids), most), -LONG - 1)  # ranges that nothing is in
    for i, x in enumerate(ranges):
        for r, (lo, hi) in enumerate(x):
            low[i, r], high[i, r] = held(lo), held(hi)
    order = np.argsort(-c.norm, kind="stable")
    order = order[~c.wide[order]]
    parts, blocks = [], []
    if band is None:  # a label's anchors meet only its rows
        for label in np.unique(a.labels):
            mine, rows = np.flatnonzero((a.labels == label) & ~a.wide), order[c.labels[order] == label]
            blocks += [(mine[s : s + BLOCK], rows) for s in range(0, len(mine), BLOCK)]
    else:
        mine = np.flatnonzero(~a.wide)
        blocks = [(mine[s : s + BLOCK], order) for s in range(0, len(mine), BLOCK)]
    for i, j in blocks:
        best = _best(a, i, c, j, low[i], high[i], band is None, k, rotation)
        row = i[best.list // most] if most else np.zeros(0, np.int64)
        parts.append((a.ids[row], anchor[row], best.list % most if most else row, best.id, best.score))
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
    rest = [(int(a.ids[i]), int(anchor[i]), r, j, *_shown(s)) for i, r, j, s in _rest(a, c, ranges, band is None, k)] if c.exact or a.exact else []
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(("anchor_id", "anchor", "place", "vec_id", "score", "beyond", "exact"), types)))
    n = len(cols[0])
    near = pa.table([*(pa.array(x).cast(t) for x, t in zip(cols, types)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary())], schema=schema)
    return pa.concat_tables([near, pa.table([pa.array([r[f] for r in rest], t) for f, t in enumerate(types)], schema=schema)])


def _moments(rows: DataFrame, width: int, scale: float) -> np.ndarray:
    """Sums of the products of components, over all rows that plain products hold."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros((width, width)), 0
        for batch in batches:
            for s in range(0, batch.num_rows, SLAB):
                w, _ = _integers(batch.column(0).slice(s, SLAB), width, scale)
                norm = np.sqrt((w**2).sum(axis=1, keepdims=True))
                w = w / np.where(norm > 0, norm, 1.0)
                total += w.T @ w
                key += int(batch.column(1)[s].as_py())
        yield pa.record_batch([pa.array([key % _MOMENTS], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def summed(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in group.column("total").to_pylist()], axis=0)
        return pa.table({"part": group.column("part").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("embedding", "vec_id").mapInArrow(tidied(part), "part long, total binary").groupBy("part").applyInArrow(summed, "part long, total binary")
    total = np.zeros(width * width)
    for r in sums.sort("part").toLocalIterator():  # _MOMENTS rows at most
        total += np.frombuffer(r["total"], np.float64)
    return total.reshape(width, width)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, scale: float = 256.0, band: tuple[int, int] = (50, 95), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the negatives of each anchor and positive.

    A negative's score lies between ``band[0]`` and ``band[1]`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"), is_anchor.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("embedding")))
    size = F.size("embedding")
    n, total, width, asked, asked_size = rows.agg(F.count(F.lit(1)), F.sum(size), F.max(size), F.count_if("asks"), F.sum(F.when(F.col("asks"), size))).first()
    rotation = Rotation(_moments(rows, width or 0, scale))
    cells = max(1, -(-n // CELL), -(-(total or 0) // ENTRIES), min(-(-n // FINE), 4 * spark.sparkContext.defaultParallelism))
    groups = max(1, -(-asked // GROUP), -(-(asked_size or 0) // ENTRIES))
    spread = lambda salt, many: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "embedding"), F.lit(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    anchors = rows.filter("asks").select("vec_id", "label", "embedding").distinct().withColumn("anchor", F.xxhash64("label", "embedding")).withColumn("set", spread("q", groups))
    cands = rows.select("vec_id", "label", "embedding", spread("c", cells).alias("cell")).withColumn("set", every(groups))

    def search(asking: DataFrame, k: int, of: tuple[int, int] | None) -> DataFrame:
        """The k best of each anchor and place, over all cells."""
        run = lambda cand, query: _found(cand, query, rotation, scale, k, of)
        found = cands.groupBy("cell", "set").cogroup(asking.withColumn("cell", every(cells)).groupBy("cell", "set")).applyInArrow(run, _FOUND)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor", "place").orderBy(F.desc("beyond"), F.desc("exact"), F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    best = cut(search(anchors, positives, None), "positives")
    held = best.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "exact"))).alias("positives"))  # ``positives`` at most
    asking = cut(anchors.join(held.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "anchor"]), "anchors")
    found = search(asking, negatives, band).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    of = best.select("anchor_id", "anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(of, ["anchor_id", "anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.w, c.w)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
