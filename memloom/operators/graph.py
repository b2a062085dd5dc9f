"""Similarity graphs and their analysis over ``src, dst, weight`` edge tables with ``src < dst``."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memloom.functions.vectors import cosine
from memloom.operators import local, vector_index
from memloom.operators.components import components
from memloom.operators.similarity import nearest, new_pairs, similar_pairs
from memloom.shared import cut, drop, first_rows

#: Edges of a graph that one task may hold: some 100 MB.
MOST_LOCAL = 500_000
#: Nodes whose communities may be broadcast, after counting them: some 50 MB of a few numbers each.
MOST_NODES = 1_000_000
#: Links that a task of a pass reads, and that a row of a packed level holds: 24 and 12 MB.
LINKS = 2_000_000
PACKED = 1_000_000


def knn_edges(vectors: DataFrame, k: int = 10, least: float = 0.4, id_col: str = "id", vector_col: str = "embedding", index: vector_index.Cells | None = None, **how) -> DataFrame:
    """Undirected edges between each node and its k nearest that are close enough, with the larger weight. With an ``index`` only its cells are searched."""
    if index is None:
        near = nearest(vectors, vectors, k, least, id_col, vector_col, **how)
    else:
        near = vector_index.nearest(vectors, vectors, index, k, least, id_col, vector_col, **how)
    return near.groupBy(F.least("query_id", "id").alias("src"), F.greatest("query_id", "id").alias("dst")).agg(F.max("similarity").alias("weight"))


def band_edges(vectors: DataFrame, least: float = 0.82, below: float = 0.88, **how) -> DataFrame:
    """Edges in a band below the merge threshold, with weights of four places."""
    return similar_pairs(vectors, least, below, **how).withColumn("weight", F.round("weight", 4))


def new_edges(new: DataFrame, old: DataFrame, least: float = 0.82, below: float = 0.88, **how) -> DataFrame:
    """The edges that new nodes add to ``band_edges`` of old ones: the work follows new times all, not all times all."""
    return new_pairs(new, old, least, below, **how).withColumn("weight", F.round("weight", 4))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst"))))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree, strength``."""
    return both_ways(edges.select("src", "dst", "weight")).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def _density(nodes: Column, edges: Column) -> Column:
    return F.when(nodes > 1, 2.0 * edges / (nodes * (nodes - 1))).otherwise(F.lit(0.0))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``nodes, edges, density, avg_degree``."""
    both = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    n, e = F.col("nodes"), F.col("edges")
    return both.select("nodes", "edges", _density(n, e).alias("density"), F.when(n > 0, 2.0 * e / n).otherwise(F.lit(0.0)).alias("avg_degree"))


def labelled(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with the communities ``a`` and ``b`` of their ends, from ``node, community``."""
    end = lambda side, name: membership.select(F.col("node").alias(side), F.col("community").alias(name))
    return edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst")


def community_stats(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``community, nodes, edges, density, avg_degree`` over each community's inner edges."""
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("nodes"))
    inner = labelled(edges, membership).filter("a = b").groupBy(F.col("a").alias("community")).agg(F.count(F.lit(1)).alias("edges"))
    e = F.coalesce("edges", F.lit(0))
    return sizes.join(inner, "community", "left").select("community", "nodes", e.alias("edges"), _density(F.col("nodes"), e).alias("density"), (2.0 * e / F.col("nodes")).alias("avg_degree"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity``: the weight inside communities against that expected from degrees."""
    ends = labelled(edges, membership)
    inner = F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(F.lit(0.0)))
    whole = ends.agg(inner.alias("inner"), F.sum("weight").alias("m"))
    both = ends.select(F.col("a").alias("c"), "weight").unionByName(ends.select(F.col("b").alias("c"), "weight"))
    spread = both.groupBy("c").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return whole.crossJoin(spread).select(F.when(F.col("m") > 0, F.col("inner") / F.col("m") - resolution * F.col("dd") / (4 * F.col("m") * F.col("m"))).otherwise(F.lit(0.0)).alias("modularity"))


def connected(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """``node, community``: the smallest node that each one reaches, itself if it has no edge."""
    found = components(edges, "src", "dst")
    return nodes.select(F.col(id_col).alias("node")).join(found, "node", "left").select("node", F.coalesce("label", "node").alias("community"))


def _whole_weights(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` with the weights as whole numbers whose sum stays below 2^51, so that sums are exact in any order; edges of no weight do not count."""
    edges = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).filter("src <> dst AND weight > 0")
    total = edges.agg(F.sum("weight")).first()[0] or 1.0
    scale = 2.0 ** (50 - math.ceil(math.log2(total)))
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    return edges.groupBy(*ends).agg(F.sum(F.floor(F.col("weight") * F.lit(scale) + 0.5)).cast("double").alias("weight")).filter("weight > 0")


def _coin(node: str, turn: int) -> Column:
    """A bit of the node's hash, another every turn."""
    return F.shiftrightunsigned(F.xxhash64(node), turn % 64).bitwiseAND(F.lit(1)) == 1


class _Level:
    """A graph and what all rounds on it need: links of both directions and the strengths of its nodes."""

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        self.edges, self.nodes = edges, nodes
        ways = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        self.strength = cut(nodes.join(ways.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k")), "strength")
        self.links = cut(ways.filter("src <> dst"), "links")
        self.twice = self.strength.agg(F.sum("k")).first()[0] or 1.0
        self.passes: _Numbered | None = None

    def score(self, part: DataFrame, resolution: float) -> Fraction:
        """Modularity times the square of twice the weight, exactly."""
        ends = labelled(self.edges, part)
        inner = ends.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")))).first()[0] or 0
        of = self.strength.join(part, "node").groupBy("community").agg(F.sum("k").cast("decimal(18,0)").alias("d"))
        return 2 * int(inner) * int(self.twice) - Fraction(resolution) * int(of.agg(F.sum((F.col("d") * F.col("d")).cast("decimal(38,0)"))).first()[0] or 0)

    def dealt(self) -> _Numbered | None:
        """The level for passes over its links, where it has few enough nodes."""
        if self.passes is None and self.strength.count() <= MOST_NODES:
            self.passes = _Numbered(self.edges, self.nodes)
        return self.passes

    def drop(self) -> None:
        drop(self.strength, self.links)
        if self.passes:
            self.passes.net.drop()


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b, weight`` in order as rows of bytes: some nodes, how many links each has, where these lead and what they weigh."""

    def packed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        nodes, links = np.unique(a, return_counts=True)
        held = (nodes.astype(np.int32), links.astype(np.int32), b.astype(np.int32), w.astype(np.float64))
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in held], names=["nodes", "links", "b", "w"])

    held, size = [], 0
    for batch in batches:
        held.append([x.to_numpy() for x in batch.columns])
        size += batch.num_rows
        if size >= PACKED:
            a, b, w = map(np.concatenate, zip(*held))
            at = np.searchsorted(a, a[-1])  # its links may go on
            if at:
                yield packed(a[:at], b[:at], w[:at])
            held, size = [[a[at:], b[at:], w[at:]]], len(a) - at
    if size:
        yield packed(*map(np.concatenate, zip(*held)))


class _Dealt:
    """``local.Net`` of a graph of numbered nodes whose links stay in Spark, packed. A look at a division is one pass over them, without a shuffle: each task tells of its own nodes, and only numbers of nodes, not of links, come to the driver."""

    def __init__(self, edges: DataFrame, k: np.ndarray, h: np.ndarray):
        """``edges``: ``a, b, weight`` with ``a <= b``, each pair once, in a written table."""
        context = edges.sparkSession.sparkContext
        self.n, self.k, self.h, self.twice = len(k), k, h, float(k.sum()) or 1.0
        loops = edges.filter("a = b").select("a", "weight").toArrow()  # a row a node at most
        self.loops = np.bincount(loops.column("a").to_numpy(), loops.column("weight").to_numpy(), self.n)
        off = edges.filter("a <> b")
        ways = off.unionByName(off.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
        cores = context.defaultParallelism
        parts = cores * max(1, -(-2 * off.count() // (LINKS * cores)))
        self.links = cut(ways.repartitionByRange(parts, "a").sortWithinPartitions("a", "b").mapInArrow(_packed, "nodes binary, links binary, b binary, w binary"), "packed")
        self.always = context.broadcast((self.k, self.h))

    def drop(self) -> None:
        drop(self.links)
        self.always.destroy()

    def _told(self, run, schema: str, *sent) -> tuple[DataFrame, Broadcast]:
        """The rows of what ``run(a, b, w, k, h, *sent)`` tells of each row of links, columns by ``schema``, and what was sent."""
        always, held = self.always, self.links.sparkSession.sparkContext.broadcast(sent)
        names = [x.split()[0] for x in schema.split(", ")]

        def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*batch.columns):
                    nodes, links, b, w = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int32, np.int32, np.int32, np.float64)))
                    out = run(np.repeat(nodes, links), b, w, *always.value, *held.value)
                    yield pa.record_batch([pa.array(x) for x in out], names=names)

        return self.links.mapInArrow(told, schema), held

    def _pass(self, run, *sent) -> list[np.ndarray]:
        """``v, to, x`` that ``run`` tells of all rows of links, in order."""
        told, held = self._told(lambda *a: [x.astype(kind) for x, kind in zip(run(*a), (np.int64, np.int64, np.float64))], "v long, to long, x double", *sent)
        out = told.toArrow()
        held.destroy()
        v, to, x = (out.column(c).to_numpy() for c in ("v", "to", "x"))
        by = np.lexsort((to, v))
        return [v[by], to[by], x[by]]

    def _score(self, of: np.ndarray, inner: float, resolution: float) -> Fraction:
        return 2 * (int(self.loops.sum()) + int(inner) // 2) * int(self.twice) - Fraction(resolution) * sum(int(y) ** 2 for y in of[of > 0].tolist())

    def look(self, part: np.ndarray, resolution: float) -> tuple[Fraction, np.ndarray, np.ndarray, np.ndarray]:
        of = np.bincount(part, self.k, self.n)
        twice = self.twice

        def run(a, b, w, k, h, part, of, names, at):
            near = local.summed(a, b, w, names, at)
            nodes, to, delta = local.gaining(near, part, k, of, twice, resolution)
            # A row of no node: the weight of links inside communities.
            return np.append(nodes, -1), np.append(to, -1), np.append(delta, near[2][near[1] == part[near[0]]].sum())

        v, to, x = self._pass(run, part, of, *local.numbered(part))
        return self._score(of, x[v < 0].sum(), resolution), v[v >= 0], to[v >= 0], x[v >= 0]

    def score(self, part: np.ndarray, resolution: float) -> Fraction:
        """Modularity times the square of twice the weight, exactly."""
        return self._score(np.bincount(part, self.k, self.n), self.inside(part).sum(), resolution)

    def _sums(self, run, *sent) -> np.ndarray:
        v, _, x = self._pass(run, *sent)
        return np.bincount(v, x, self.n)

    def inside(self, part: np.ndarray) -> np.ndarray:
        def run(a, b, w, k, h, part):
            return local.totals(a, np.where(part[a] == part[b], w, 0.0))

        return self._sums(run, part)

    def out(self, part: np.ndarray, sub: np.ndarray) -> np.ndarray:
        def run(a, b, w, k, h, part, sub):
            return local.totals(a, np.where((part[a] == part[b]) & (sub[a] != sub[b]), w, 0.0))

        return self._sums(run, part, sub)

    def joins(self, part: np.ndarray, sub: np.ndarray, inside: np.ndarray, out: np.ndarray, scale: float, turn: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.bincount(sub, minlength=self.n), np.bincount(sub, self.k, self.n), np.bincount(part, self.k, self.n)
        loose = local.loose(part, sub, self.k, inside, sizes, scale)

        def run(a, b, w, k, h, part, sub, inside, out, sizes, loose, names, at):
            some = loose[a] & (part[a] == part[b])
            nodes, to = local.options(local.summed(a[some], b[some], w[some], names, at), part, sub, k, h, inside, out, sizes, scale, turn)
            return nodes, to, np.zeros(len(nodes))

        return tuple(self._pass(run, part, sub, inside, out, sizes, loose, *local.numbered(sub))[:2])

    def contracted(self, part: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """The edges of the graph whose nodes are the parts, in the order of their names, written; the number of each node's part; and the names."""
        names, at = local.numbered(part)

        many = len(names)

        def run(a, b, w, k, h, at):
            # Of links both ways one counts; those inside a part count half each.
            p, q = at[a], at[b]
            some = p <= q
            pairs, of = np.unique((p * many + q)[some], return_inverse=True)
            return (pairs // many).astype(np.int32), (pairs % many).astype(np.int32), np.bincount(of, np.where(p == q, w / 2, w)[some], len(pairs))

        told, held = self._told(run, "a int, b int, weight double", at)
        loops = np.bincount(at, self.loops, len(names))
        own = np.flatnonzero(loops).astype(np.int32)
        more = self.links.sparkSession.createDataFrame(pa.table({"a": own, "b": own, "weight": loops[own]}))
        out = cut(told.unionByName(more).groupBy("a", "b").agg(F.sum("weight").alias("weight")), "contracted")
        held.destroy()
        return out, at, names


class _Numbered:
    """A ``_Dealt`` of a graph of named nodes, and its divisions as tables."""

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        spark = edges.sparkSession
        rows = nodes.select("node", F.xxhash64("node").alias("h")).toArrow().sort_by("node").combine_chunks()
        self.nodes, n = rows.column("node"), rows.num_rows
        self.no = cut(spark.createDataFrame(pa.table({"node": self.nodes, "no": pa.array(np.arange(n, dtype=np.int32))})), "numbers")
        of = lambda side, name: F.broadcast(self.no.select(F.col("node").alias(side), F.col("no").alias(name)))
        ends = cut(edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight"), "numbered")
        ways = ends.select("a", "weight").union(ends.select("b", "weight"))
        sums = ways.groupBy("a").agg(F.sum("weight").alias("k")).toArrow()  # a row a node
        k = np.bincount(sums.column("a").to_numpy(), sums.column("k").to_numpy(), n)
        self.net = _Dealt(ends, k, rows.column("h").to_numpy().view(np.uint64))
        drop(ends)

    def read(self, membership: DataFrame) -> np.ndarray:
        """A division as numbers: of each node, the smallest of its community."""
        held = membership.join(F.broadcast(self.no), "node").join(F.broadcast(self.no.select(F.col("node").alias("community"), F.col("no").alias("c"))), "community").select("no", "c").toArrow()
        part = np.empty(self.net.n, np.int64)
        part[held.column("no").to_numpy()] = held.column("c").to_numpy()
        return local.named(part)

    def write(self, part: np.ndarray) -> DataFrame:
        return cut(self.no.sparkSession.createDataFrame(pa.table({"node": self.nodes, "community": self.nodes.take(pa.array(part))})), "communities")


def _finished_numbers(graph: DataFrame, held: np.ndarray, h: np.ndarray, resolution: float, refine: bool, turn: int) -> tuple[np.ndarray, int]:
    """The communities of a contracted level of numbered nodes with few edges, found in one task, on from ``held``; and the next turn."""
    sent = graph.sparkSession.sparkContext.broadcast((held, h))

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[x.to_numpy() for x in batch.columns] for batch in batches]
        a, b, w = map(np.concatenate, zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        held, h = sent.value
        part, after = local.levels(local.Net(len(h), a.astype(np.int64), b.astype(np.int64), w, h), held, resolution, refine, turn, False)
        yield pa.record_batch([pa.array(np.append(part, after))], names=["part"])

    part = graph.select("a", "b", "weight").coalesce(1).mapInArrow(solve, "part long").toArrow().column("part").to_numpy()
    sent.destroy()
    return part[:-1], int(part[-1])


def _by_passes(base: _Dealt, resolution: float, levels: int, rounds: int, refine: bool, most: int) -> np.ndarray:
    """``local.communities`` of a graph whose links stay in Spark until contraction has left ``most`` or fewer."""
    part, turn = np.arange(base.n), 0
    best = base.score(part, resolution)
    for _ in range(levels):
        after, _, turn = local.settle(base, part, resolution, turn, rounds)
        after, turn = _contractions(base, after, resolution, refine, levels, rounds, turn, most)
        score = base.score(after, resolution)
        if score <= best:
            return part
        part, best = after, score
    raise RuntimeError(f"communities did not settle in {levels} levels")


def _contractions(base: _Dealt, held: np.ndarray, resolution: float, refine: bool, most_levels: int, rounds: int, turn: int, most: int) -> tuple[np.ndarray, int]:
    """``local.levels`` of a graph whose links stay in Spark."""
    level, names = base, np.arange(base.n)  # each node's node of the level
    for _ in range(most_levels):
        inner, turn = local.refined(level, held, resolution, turn, rounds) if refine else (held, turn)
        if len(np.unique(inner)) == level.n:
            break
        graph, at, first = level.contracted(inner)
        names, held, k, h = at[names], local.named(held[first]), np.bincount(at, level.k), level.h[first]
        if level is not base:
            level.drop()
        level = base
        if graph.count() <= most:
            held, turn = _finished_numbers(graph, held, h, resolution, refine, turn)
            drop(graph)
            break
        level = _Dealt(graph, k, h)
        drop(graph)
        held, changed, turn = local.settle(level, held, resolution, turn, rounds)
        if not changed and not refine:
            break
    else:
        raise RuntimeError(f"communities did not settle in {most_levels} levels")
    if level is not base:
        level.drop()
    return local.named(held[names]), turn


def _proposals(level: _Level, membership: DataFrame, resolution: float) -> DataFrame:
    """``node, community, to, delta`` of every node that gains by a move; ``to`` is null where it gains most alone."""
    held = membership.join(level.strength, "node")
    totals = held.groupBy("community").agg(F.sum("k").alias("tot"))
    held = held.join(totals.withColumnRenamed("tot", "around"), "community")
    near = level.links.join(membership.select(F.col("node").alias("dst"), F.col("community").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
    options = near.join(held, "node").join(totals.select(F.col("community").alias("to"), "tot"), "to")
    own, k = F.col("to") == F.col("community"), F.col("k")
    gain = F.col("w") - F.lit(resolution) * k * (F.col("tot") - F.when(own, k).otherwise(F.lit(0.0))) / F.lit(level.twice)
    best = options.select("node", "community", "to", own.alias("own"), gain.alias("gain"), (F.lit(-resolution) * k * (F.col("around") - k) / F.lit(level.twice)).alias("apart"))
    other = F.when(~F.col("own"), F.col("gain"))
    # ``apart`` is what staying gains without a neighbour inside; alone, a node gains nothing.
    chosen = best.groupBy("node").agg(
        F.first("community").alias("community"),
        F.coalesce(F.max(F.when(F.col("own"), F.col("gain"))), F.max("apart")).alias("stay"),
        F.max(other).alias("top"),
        F.min_by("to", F.when(~F.col("own"), F.struct(-F.col("gain"), F.col("to")))).alias("to"),
    )
    moves = chosen.select("node", "community", F.when(F.col("top") >= 0, F.col("to")).alias("to"), (F.greatest("top", F.lit(0.0)) - F.col("stay")).alias("delta"))
    return moves.filter(F.col("delta") > local.LEAST_GAIN)


def _apart(moves: DataFrame) -> DataFrame:
    """Those moves that are the best of both communities they touch: no two share one, so their gains add up exactly."""
    rated = moves.withColumn("place", F.struct((-F.col("delta")).alias("d"), F.col("node").alias("n")))
    touched = rated.select(F.col("community").alias("c"), "place").unionByName(rated.filter("to IS NOT NULL").select(F.col("to").alias("c"), "place"))
    first = touched.groupBy("c").agg(F.min("place").alias("first"))
    kept = rated.join(first.select(F.col("c").alias("community"), F.col("first").alias("a")), "community").join(first.select(F.col("c").alias("to"), F.col("first").alias("b")), "to", "left")
    return kept.filter((F.col("place") == F.col("a")) & (F.col("to").isNull() | (F.col("place") == F.col("b")))).select("node", "to")


def _moved(membership: DataFrame, moves: DataFrame) -> DataFrame:
    """The membership after ``moves``; communities are named by their smallest nodes."""
    at = membership.join(moves.select("node", "to", F.lit(True).alias("on")), "node", "left")
    at = at.select("node", F.when(F.col("on"), F.col("to")).otherwise(F.col("community")).alias("c"), F.when(F.col("on") & F.col("to").isNull(), F.col("node")).alias("alone"))
    named = at.groupBy("c", "alone").agg(F.min("node").alias("community")).select(F.col("c").alias("c2"), F.col("alone").alias("alone2"), "community")
    return at.join(named, F.col("c").eqNullSafe(F.col("c2")) & F.col("alone").eqNullSafe(F.col("alone2"))).select("node", "community")


def _settled(level: _Level, membership: DataFrame, resolution: float, rounds: int, turn: int) -> tuple[DataFrame, bool, int]:
    """The membership when no round of moves raises modularity, whether any was made, and the next turn. Deletes the memberships that it supersedes but for the first."""
    if dealt := level.dealt():
        part, changed, turn = local.settle(dealt.net, dealt.read(membership), resolution, turn, rounds)
        return dealt.write(part) if changed else membership, changed, turn
    best, given = level.score(membership, resolution), membership
    for _ in range(rounds):
        moves = cut(_proposals(level, membership, resolution), "proposals")
        if moves.isEmpty():
            drop(moves)
            return membership, membership is not given, turn
        # One half of the nodes moves at once; where that does not pay, moves that cannot disturb each other do.
        step = cut(_moved(membership, moves.filter(~_coin("node", turn))), "moves")
        turn += 1
        score = level.score(step, resolution)
        if score <= best:
            drop(step)
            step = cut(_moved(membership, _apart(moves)), "moves")
            score = level.score(step, resolution)
        drop(moves)
        if score <= best:
            drop(step)
            return membership, membership is not given, turn
        if membership is not given:
            drop(membership)
        membership, best = step, score
    raise RuntimeError(f"communities did not settle in {rounds} rounds")


def _refined(level: _Level, membership: DataFrame, resolution: float, rounds: int, turn: int) -> tuple[DataFrame, int]:
    """``node, community`` of the parts of communities: nodes start alone, and well-connected ones join the best well-connected part inside; and the next turn.

    A node or a part is well connected if its links to the rest of its community weigh what
    is expected of them at least.
    """
    if dealt := level.dealt():
        sub, turn = local.refined(dealt.net, dealt.read(membership), resolution, turn, rounds)
        return dealt.write(sub), turn
    scale = resolution / level.twice
    of = lambda side, name: membership.select(F.col("node").alias(side), F.col("community").alias(name))
    inner = cut(level.links.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a = b").select("src", "dst", "weight"), "inner")
    inside = inner.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("inside"))
    held = membership.join(level.strength, "node")
    held = held.join(held.groupBy("community").agg(F.sum("k").alias("around")), "community").join(inside, "node")
    k = F.col("k")
    # Nodes that are not well connected, or have no link inside, stay alone.
    fit = cut(held.filter(F.col("inside") >= F.lit(scale) * k * (F.col("around") - k)).select("node", "k", "around"), "fit")
    sub = cut(membership.select("node", F.col("node").alias("community")), "parts")
    for _ in range(rounds):
        part = sub.select("node", F.col("community").alias("s"))
        end = lambda side, name: part.select(F.col("node").alias(side), F.col("s").alias(name))
        cross = inner.join(end("src", "s"), "src").join(end("dst", "to"), "dst").filter("s <> to")
        totals = part.join(level.strength, "node").groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.sum("k").alias("total"))
        parts = totals.join(cross.groupBy("s").agg(F.sum("weight").alias("out")), "s")
        single = totals.filter("size = 1").select(F.col("s").alias("node"))
        near = cross.groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
        options = near.join(single, "node", "left_semi").join(fit, "node").join(parts.withColumnRenamed("s", "to"), "to")
        gain = F.col("w") - F.lit(scale) * k * F.col("total")
        options = options.filter(F.col("out") >= F.lit(scale) * F.col("total") * (F.col("around") - F.col("total"))).withColumn("gain", gain).filter(F.col("gain") > local.LEAST_GAIN)
        options = cut(options.select("node", "to", "size", "gain"), "merges")
        if options.isEmpty():
            drop(options, inner, fit)
            return sub, turn
        # Nodes of one side of a coin join; parts of several nodes and nodes of the other side are joined.
        joins = options.filter(_coin("node", turn) & ((F.col("size") > 1) | ~_coin("to", turn))).groupBy("node").agg(F.min_by("to", F.struct(-F.col("gain"), F.col("to"))).alias("to"))
        turn += 1
        former, sub = sub, cut(_moved(sub, joins), "parts")
        drop(former, options)
    raise RuntimeError(f"parts did not settle in {rounds} rounds")


def _contract(edges: DataFrame, membership: DataFrame) -> DataFrame:
    ends = labelled(edges, membership)
    return ends.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))


def _finished(graph: DataFrame, membership: DataFrame, resolution: float, refine: bool, turn: int | None) -> DataFrame:
    """``node, community, turn`` of a graph of ``MOST_LOCAL`` edges at most, found in one task: from the start (no ``turn``), or on from a contracted level's membership."""
    kind = dict(membership.dtypes)["node"]
    node = to_arrow_type(membership.schema["node"].dataType)

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [("src", node), ("dst", node), ("weight", pa.float64()), ("a", pa.int64()), ("b", pa.int64()), ("ca", node), ("cb", node)]
        held = list(batches)
        rows = pa.Table.from_batches(held) if held else pa.schema(columns).empty_table()
        ends = [rows.column(c).to_numpy() for c in ("src", "dst")]
        nodes, first, at = np.unique(np.concatenate(ends), return_index=True, return_inverse=True)
        h = np.concatenate([rows.column(c).to_numpy() for c in ("a", "b")]).view(np.uint64)[first]
        n = rows.num_rows
        net = local.Net(len(nodes), at[:n], at[n:], rows.column("weight").to_numpy(), h)
        if turn is None:
            part, after = local.communities(net, resolution, refine), 0
        else:
            of = np.unique(np.concatenate([rows.column(c).to_numpy() for c in ("ca", "cb")])[first], return_inverse=True)[1]
            part, after = local.levels(net, local.named(of), resolution, refine, turn, False)
        yield pa.record_batch([pa.array(nodes, node), pa.array(nodes[part], node), pa.array(np.full(len(nodes), after))], names=["node", "community", "turn"])

    of = lambda side, name: membership.select(F.col("node").alias(side), F.col("community").alias(name))
    held = graph.select(F.col("src").cast(kind), F.col("dst").cast(kind), F.col("weight").cast("double")).join(of("src", "ca"), "src").join(of("dst", "cb"), "dst")
    held = held.select("src", "dst", "weight", F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"), "ca", "cb")
    found = held.coalesce(1).mapInArrow(solve, f"node {kind}, community {kind}, turn long")
    # A node without edges keeps what it has: its own name in a graph, its community's in a level.
    return cut(membership.alias("m").join(found.alias("f"), "node", "left").select("node", F.coalesce("f.community", "m.community").alias("community"), "turn"), "finished")


def louvain(nodes: DataFrame, edges: DataFrame, id_col: str = "id", resolution: float = 1.0, levels: int = 200, rounds: int = 1000, refine: bool = False, most: int = MOST_LOCAL) -> DataFrame:
    """``node, community`` by moves of nodes and contraction, the same at every run and at every size.

    Every node stands for itself first. In a round the nodes on one side of a coin move to the
    community where they gain most; rounds go on until none raises modularity, then communities
    become the nodes of a smaller graph. When contraction helps no more, the nodes themselves are
    tried again, until nothing improves. With ``refine`` (Leiden) what is contracted are parts of
    communities: in rounds, single well-connected nodes join the well-connected part of their
    community where they gain most.

    A graph, or what contraction has left of one, that has ``most`` edges or fewer is finished in
    one task, by the same rule and with the same result: weights are whole numbers, so no sum
    depends on an order. ``levels`` and ``rounds`` are safety limits; to reach one is an error.
    """
    edges = cut(_whole_weights(edges), "louvain-edges")
    every = cut(nodes.select(F.col(id_col).alias("node")).distinct().select("node", F.col("node").alias("community")), "louvain")
    if edges.count() <= most:
        return _finished(edges, every, resolution, refine, None).drop("turn")
    if every.count() <= MOST_NODES:
        dealt = _Numbered(edges, every)
        found = dealt.write(_by_passes(dealt.net, resolution, levels, rounds, refine, most))
        dealt.net.drop()
        drop(edges, every)
        return found
    base, alone, turn = _Level(edges, every.select("node")), every, 0
    best = base.score(every, resolution)
    for _ in range(levels):
        held, _, turn = _settled(base, every, resolution, rounds, turn)
        after, turn = _levels(base, held, resolution, refine, levels, rounds, turn, most)
        score = base.score(after, resolution)
        if score <= best:
            base.drop()
            drop(after, *([] if held is every else [held]))
            return every
        drop(*(x for x in (every, held) if x is not alone))  # the level's nodes are read from that one
        every, best = after, score
    raise RuntimeError(f"communities did not settle in {levels} levels")


def _levels(level: _Level, held: DataFrame, resolution: float, refine: bool, most_levels: int, rounds: int, turn: int, most: int) -> tuple[DataFrame, int]:
    """The communities of a level's nodes after contraction, again and again, has helped as far as it does; and the next turn."""
    base, names = level, level.nodes.select("node", F.col("node").alias("at"))  # each node's node of the level
    for _ in range(most_levels):
        inner, turn = _refined(level, held, resolution, rounds, turn) if refine else (held, turn)
        firsts = inner.select(F.col("community").alias("node")).distinct()
        if firsts.count() == inner.count():
            break
        former, names = names, cut(names.join(inner.select(F.col("node").alias("at"), F.col("community").alias("next")), "at").select("node", F.col("next").alias("at")), "names")
        # A part is in its nodes' community, which has the name of its smallest part.
        of = firsts.join(held, "node")
        of = cut(of.join(of.groupBy("community").agg(F.min("node").alias("name")), "community").select("node", F.col("name").alias("community")), "level")
        graph = cut(_contract(level.edges, inner), "contracted")
        drop(former, *([inner] if inner is not held else []))
        if level is not base:
            level.drop()
        if graph.count() <= most:
            done = _finished(graph, of, resolution, refine, turn)
            turn, held = done.agg(F.max("turn")).first()[0] or turn, done.drop("turn")
            break
        level = _Level(graph, of.select("node"))
        held, changed, turn = _settled(level, of, resolution, rounds, turn)
        if not changed and not refine:
            break
    else:
        raise RuntimeError(f"communities did not settle in {most_levels} levels")
    joined = names.join(held.select(F.col("node").alias("at"), "community"), "at")
    first = joined.groupBy("community").agg(F.min("node").alias("name"))
    return cut(joined.join(first, "community").select("node", F.col("name").alias("community")), "louvain"), turn


def leiden(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """Louvain with refinement: only well-connected parts of communities are contracted."""
    return louvain(nodes, edges, refine=True, **how)


def leiden_similar(nodes: DataFrame, edges: DataFrame, least: int = 10, **how) -> DataFrame:
    """``leiden`` over the edges of type ``similar`` alone; every node stays alone where these are fewer than ``least``."""
    similar = edges.filter("type = 'similar'")
    return leiden(nodes, similar if similar.limit(least).count() >= least else similar.limit(0), **how)


def neighbours(relations: DataFrame, facts: DataFrame, seeds: DataFrame, kind: str | None = None, hops: int = 1, per_hop: int | None = None) -> DataFrame:
    """``seed, hop, id, weight``: live facts reached from each seed along directed relations, heaviest first.

    Each node is met once a seed, on its first hop. Every hop joins the frontier
    with the relations; frontiers are written, so plans stay flat.
    """
    links = relations if kind is None else relations.filter(F.col("kind") == kind)
    live = facts.filter(F.col("valid_to").isNull()).select("id")
    links = links.join(live, links["to_id"] == live["id"]).select("from_id", F.col("to_id").alias("id"), "weight")
    frontier = seeds.select(F.col("id").alias("seed"), "id").distinct()
    met, out = frontier, None
    for hop in range(1, hops + 1):
        step = frontier.join(links.withColumnRenamed("id", "to"), F.col("id") == F.col("from_id")).groupBy("seed", F.col("to").alias("id")).agg(F.max("weight").alias("weight"))
        step = step.join(met, ["seed", "id"], "left_anti").select("seed", F.lit(hop).alias("hop"), "id", "weight")
        if per_hop:
            step = first_rows(step, [F.col("seed")], [F.desc("weight"), F.col("id")], per_hop)
        if hops > 1:
            step = cut(step, "hop")
        out = step if out is None else out.unionByName(step)
        frontier = step.select("seed", "id")
        met = met.unionByName(frontier)
    return out


def expand(hits: DataFrame, relations: DataFrame, facts: DataFrame, query: list[float], kind: str = "similar", seeds: int = 2, each: int = 2, least: float = 0.5) -> DataFrame:
    """Neighbours of the best hits that are close to the query themselves, marked ``expanded``; none for fewer than two hits."""
    from_top = hits.orderBy(F.desc("similarity"), "id").limit(seeds)
    enough = hits.limit(2).agg((F.count(F.lit(1)) >= 2).alias("enough"))  # one row
    near = neighbours(relations, facts, from_top, kind, 1, each).join(hits.select("id"), "id", "left_anti").select("id").distinct()
    found = near.join(facts, "id").crossJoin(enough).filter("enough").drop("enough")
    found = found.withColumn("similarity", cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)))).filter(F.col("similarity") >= least)
    return found.withColumn("expanded", F.lit(True))


def belongs_to(facts: DataFrame, weight: float = 0.9) -> DataFrame:
    """Edges from facts to their categories."""
    return facts.select(F.col("node").alias("src"), F.concat(F.lit("cat_"), "category").alias("dst"), F.lit(weight).alias("weight"), F.lit("belongs_to").alias("type")).distinct()


def category_index(facts: DataFrame, node: str = "node", most: int | None = 100_000) -> DataFrame:
    """``category, part, nodes``: the sorted nodes of a category, in one list while it has about ``most`` of them, else in as many by hash; without ``most`` always in one."""
    if most is None:
        return facts.groupBy("category").agg(F.sort_array(F.collect_list(node)).alias("nodes")).select("category", F.lit(0).alias("part"), "nodes")
    sizes = facts.groupBy(F.col("category").alias("of")).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    held = facts.select("category", F.col(node).alias("node")).join(sizes.filter("parts > 1"), F.col("category").eqNullSafe(F.col("of")), "left")
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int")
    return held.groupBy("category", part.alias("part")).agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def without_orphans(nodes: DataFrame, edges: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the removed facts, after those whose content and aliases are all unknown are gone, and then whatever has no edge left but facts."""
    names = nodes.filter("type = 'fact'").select("node", F.explode(F.concat(F.array("content"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key"))
    kept_facts = names.join(truth.select("key"), "key", "left_semi").select("node").distinct()
    gone = nodes.filter("type = 'fact'").join(kept_facts, "node", "left_anti")
    rest = nodes.join(gone.select("node"), "node", "left_anti")
    alive = lambda side: rest.select(F.col("node").alias(side))
    links = edges.join(alive("src"), "src", "left_semi").join(alive("dst"), "dst", "left_semi")
    touched = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node")))
    lone = rest.filter("type <> 'fact'").select("node").join(touched, "node", "left_anti")
    return rest.join(lone, "node", "left_anti"), links, gone


def report(nodes: DataFrame, edges: DataFrame, membership: DataFrame, name: str, most: int = 10, shown: int = 5) -> str:
    """A Markdown summary of the ``most`` largest communities; everything is cut to that size before it is collected."""
    whole = stats(nodes, edges).first()
    top = community_stats(edges, membership).orderBy(F.desc("nodes"), "community").limit(most)
    members = first_rows(membership.join(F.broadcast(top.select("community")), "community"), [F.col("community")], [F.col("node")], shown)
    lines = members.join(nodes, "node").select("community", "node", "type", F.translate(F.substring("content", 1, 100), "\n", " ").alias("content")).collect()
    out = [f"# Graph report: {name}", "", f"- nodes: {whole['nodes']}", f"- edges: {whole['edges']}", f"- density: {whole['density']:.4f}", f"- average degree: {whole['avg_degree']:.2f}", ""]
    for c in top.collect():
        out += [f"## Community {c['community']}: {c['nodes']} nodes, {c['edges']} edges", ""]
        out += [f"- `{r['node']}` ({r['type']}): {r['content']}" for r in sorted((r for r in lines if r["community"] == c["community"]), key=lambda r: r["node"])]
        out.append("")
    return "\n".join(out)
