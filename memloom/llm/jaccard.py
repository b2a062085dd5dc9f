"""Exact Jaccard self-join of documents over sets of word shingles, and its components.

Two documents link when ``den * |intersection| >= num * |union|`` of their sets of
``k``-word shingles. The T-occurrence search finds the links: an inverted index
lists the documents of each shingle; a document's lists are divided into short
ones, which are merged on a heap, and long ones, which are only probed by binary
search for the documents that the short ones leave (DivideSkip; Li, Lu and Lu,
2008); those that reach the required overlap are retained.

A search needs all lists of a document in one place, so documents first meet in
clusters that no link leaves. All shingles are put into one order, rare ones
first, and each document sends only its first ``n - ceil(t * n) + 1`` of ``n``
shingles: linked documents have one of these in common (prefix filter; Chaudhuri
et al., 2006). The components of the graph that joins documents with a common
sent shingle are the clusters. As passages that many documents share come last in
the order, unrelated documents hardly ever meet.

* The order follows a sketch of counters over all documents, gathered in the same
  pass as the sets' keys: two bits each, about one a shingle, so that most unique
  shingles are known as such (these come first, and need not be sent), and one byte
  for 32 of them to tell the frequent ones apart. ``MOST_COUNTERS`` bounds the
  broadcast at 72 MB. Any order gives the same links; where more shingles share a
  counter, more are sent, a share ``1 - t`` of all at most, and clusters grow.
* Clusters of more than ``BLOCK`` sets are divided once more. For a range of sizes the
  hash space of shingles is cut into more parts than two linked sets can differ in,
  so linked sets agree wholly on some part (the pigeonhole of PartEnum; Arasu et al.,
  2006). Within a cluster, sets with an equal part stay together. A part that is
  empty in many sets is no evidence: sets with up to ``spare`` empty parts don't send
  them, for which there are ``spare`` parts more.
* Documents with equal sets are one class; only its smallest id is searched.
* A cluster is cut into blocks of ``BLOCK`` classes. Each block is searched with
  the cluster's smallest member added. Only where that leaves a large cluster in
  several pieces are the classes outside its largest piece searched against all
  of its blocks. Classes known to be connected are skipped in every search.

Shingles are compared by 64-bit hashes, sets by 128 bits of sums of those.

Defined results: null and empty texts have 0 shingles and are linked with nothing;
with fewer than ``k`` words the whole sequence is the one shingle; null ids are
linked with nothing and have a null component; rows that repeat an id have its
component, which the links of all its texts make; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import pieces, tidied
from memloom.operators.components import components
from memloom.shared import cut, drop

BLOCK = 1024
#: Ids that may be broadcast: a hash table of 500,000 longs takes some 16 MB.
MOST_SENT = 500_000
MOST_COUNTERS = 1 << 28
RATIO = 1.25
_CHUNK = 1 << 18
_FLUSH = 1_000_000
HOT_SHARE = 256
MU = 0.01
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, k: int, known: _Words | None = None) -> np.ndarray:
    """The hashes of a text's distinct ``k``-word shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((_Words() if known is None else known).__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        x = _mix(x * _C1 + h[i : len(h) - width + 1 + i])
    return np.unique(x)


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    return int(_mix(h ^ _C1).sum(dtype=np.uint64).astype(np.int64)), int((_mix(h + _C3) * _C1).sum(dtype=np.uint64).astype(np.int64))


class Sketch:
    """How often hashes occur, roughly: 1, 2 or more for a counter, and a logarithm for 32 counters together."""

    def __init__(self, counters: int, fine: np.ndarray, coarse: np.ndarray):
        self.shift, self.fine, self.coarse = np.uint64(65 - counters.bit_length()), fine, coarse

    def rarity(self, h: np.ndarray) -> np.ndarray:
        """0 and 1 for hashes that no two sets have, then more for more frequent ones."""
        at = (h >> self.shift).astype(np.int64)
        exact = (self.fine[at >> 2] >> ((at & 3) << 1).astype(np.uint8)) & np.uint8(3)
        return np.where(exact == 3, np.maximum(self.coarse[at >> 5], np.uint8(3)), exact)


def prefix(h: np.ndarray, sketch: Sketch, num: int, den: int) -> np.ndarray:
    """The shingles that a sorted set sends: the rarest by the sketch, then by hash; those that only it has are left out."""
    rarity = sketch.rarity(h)
    first = np.argsort(rarity, kind="stable")[: len(h) - -(-num * len(h) // den) + 1]
    return h[first[rarity[first] > 1]]


class Scheme:
    """How sets are cut into parts, for pairs whose larger size lies in an interval."""

    def __init__(self, num: int, den: int, ratio: float = RATIO, most: int = 1 << 40):
        self.num, self.den = num, den
        lo, self.bounds = 1, []
        while lo <= most:
            hi = max(lo, int(lo * ratio))
            differ = 2 * hi * (den - num) // (den + num)
            least = -(-num * lo // den)
            spare = 0
            while self._crowded(least, differ + 1 + spare, spare) > 1e-6 and spare < 2 * differ + 6:
                spare += max(1, spare // 16)
            parts = differ + 1 + spare
            self.bounds.append((lo, hi, parts, spare))
            lo = hi + 1
        self.tops = np.array([b[1] for b in self.bounds])

    @staticmethod
    def _crowded(n: int, parts: int, spare: int) -> float:
        """A bound on the chance that ``n`` hashes leave more than ``spare`` of the parts empty."""
        none = spare + 1
        if none >= parts:
            return 0.0
        ways = math.lgamma(parts + 1) - math.lgamma(none + 1) - math.lgamma(parts - none + 1)
        return math.exp(min(0.0, ways + n * math.log1p(-none / parts)))

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """Signatures of the parts of a sorted set, in the scheme of its own size and those of larger partners."""
        n, out = len(h), []
        mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h + _C1), dtype=np.uint64)])
        for i in range(int(np.searchsorted(self.tops, n)), len(self.bounds)):
            lo, _, parts, spare = self.bounds[i]
            if self.num * lo > self.den * n:
                break
            part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            sums = mixed[np.concatenate([starts[1:], [n]])] - mixed[starts]
            there = part[starts]
            if parts - len(starts) > spare:
                none = np.setdiff1d(np.arange(parts, dtype=np.uint64), there)
                sums, there = np.concatenate([sums, np.zeros(len(none), np.uint64)]), np.concatenate([there, none])
            out.append(_mix(_mix(sums + there * _C2) + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        return np.concatenate(out).astype(np.int64)


def search(sets: list[np.ndarray], num: int, den: int, asked: np.ndarray | None = None, piece: np.ndarray | None = None, mu: float = MU) -> list[tuple[int, int]]:
    """Links (positions) that connect what links connect: T-occurrence search by DivideSkip, skipping pairs already connected.

    ``asked`` marks the sets to search for (all, if none), ``piece`` the connected pieces known before.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(token, kind="stable")
    postings, token = owner[order], token[order]
    heads = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]]) if len(token) else np.zeros(1, np.int64)
    names = token[heads[:-1]]
    comp = np.arange(n) if piece is None else np.unique(piece, return_inverse=True)[1]
    links = []
    for x in range(n):
        if not sizes[x] or (asked is not None and not asked[x]):
            continue
        lists = np.searchsorted(names, sets[x])
        start, end = heads[lists], heads[lists + 1]
        length = end - start
        need = -(-num * int(sizes[x]) // den)
        many = min(need - 1, int(need / (mu * math.log2(max(2, int(length.max()))) + 1)))
        by = np.argsort(-length, kind="stable")
        long, short = by[:many], by[many:]
        near = (comp != comp[x]) & (sizes * den >= num * sizes[x]) & (sizes * num <= den * sizes[x])
        if asked is None:
            near[x:] = False  # the pair is met from its other end
        if not near.any():
            continue
        merged = heapq.merge(*(p for i in short if len(p := _kept(postings[start[i] : end[i]], near))))
        count, last = 0, -1
        found: list[tuple[int, int]] = []
        for y in merged:
            if y != last:
                if count >= need - many:
                    found.append((last, count))
                count, last = 0, y
            count += 1
        if last >= 0 and count >= need - many:
            found.append((last, count))
        for y, c in found:
            if comp[y] == comp[x]:
                continue
            total = -(-num * int(sizes[x] + sizes[y]) // (num + den))
            if c + len(long) >= total and c + _probe(postings, start[long], end[long], y) >= total:
                links.append((x, y))
                comp[comp == comp[y]] = comp[x]
    return links


def _kept(ids: np.ndarray, near: np.ndarray) -> list[int]:
    return ids[near[ids]].tolist()


def _probe(postings: np.ndarray, lo: np.ndarray, hi: np.ndarray, y: int) -> int:
    """In how many of the lists [lo, hi) ``y`` is, by binary search in all at once."""
    lo, end = lo.copy(), hi
    hi = hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = postings[np.minimum(mid, len(postings) - 1)] < y
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return int(((lo < end) & (postings[np.minimum(lo, len(postings) - 1)] == y)).sum())


def _profiles(rows: DataFrame, k: int, counters: int) -> DataFrame:
    """``id, n, a, b``: the size and the key of every document's set; and, with ``chunk`` set, the gaps between its task's counters in ``gaps``."""
    shift = np.uint64(65 - counters.bit_length())
    names = ["id", "n", "a", "b", "chunk", "gaps"]

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.sort(np.concatenate(held))
        bounds = np.searchsorted(at, np.arange(0, counters + 1, _CHUNK, dtype=np.uint64))
        for c, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if lo < hi:
                gaps = np.diff(at[lo:hi], prepend=np.uint64(c * _CHUNK)).astype(np.uint32)
                wide = gaps[gaps >= 255]
                blob = np.uint32(hi - lo).tobytes() + np.minimum(gaps, 255).astype(np.uint8).tobytes() + wide.tobytes()
                yield pa.record_batch([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([c], pa.int64()), pa.array([blob], pa.binary())], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        held, size = [], 0
        for batch, texts in pieces(batches, 1):
            n, a, b = [], [], []
            for t in texts:
                h = shingles(t, k, known)
                key = set_key(h)
                n.append(len(h))
                a.append(key[0])
                b.append(key[1])
                held.append(h >> shift)
                size += len(h)
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, a, b)), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], names=names)
            if size >= _FLUSH:
                yield from told(held)
                held, size = [], 0
        if size:
            yield from told(held)

    return rows.mapInArrow(tidied(run), "id long, n long, a long, b long, chunk long, gaps binary")


def _sketch(profiles: DataFrame, counters: int) -> Sketch:
    """The tasks' counters, added up on the executors chunk by chunk."""

    def add(part: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)]
        for x in part.column("gaps"):
            blob = x.as_py()
            n = int(np.frombuffer(blob, np.uint32, 1)[0])
            gaps = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
            gaps[gaps == 255] = np.frombuffer(blob, np.uint8, offset=4 + n).view(np.uint32)
            found.append(np.cumsum(gaps))
        total = np.bincount(np.concatenate(found), minlength=_CHUNK)
        fine = np.minimum(total, 3).astype(np.uint8).reshape(-1, 4)
        fine = fine[:, 0] | fine[:, 1] << 2 | fine[:, 2] << 4 | fine[:, 3] << 6
        coarse = np.log2(np.maximum(total.reshape(-1, 32).sum(axis=1), 1)).astype(np.uint8)
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "fine": pa.array([fine.tobytes()], pa.binary()), "coarse": pa.array([coarse.tobytes()], pa.binary())})

    fine, coarse = np.zeros(max(counters, _CHUNK) // 4, np.uint8), np.zeros(max(counters, _CHUNK) // 32, np.uint8)
    found = profiles.filter("chunk IS NOT NULL").select("chunk", "gaps").groupBy("chunk").applyInArrow(add, "chunk long, fine binary, coarse binary")
    # ``counters`` of two bits altogether, MOST_COUNTERS at most.
    for r in found.toLocalIterator():
        c = r["chunk"]
        fine[c * _CHUNK // 4 : (c + 1) * _CHUNK // 4] = np.frombuffer(r["fine"], np.uint8)
        coarse[c * _CHUNK // 32 : (c + 1) * _CHUNK // 32] = np.frombuffer(r["coarse"], np.uint8)
    return Sketch(counters, fine, coarse)


def _combined(sigs: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    """``sig, id`` with one row a signature. Another set with it is tied to the first by a signature of their own, once for all that they share.

    So what many sets of a task share goes to one reducer once, and their ties are dealt evenly.
    """
    sig, own = np.concatenate(sigs), np.concatenate(ids)
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    hub = own[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
    tied = ~new & (hub != own)
    pairs = np.unique(np.stack([own[tied], hub[tied]]), axis=1)
    tie = _mix(_mix(pairs[0].view(np.uint64)) * _C1 + pairs[1].view(np.uint64))
    sig, own = np.concatenate([sig[new], tie, tie]), np.concatenate([own[new], pairs[0], pairs[1]])
    return pa.record_batch([pa.array(sig.view(np.int64)), pa.array(own)], names=["sig", "id"])


def _prefixes(rows: DataFrame, k: int, num: int, den: int, sent: Broadcast) -> DataFrame:
    """``sig, id``: the shingles that each set sends, by the sketch that was ``sent``, unless the task has met its equal."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        seen, sigs, ids, size = set(), [], [], 0
        for batch, texts in pieces(batches, 1):
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                h = shingles(t, k, known)
                if i is None or not len(h) or (key := set_key(h)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                s = prefix(h, sent.value, num, den)
                sigs.append(s)
                ids.append(np.full(len(s), i, np.int64))
                size += len(s)
            if size >= _FLUSH:
                yield _combined(sigs, ids)
                sigs, ids, size = [], [], 0
        if size:
            yield _combined(sigs, ids)

    return rows.mapInArrow(tidied(run), "sig long, id long")


def _divided(clusters: DataFrame, texts: DataFrame, k: int, scheme: Scheme, block: int) -> DataFrame:
    """``clusters`` (``label, rep``) with the large ones divided into sets that are connected by equal parts."""
    clusters = cut(clusters, "clusters")
    large = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    inside = cut(clusters.join(large, "label").select("label", "rep"), "large")
    ids = bounded(inside)
    if inside.isEmpty():
        return clusters

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        sigs, reps, size = [], [], 0
        for batch, part in pieces(batches, 2):
            for label, rep, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), part, strict=True):
                if not len(h := shingles(t, k, known)):  # an id may repeat with an empty text
                    continue
                # Signatures of one cluster don't meet those of another.
                s = _mix(scheme.signatures(h).view(np.uint64) ^ _mix(np.full(1, label, np.int64).view(np.uint64)))
                sigs.append(s)
                reps.append(np.full(len(s), rep, np.int64))
                size += len(s)
            if size >= _FLUSH:
                yield _combined(sigs, reps)
                sigs, reps, size = [], [], 0
        if size:
            yield _combined(sigs, reps)

    met = texts.select(F.col("id").alias("rep"), "text").join(ids, "rep").select("label", "rep", "text").mapInArrow(tidied(parts), "sig long, id long")
    met = met.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_meetings, "u long, v long")
    found = components(met).select("label", F.col("node").alias("rep"))
    drop(inside)
    return clusters.join(large.select("label"), "label", "left_anti").unionByName(found)


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the first id of each run of equal signatures to the others; rows come in order."""
    last_sig, hub = None, None
    for batch in batches:
        sig, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        new = np.concatenate([[sig[0] != last_sig], sig[1:] != sig[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        hubs = np.where(first >= 0, ids[first], hub if hub is not None else ids[0])
        last_sig, hub = sig[-1], int(hubs[-1])
        some = hubs != ids
        if some.any():
            pairs = np.unique(np.stack([ids[some], hubs[some]]), axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])


def bounded(ids: DataFrame) -> DataFrame:
    """Marks a table of ids for broadcast if, counted, it has ``MOST_SENT`` rows at most; else texts are shuffled to meet it."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def _cells(cells: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links ``u, v`` found in every cell of ``cells`` (``label, i, j, rep, asked, piece``)."""

    def run(cell: pa.Table) -> pa.Table:
        rows, known = cell.sort_by("rep").to_pydict(), _Words()
        # An id may repeat: each of its texts is searched, and their equal pieces hold them together.
        keep = sorted({(r, t): i for i, (r, t) in enumerate(zip(rows["rep"], rows["text"], strict=True))}.values())
        reps = [rows["rep"][i] for i in keep]
        sets = [shingles(rows["text"][i], k, known) for i in keep]
        got = search(sets, num, den, None if all(rows["asked"]) else np.array([rows["asked"][i] for i in keep]), np.array([rows["piece"][i] for i in keep]))
        return pa.table({"u": pa.array([reps[x] for x, _ in got], pa.int64()), "v": pa.array([reps[y] for _, y in got], pa.int64())})

    # Texts are smaller than the sets of their shingles.
    meet = texts.select(F.col("id").alias("rep"), "text").join(bounded(cells), "rep")
    return meet.groupBy("label", "i", "j").applyInArrow(run, "u long, v long")


def _links(clusters: DataFrame, texts: DataFrame, k: int, num: int, den: int, block: int) -> DataFrame:
    """Links that connect the classes of each cluster as all its links do."""
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("anchor")).filter("size > 1")
    many = F.ceil(F.col("size") / block).cast("long")
    spread = F.pmod(F.xxhash64("rep"), many)
    nodes = cut(clusters.join(sizes, "label").select("label", "rep", "anchor", "size", many.alias("blocks"), spread.alias("i")), "nodes")
    alone = F.lit(0).cast("long")
    cells = nodes.select("label", "i", alone.alias("j"), "rep")
    anchors = nodes.filter("blocks > 1 AND rep = anchor").select("label", F.explode(F.sequence(alone, F.col("blocks") - 1)).alias("i"), alone.alias("j"), "rep")
    first = cells.unionByName(anchors).distinct().select("*", F.lit(True).alias("asked"), F.col("rep").alias("piece"))
    links = cut(_cells(first, texts, k, num, den), "links")
    large = nodes.filter("blocks > 1")
    if large.isEmpty():
        return links
    # Large clusters in several pieces: what is outside the largest piece is searched against every block.
    pieces_ = components(links).select(F.col("node").alias("rep"), F.col("label").alias("piece"))
    held = cut(large.join(pieces_, "rep", "left").withColumn("piece", F.coalesce("piece", "rep")), "pieces")
    weight = held.groupBy("label", "piece").agg(F.count(F.lit(1)).alias("c"))
    main = weight.groupBy("label").agg(F.max_by("piece", F.struct("c", "piece")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("top")).filter("top < all")
    rest = held.join(main, "label")
    apart = rest.filter("piece <> main")
    outer = apart.groupBy("label").agg(F.count(F.lit(1)).alias("left_over")).select("label", F.ceil(F.col("left_over") / block).cast("long").alias("groups"))
    rest = rest.join(outer, "label")
    group = F.pmod(F.xxhash64(F.lit("q"), "rep"), F.col("groups"))
    index = rest.select("label", "i", F.explode(F.sequence(alone, F.col("groups") - 1)).alias("j"), "rep", F.lit(False).alias("asked"), "piece")
    asked = rest.filter("piece <> main").select("label", F.explode(F.sequence(alone, F.col("blocks") - 1)).alias("i"), group.alias("j"), "rep", F.lit(True).alias("asked"), "piece")
    second = index.unionByName(asked).groupBy("label", "i", "j", "rep", "piece").agg(F.max("asked").alias("asked"))
    return links.unionByName(cut(_cells(second, texts, k, num, den), "links"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; ``component_id`` is the smallest id that links reach."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(MOST_COUNTERS, 1 << max(18, (size // 12).bit_length()))
    profiles = cut(_profiles(rows, k, counters), "profiles")
    base = profiles.filter("chunk IS NULL").select("id", "n", "a", "b")
    classes = base.filter("n > 0 AND id IS NOT NULL").groupBy("a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sent = docs.sparkSession.sparkContext.broadcast(_sketch(profiles, counters))
    met = _prefixes(rows, k, num, den, sent).repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_meetings, "u long, v long")
    labels = components(met)
    sent.destroy()  # the components are written
    nodes = labels.join(base.select(F.col("id").alias("node"), "a", "b"), "node").select("label", "a", "b").distinct()
    clusters = _divided(nodes.join(classes, ["a", "b"]).select("label", "rep").distinct(), rows, k, Scheme(num, den), block)
    links = _links(clusters, rows, k, num, den, block)
    # Ids that repeat with different sets tie the classes of these together.
    several = base.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("a", "b")).alias("least"), F.max(F.struct("a", "b")).alias("most"))
    several = cut(several.filter("least <> most").select("id"), "several")
    repeats = not several.isEmpty()
    if repeats:
        ties = base.filter("n > 0").join(bounded(several), "id").select("id", "a", "b").distinct().join(classes, ["a", "b"])
        links = links.unionByName(ties.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    linked = components(links)
    found = cut(classes.join(linked.select(F.col("node").alias("rep"), "label"), "rep", "left").select("a", "b", F.coalesce("label", "rep").alias("component"), "copies"), "classes")
    # Back to the documents. Classes with more than 1/256 of all rows, 256 at most, are broadcast.
    floor = max(2, base.count() // HOT_SHARE)
    hot = found.filter(F.col("copies") > floor).select("a", "b", F.col("component").alias("_hot"))
    cold = found.filter(F.col("copies") <= floor).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("component").alias("_cold"))
    out = base.join(F.broadcast(hot), ["a", "b"], "left")
    # Rows that need no partner are dealt by their ids, where nothing matches.
    loose = F.col("_hot").isNotNull() | (F.col("n") == 0) | F.col("id").isNull()
    out = out.withColumn("_ka", F.when(loose, F.xxhash64("id", "n")).otherwise(F.col("a"))).withColumn("_kb", F.when(loose, F.lit(None)).otherwise(F.col("b")))
    out = out.join(cold, (F.col("_ka") == F.col("_a")) & (F.col("_kb") == F.col("_b")), "left")
    if repeats:  # a row without shingles has the component of its id's other rows
        out = out.join(bounded(several.join(linked.select(F.col("node").alias("id"), F.col("label").alias("_of_id")), "id")), "id", "left")
    own = F.when(F.col("n") == 0, F.coalesce("_of_id", "id") if repeats else F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(own, "_hot", "_cold", "id")).alias("component_id"))


def keep_representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all columns; rows with a null id stay."""
    found = jaccard_components(docs, k, num, den, id_col, text_col)
    gone = bounded(cut(found.filter("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone"))
    return docs.join(gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 90 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""
