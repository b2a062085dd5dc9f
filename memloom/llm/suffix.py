"""Removal of repeated byte strings, by enhanced suffix arrays whose common-prefix intervals are scanned for maximal repeats.

A string of ``LENGTH`` bytes (100) is repeated where it also starts earlier: in a document
with a smaller id, or before in the same one. The work is dealt so that equal strings meet:

1. Documents are packed into chunks of some ``CHUNK`` bytes, written once.
2. Of the 32-byte grams in a string the one with the smallest hash is its *anchor*; equal
   strings have equal anchors at equal places. Each chunk sends its distinct anchor hashes,
   8 bytes for some 36 of text, to ranges of hashes, where those in several chunks are marked.
3. Strings whose anchor is found once are unique and stay home. The others, in runs that share
   one anchor (a *piece*, of 168 bytes at most), go to the cell of their anchor, equal pieces of
   a chunk once with all their places.
4. A cell sorts the suffixes of its pieces, word by word, with the lengths of their common
   prefixes. A scan with a stack visits the intervals of suffixes that share ``LENGTH`` bytes
   or more, the common-prefix interval tree, and keeps those whose left neighbours differ:
   the maximal repeats of the cell, each with all its occurrences. What is the same to the left
   throughout belongs to a longer repeat; the start of a piece counts as different.
5. All occurrences but the first are covered; the covered bytes go back to their chunk.

Bytes are compared, hashes only deal the work. Memory follows ``CHUNK``, ``RANGE`` and ``CELL``.
An anchor in more than ``HOT`` chunks is not dealt whole: each string around it is a piece of its
own, dealt by its content, and equal ones are combined in their chunk, then by salts, before they
meet in a cell. So a passage in a third of all documents makes no large group.

Defined results: null texts count as empty; texts shorter than ``LENGTH`` have no repeats; of
equal strings the first stays, by smaller id, then in an order of the texts' hashes where an id
repeats with other texts, and null ids last; rows that repeat both id and text are one document,
and each has its result; texts of any length are taken whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import tidied
from memloom.shared import cut, dealt

LENGTH = 100
GRAM = 32
CHUNK = 4 << 20
#: Anchors in a range of hashes, and bytes of text for each cell.
RANGE = 1 << 20
CELL = 8 << 20
#: Chunks beyond which an anchor's strings are dealt by their content.
HOT = 1_024
_SLICE = 1 << 17
_BITS = np.uint64(18)
_MULTIPLIERS = [np.uint64(x | 1) for x in np.random.default_rng(11).integers(1 << 62, 1 << 63, 5).tolist()]
_LAST = np.iinfo(np.int64).max
_SENT = "kind int, cell long, salt long, chunk long, pieces long, places long, size long, blob binary"
_COVERED = "chunk long, n long, blob binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MULTIPLIERS[4]
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIERS[3]
    return x ^ (x >> np.uint64(32))


def _dealt_to(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, in order."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Documents of a packed row, one behind the other in ``body``."""

    def __init__(self, row: dict):
        self.id, self.ids = row["chunk"], row["ids"]
        self.order = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        self.ties = np.array(row["ties"], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.body = pa.decompress(row["body"], decompressed_size=row["n_bytes"], codec="zstd", asbytes=True)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of strings that share an anchor: first start, number of starts, the anchor's place and its hash."""
        n, width = len(self.body), length - GRAM + 1
        some = self.sizes >= length
        edge = np.zeros(n + 1, np.int8)
        edge[self.starts[some]] = 1
        edge[(self.starts + self.sizes - length + 1)[some]] -= 1
        valid = np.cumsum(edge[:n], dtype=np.int8).view(bool)
        padded = np.concatenate([np.frombuffer(self.body, np.uint8), np.zeros(length + GRAM, np.uint8)])
        words = np.ndarray((n + length + GRAM - 7,), "<u8", padded.data, strides=(1,))
        out = []
        for at in range(0, n, _SLICE):
            starts = np.flatnonzero(valid[at : at + _SLICE])
            if not len(starts):
                continue
            m = min(_SLICE, n - at) + width - 1
            g = np.zeros(m, np.uint64)
            for j in range(GRAM // 8):
                g = (g ^ (g >> np.uint64(31))) + words[at + 8 * j : at + 8 * j + m] * _MULTIPLIERS[j]
            g = _mix(g)
            least, size = (g >> _BITS << _BITS) | np.arange(m, dtype=np.uint64), 1
            while 2 * size <= width:
                least, size = np.minimum(least[:-size], least[size:]), 2 * size
            if size < width:
                least = np.minimum(least[: size - width], least[width - size :])
            place = (least[starts] & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            out.append((starts[head] + at, np.diff(np.append(head, len(starts))), place[head] + at, _mix(g[place[head]])))
        if not out:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
        return tuple(np.concatenate(x) for x in zip(*out))


def anchors(place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes in order, and at how many places each is."""
    new = np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]
    return np.unique(h[new], return_counts=True)


def _packed(rows: DataFrame) -> DataFrame:
    """``chunk, ids, ties, sizes, n_bytes, body``: documents in chunks, compressed."""
    names = ["chunk", "ids", "ties", "sizes", "n_bytes", "body"]
    longs = pa.list_(pa.int64())

    def told(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        body = b"".join(texts)
        ties = [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts]
        cols = [pa.array([uuid.uuid4().int >> 65], pa.int64()), *(pa.array([x], longs) for x in (ids, ties, [len(t) for t in texts])), pa.array([len(body)], pa.int64()), pa.array([pa.compress(body, codec="zstd", asbytes=True)], pa.binary())]
        return pa.record_batch(cols, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py() or b""
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield told(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield told(ids, texts)

    return rows.mapInArrow(tidied(run), "chunk long, ids array<long>, ties array<long>, sizes array<long>, n_bytes long, body binary")


def _marks(chunks: DataFrame, length: int, ranges: int) -> DataFrame:
    """``chunk, part, codes``: for each of a chunk's anchors in a range of hashes 0 if no other chunk has it, 1 if one has, 1 + b if b bits of ``HOT`` have."""

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                _, _, place, h = chunk.runs(length)
                u, _ = anchors(place, h)
                at = np.searchsorted(_dealt_to(u, ranges), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(at))
                yield pa.record_batch([pa.array(some, pa.int64()), pa.array([chunk.id] * len(some), pa.int64()), pa.array([u[at[p] : at[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "chunk", "hashes"])

    def marked(group: pa.Table) -> pa.Table:
        sizes = np.array([len(x.as_py()) // 8 for x in group.column("hashes")], np.int64)
        every = np.frombuffer(b"".join(group.column("hashes").to_pylist()), np.uint64)
        order = np.argsort(every)
        ordered = every[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        n = np.diff(np.append(heads, len(ordered)))
        code = np.where(n > 1, 1 + np.ceil(np.log2(np.maximum(1, n / HOT))), 0).astype(np.uint8)
        codes = np.empty(len(every), np.uint8)
        codes[order] = np.repeat(code, n)
        ends = np.cumsum(sizes)
        blobs = [codes[a:b].tobytes() for a, b in zip(ends - sizes, ends)]
        return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "hot": pa.array([bool(len(b)) and max(b) > 1 for b in blobs]), "codes": pa.array(blobs, pa.binary())})

    found = chunks.mapInArrow(tidied(sent), "part long, chunk long, hashes binary")
    return found.groupBy("part").applyInArrow(marked, "chunk long, part long, hot boolean, codes binary")


class Places:
    """Places of pieces: the chunk, the row in it, and what tells which comes first."""

    names = ("chunk", "row", "order", "tie", "start")

    def __init__(self, *cols: np.ndarray):
        self.chunk, self.row, self.order, self.tie, self.start = cols

    def take(self, i: np.ndarray) -> Places:
        return Places(*(getattr(self, c)[i] for c in self.names))

    def values(self) -> np.ndarray:
        """A number for each place, smaller for an earlier one, equal for one and the same."""
        by = np.lexsort((self.tie, self.order))
        order, tie = self.order[by], self.tie[by]
        doc = np.zeros(len(by), np.int64)
        doc[by] = np.cumsum(np.concatenate([[0], (order[1:] != order[:-1]) | (tie[1:] != tie[:-1])])[: len(by)])
        return (doc << 40) + self.start


def _blob(texts: list[bytes], counts: np.ndarray, at: Places) -> tuple[int, int, int, bytes]:
    parts = [np.array([len(t) for t in texts], np.uint16), counts.astype(np.uint32), at.row.astype(np.uint32), at.order, at.tie, at.start]
    raw = b"".join([*(x.tobytes() for x in parts), *texts])
    return len(texts), int(len(at.row)), len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unblob(row: dict) -> tuple[list[bytes], np.ndarray, Places]:
    raw = pa.decompress(row["blob"], decompressed_size=row["size"], codec="zstd", asbytes=True)
    p, o, at, cols = row["pieces"], row["places"], 0, []
    for n, kind in ((p, np.uint16), (p, np.uint32), (o, np.uint32), (o, np.int64), (o, np.int64), (o, np.int64)):
        cols.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += cols[-1].size * np.dtype(kind).itemsize
    ends = at + np.cumsum(cols[0])
    texts = [raw[a:b] for a, b in zip((ends - cols[0]).tolist(), ends.tolist())]
    return texts, cols[1], Places(np.full(o, row["chunk"], np.int64), *cols[2:])


def _coverage(chunk: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """``chunk, n, blob`` of covered intervals, each chunk's merged."""
    by = np.argsort(chunk, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(chunk[by]) != 0])[: len(by)])
    for some in np.split(by, heads[1:]) if len(by) else ():
        r, a, b = merged(row[some], start[some], end[some])
        yield int(chunk[some[0]]), len(r), np.concatenate([r, a, b]).tobytes()


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals of each row, as disjoint intervals that don't touch."""
    by = np.lexsort((start, row))
    row, start, end = row[by], start[by], end[by]
    reach = np.maximum.accumulate((row << 40) + end)
    new = np.concatenate([[True], ((row << 40) + start)[1:] > reach[:-1]])[: len(row)]
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1 if len(row) else np.zeros(0, np.int64)
    return row[new], start[new], reach[last] - (row[new] << 40)


def _covered_batch(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _folded(texts: list[bytes], counts: np.ndarray, at: Places) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct texts, and the text and the order of the places by text."""
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(t, len(known)) for t in texts), np.int64, len(texts))
    which = np.repeat(which, counts)
    by = np.argsort(which, kind="stable")
    return list(known), which[by], by


def _firsts(text: np.ndarray, at: Places) -> np.ndarray:
    """Which places are the first of their text; ``text`` is in order."""
    v = at.values()
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])[: len(text)])
    least = np.minimum.reduceat(v, heads) if len(v) else v
    return v == np.repeat(least, np.diff(np.append(heads, len(v))))


def _sent(length: int, cells: int, tie: bool):
    """Cuts the pieces of a chunk that other chunks or other places of it may repeat: rows of ``_SENT``, by cell.

    ``kind`` 0 are pieces, 1 strings of hot anchors with a salt, 2 covered bytes.
    """

    def run(packed: pa.Table, codes: pa.Table) -> pa.Table:
        chunk = Chunk(packed.to_pylist()[0])
        start, n, place, h = chunk.runs(length)
        u, times = anchors(place, h)
        code = np.frombuffer(b"".join(r["codes"] for r in sorted(codes.to_pylist(), key=lambda r: r["part"])), np.uint8)
        at = np.searchsorted(u, h)
        code, twice = code[at], times[at] > 1
        cool, hot = (code == 1) | (twice & (code == 0)), code > 1
        body, out = chunk.body, []

        def places(pos: np.ndarray) -> Places:
            row = np.searchsorted(chunk.starts, pos, "right") - 1
            # Empty documents start where the next one does; the last of those has the bytes.
            return Places(np.full(len(pos), chunk.id, np.int64), row, chunk.order[row], chunk.ties[row] if tie else np.zeros(len(row), np.int64), pos - chunk.starts[row])

        def add(kind: int, cell: np.ndarray, salt: np.ndarray, texts: list[bytes], counts: np.ndarray, where: Places) -> None:
            by = np.lexsort((salt, cell))
            ends = np.cumsum(counts)
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(cell[by]) != 0) | (np.diff(salt[by]) != 0)])[: len(by)])
            for some in np.split(by, heads[1:]) if len(by) else ():
                held = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in some])
                out.append((kind, int(cell[some[0]]), int(salt[some[0]]), chunk.id, *_blob([texts[i] for i in some], counts[some], where.take(held))))

        s, e = start[cool], (start + n + length - 1)[cool]
        if len(s):
            texts, text, by = _folded([body[a:b] for a, b in zip(s.tolist(), e.tolist())], np.ones(len(s), np.int64), None)
            counts = np.bincount(text, minlength=len(texts))
            heads = by[np.cumsum(counts) - counts]
            add(0, _dealt_to(h[cool][heads], cells), np.zeros(len(texts), np.int64), texts, counts, places(s[by]))
        if hot.any():
            s = np.repeat(start[hot], n[hot])
            s = s + np.arange(len(s)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            salts = np.repeat(np.left_shift(1, code[hot].astype(np.int64) - 1), n[hot])
            texts, text, by = _folded([body[a : a + length] for a in s.tolist()], np.ones(len(s), np.int64), None)
            where = places(s[by])
            first = _firsts(text, where)
            lost = where.take(~first)
            out += [(2, None, None, c, None, None, m, b) for c, m, b in _coverage(lost.chunk, lost.row, lost.start, lost.start + length)]
            counts = np.bincount(text[first], minlength=len(texts))
            key = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
            salt = np.int64(xxhash.xxh3_64_intdigest(chunk.id.to_bytes(8, "big")) >> 1) % salts[by][np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))]
            add(1, _dealt_to(key, cells), salt, texts, counts, where.take(first))
        schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("cell", "salt", "chunk", "pieces", "places", "size")), ("blob", pa.binary())])
        return pa.table([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def _combined(length: int):
    """Of equal strings under one salt the first goes on (``kind`` 0), the others are covered (``kind`` 2)."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        texts, text, by, where = _gathered(rows)
        where = where.take(by)
        first = _firsts(text, where)
        lost = where.take(~first)
        out = [(2, None, None, c, None, None, m, b) for c, m, b in _coverage(lost.chunk, lost.row, lost.start, lost.start + length)]
        won, of = where.take(first), text[first]
        for chunk in np.unique(won.chunk):
            some = np.flatnonzero(won.chunk == chunk)
            names, counts = np.unique(of[some], return_counts=True)
            out.append((0, rows[0]["cell"], 0, int(chunk), *_blob([texts[i] for i in names], counts, won.take(some))))
        return pa.table([pa.array([r[c] for r in out], f.type) for c, f in enumerate(group.schema)], schema=group.schema)

    return run


def _gathered(rows: list[dict]) -> tuple[list[bytes], np.ndarray, np.ndarray, Places]:
    texts, counts, at = [], [], []
    for row in rows:
        t, n, p = _unblob(row)
        texts += t
        counts.append(n)
        at.append(p)
    where = Places(*(np.concatenate([getattr(p, c) for p in at]) for c in Places.names))
    return *_folded(texts, np.concatenate(counts), where), where


class Suffixes:
    """An enhanced suffix array: the suffixes of ``length`` bytes or more of distinct texts, in order, and what each shares with the one before."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        many = sizes - length + 1
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), many)
        self.offset = np.arange(many.sum(), dtype=np.int64) - np.repeat(np.cumsum(many) - many, many)
        pos = np.repeat(starts, many) + self.offset
        self.size = np.repeat(sizes, many) - self.offset
        body = np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8)
        words = np.ndarray((len(body) - 7,), ">u8", body.data, strides=(1,))
        held = np.array([0] + [(1 << 64) - (1 << (64 - 8 * i)) for i in range(1, 9)], np.uint64)
        n = len(pos)
        order, self.common = np.arange(n), np.zeros(n, np.int64)
        open_, group, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(open_) and depth < int(self.size.max(initial=0)):
            now = order[open_]
            left = np.clip(self.size[now] - depth, 0, 8)
            w = words[np.minimum(pos[now] + depth, len(words) - 1)].astype(np.uint64) & held[left]
            by = np.lexsort((w, group)) if depth else np.argsort(w, kind="stable")
            order[open_], w = now[by], w[by]
            near = group[1:] == group[:-1]
            differs = near & (w[1:] != w[:-1])
            at = open_[1:][differs]
            x = w[1:][differs] ^ w[:-1][differs]
            self.common[at] = depth + (64 - _bits(x)) // 8
            tied = near & ~differs
            some = np.concatenate([tied, [False]]) | np.concatenate([[False], tied])
            new = np.cumsum(np.concatenate([[0], ~tied]))
            open_, group, depth = open_[some], new[some], depth + 8
        if len(open_):  # equal to the end of all: the shorter one first
            now = order[open_]
            by = np.lexsort((self.size[now], group))
            order[open_] = now[by]
            self.common[open_[1:][group[1:] == group[:-1]]] = depth
        self.text, self.offset, self.size = self.text[order], self.offset[order], self.size[order]
        self.left = np.where(self.offset > 0, body[np.maximum(pos[order] - 1, 0)].astype(np.int64), -1 - self.text.astype(np.int64))
        if n:
            self.common[1:] = np.minimum(self.common[1:], np.minimum(self.size[1:], self.size[:-1]))
            self.common[0] = 0


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


def scan(common: list[int], size: list[int], left: list[int], often: list[bool]) -> Iterator[tuple[int, int, int, bool]]:
    """``first, last, length, maximal`` of the intervals of suffixes in order that share a prefix, inner ones first, by a scan with a stack.

    ``common[i]`` is what suffix i shares with the one before, ``left`` the byte before each (below 0:
    the start of its text, unlike all others) and ``often`` tells whether a suffix's text is found at several
    places. An interval is maximal if its left neighbours differ.
    """
    many = object()  # several left neighbours
    met = lambda a, b: a if a is b or (a == b and a is not many) else many
    stack: list[list] = []  # length, first suffix, its left neighbours; the common prefixes that are open
    for i in range(1, len(size) + 1):
        now = common[i] if i < len(size) else 0
        first, left_of = i - 1, left[i - 1] if left[i - 1] >= 0 else many
        if often[i - 1] and size[i - 1] > max(now, common[i - 1] if i > 1 else 0):
            yield i - 1, i - 1, size[i - 1], left_of is many
        while stack and stack[-1][0] > now:
            length, first, before = stack.pop()
            left_of = met(before, left_of)
            yield first, i - 1, length, left_of is many
        if now and stack and stack[-1][0] == now:
            stack[-1][2] = met(stack[-1][2], left_of)
        elif now:
            stack.append([now, first, left_of])


def _blocks(s: Suffixes, times: np.ndarray, length: int, least: int) -> Iterator[tuple[int, list[int], list[int], list[int], list[bool]]]:
    """Runs of ``least`` suffixes or more that share ``length`` bytes, with what ``scan`` takes; whole runs with one left neighbour hold no maximal repeat."""
    if not len(s.text):
        return
    lead = np.flatnonzero(np.concatenate([[True], s.common[1:] < length]))
    last = np.append(lead[1:], len(s.text))
    low, high = np.minimum.reduceat(s.left, lead), np.maximum.reduceat(s.left, lead)
    good = ((low < 0) | (low != high)) & (np.add.reduceat(times[s.text], lead) > 1) & (last - lead >= least)
    for a, b in zip(lead[good].tolist(), last[good].tolist()):
        yield a, s.common[a:b].tolist(), s.size[a:b].tolist(), s.left[a:b].tolist(), (times[s.text[a:b]] > 1).tolist()


def repeats(texts: list[bytes], heads: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bytes]]:
    """Maximal repeats of a cell: all places of their texts, the offsets in these, the length and the bytes. Those of text t go from ``heads[t]`` to ``heads[t + 1]``."""
    s, times = Suffixes(texts, length), np.diff(heads)
    for a, *run in _blocks(s, times, length, 1):
        for i, j, size, maximal in scan(*run):
            if maximal:
                which, offset = s.text[a + i : a + j + 1], int(s.offset[a + i])
                at = np.concatenate([np.arange(heads[t], heads[t + 1]) for t in which.tolist()])
                yield at, np.repeat(s.offset[a + i : a + j + 1], times[which]), size, texts[which[0]][offset : offset + size]


def late(texts: list[bytes], value: np.ndarray, heads: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, as numbers, and lengths of occurrences that cover what all occurrences but the first of all maximal repeats of a cell cover.

    Inner intervals come first and share more. Of each only the first occurrence goes on to the interval
    around it, for the others are covered already: here, or, where the interval is not maximal, by the
    longer repeat to its left. So every place is told once, however deep intervals nest.
    """
    first = np.minimum.reduceat(value, heads[:-1]) if len(texts) else value
    sizes = np.array([len(t) for t in texts], np.int64)
    # The interval of a whole text that is found at several places.
    again = value != np.repeat(first, np.diff(heads))
    starts, lengths = [value[again]], [np.repeat(sizes, np.diff(heads))[again]]
    s = Suffixes(texts, length)
    places = first[s.text] + s.offset
    out: list[tuple[int, int]] = []
    for a, common, size, left, _ in _blocks(s, np.diff(heads), length, 2):
        own, open_, told = places[a : a + len(size)].tolist(), [], 0
        for i, j, shared, maximal in scan(common, size, left, [False] * len(size)):
            while told <= j:
                open_.append((told, own[told]))
                told += 1
            lead = own[j]
            inner = len(open_)
            while inner and open_[inner - 1][0] >= i:
                inner -= 1
                lead = min(lead, open_[inner][1])
            if maximal:
                out += [(v, shared) for _, v in open_[inner:] if v != lead]
            del open_[inner:]
            open_.append((i, lead))
    if out:
        found = np.array(out, np.int64)
        starts.append(found[:, 0])
        lengths.append(found[:, 1])
    return np.concatenate(starts), np.concatenate(lengths)


def _cell(length: int):
    """Covers what the maximal repeats of a cell hold, but for their first occurrences."""

    def run(group: pa.Table) -> pa.Table:
        texts, text, by, where = _gathered(group.to_pylist())
        where = where.take(by)
        value = where.values()
        found, size = late(texts, value, np.searchsorted(text, np.arange(len(texts) + 1)), length)
        # Rows that repeat id and text are one document: what is covered in it is covered in each.
        doc = value >> 40
        rows = np.unique(np.stack([doc, where.chunk, where.row]), axis=1)
        low, high = (np.searchsorted(rows[0], found >> 40, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(found & ((1 << 40) - 1), n)
        return _covered_batch(_coverage(rows[1][at], rows[2][at], start, start + np.repeat(size, n)))

    return run


def _listed(length: int):
    """All occurrences of the maximal repeats of a cell."""

    def run(group: pa.Table) -> pa.Table:
        texts, text, by, where = _gathered(group.to_pylist())
        where = where.take(by)
        value = where.values()
        heads = np.searchsorted(text, np.arange(len(texts) + 1))
        out = {c: [] for c in ("group", "length", "doc", "start", "first")}
        for place, offset, size, content in repeats(texts, heads, length):
            v = value[place] + offset
            _, one = np.unique(v, return_index=True)
            out["group"] += [xxhash.xxh3_128_hexdigest(content)] * len(one)
            out["length"] += [size] * len(one)
            out["doc"] += [None if i == _LAST else i for i in where.order[place[one]].tolist()]
            out["start"] += (where.start[place[one]] + offset[one]).tolist()
            out["first"] += (v[one] == v.min()).tolist()
        return pa.table({"group": pa.array(out["group"], pa.string()), "length": pa.array(out["length"], pa.int64()), "doc_id": pa.array(out["doc"], pa.int64()), "start": pa.array(out["start"], pa.int64()), "first": pa.array(out["first"], pa.bool_())})

    return run


def _answers(packed: pa.Table, covered: pa.Table) -> pa.Table:
    """A row for each document of a chunk."""
    chunk = Chunk(packed.to_pylist()[0])
    parts = [np.frombuffer(r["blob"], np.int64).reshape(3, r["n"]) for r in covered.to_pylist()]
    row, start, end = merged(*np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1))
    heads = np.searchsorted(row, np.arange(len(chunk.ids) + 1))
    removed, spans, digests = [], [], []
    for i, (at, size) in enumerate(zip(chunk.starts.tolist(), chunk.sizes.tolist())):
        text, some = memoryview(chunk.body)[at : at + size], slice(heads[i], heads[i + 1])
        digest, done = hashlib.sha256(), 0
        for a, b in zip(start[some].tolist(), end[some].tolist()):
            digest.update(text[done:a])
            done = b
        digest.update(text[done:])
        removed.append(int((end[some] - start[some]).sum()))
        spans.append(int(heads[i + 1] - heads[i]))
        digests.append(digest.hexdigest())
    return pa.table({"doc_id": pa.array(chunk.ids, pa.int64()), "n_bytes": pa.array(chunk.sizes), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": digests})


def _pieces(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The packed chunks, the pieces by cell, and what combining hot strings has covered already."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    chunks = cut(_packed(dealt(rows, "id")), "suffix-chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    ids = chunks.select(F.explode("ids").alias("id"))
    again = not ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    cells = max(1, -(-total // CELL))
    marks = cut(_marks(chunks, length, max(1, -(-total // (RANGE * (length - GRAM + 2) // 2)))), "suffix-marks")
    hot = not marks.filter("hot").isEmpty()
    sent = chunks.groupBy("chunk").cogroup(marks.select("chunk", "part", "codes").groupBy("chunk")).applyInArrow(_sent(length, cells, again), _SENT)
    if not hot:
        return chunks, sent, None
    sent = cut(sent, "suffix-pieces")
    combined = cut(sent.filter("kind = 1").groupBy("cell", "salt").applyInArrow(_combined(length), _SENT), "suffix-combined")
    pieces = sent.filter("kind = 0").unionByName(combined.filter("kind = 0"))
    covered = sent.unionByName(combined).filter("kind = 2").select("chunk", F.col("size").alias("n"), "blob")
    return chunks, pieces, covered


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: what stays of each document without its repeated bytes."""
    chunks, pieces, covered = _pieces(docs, id_col, text_col, length)
    found = pieces.groupBy("cell").applyInArrow(_cell(length), _COVERED)
    found = found if covered is None else found.unionByName(covered)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_answers, schema)


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``group, length, doc_id, start, first``: each occurrence of each group of equal strings, by the digest of the string.

    A repeat is told in the pieces of its anchors, which overlap; a long one has a group for each.
    Of a hot anchor's strings only the first of each chunk or salt is listed.
    """
    _, pieces, _ = _pieces(docs, id_col, text_col, length)
    return pieces.groupBy("cell").applyInArrow(_listed(length), "group string, length long, doc_id long, start long, first boolean")


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS x, octet_length(b)::BIGINT AS n FROM d),
s AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(n - 99)) AS p FROM h WHERE n >= 100)),
late AS (SELECT doc_id, p FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
edges AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM late),
numbered AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM edges),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS rest, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
         FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN x ELSE head || substr(x, 2 * rest + 1) END)) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
"""
