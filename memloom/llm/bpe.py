"""BPE encoding and decoding of whole texts with a public tokenizer file.

Every text goes through a tree of concatenations as it is, unsplit. It is halved
down to leaves of ``LEAF`` characters or less, wherever a half may fall; the
leaves of a batch, and a window around each place where two of them meet, are
encoded together, on several threads. Then each join, from the leaves up, takes
the left side's tokens, the window's, and the right side's, changing over at
tokens that a side and the window have in common, at the same places and clear
of the window's edges; a window in which both sides do not agree is doubled and
encoded again. A sequence is the encoding of its text when each two neighbours
encode to themselves (public result on BPE), and every pair then lies inside one
of the three encodings, so the joined sequence is the encoding of the whole.

What a side is made of depends on the tokenizer's file, which is looked at first:

* Where it drops white space and splits there (``_PLAIN``), a token never crosses
  it, so a side is a list of the encodings of the runs between white space; both sides
  agree with a window where a run lies at the same place and has the same tokens. A
  task's bounded cache holds the encodings of runs, for leaves and windows alike. A run of
  plain letters, with or without closing marks, goes to the library's merge model
  as it is, for normalising and splitting would not change it; any other run goes
  through the whole library. Where runs are longer than ``LONG_RUN`` a text is
  joined token by token instead, as for any other file.
* For any other file a side is a list of tokens with their places, from the library.

The tokenizer's file is read on the driver and sent as a broadcast of fixed size.

Defined results: null counts as empty, which has no tokens; texts of any length
are encoded whole; ids may be null or repeat; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import pieces, tidied

LEAF = 1024
CACHE = 60_000
WINDOW = 32
LONG_RUN = 256
#: Threads of the library in a worker: the two halves of a text.
THREADS = 2
#: A pre-token boundary depends on at most so many characters to its right ("'ll").
LOOK = 3

#: The parts of a tokenizer file that leave plain letters in lower case alone.
_PLAIN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: Letters below this code point are their own canonical composition.
_LATIN = "\u0250"
#: The first bytes of U+0300 to U+037F, which hold every mark that composes with an ASCII letter.
_COMPOSING = (b"\xcc", b"\xcd")
#: Marks that form a piece of their own after letters.
_MARKS = b".,!?;:|$%&#*"
_RUN = re.compile(rb"\S+")
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on.
_KEEP = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _KEEP} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _KEEP)}

Tokens = list[tuple[int, int, int]]  # id, start, end


def kind(text: str) -> tuple[bool, bool]:
    """Whether a tokenizer file leaves letters in lower case as they are and drops white space, and whether it composes.

    Texts are composed before they are cut, where the file composes them: a cut must not part a letter from its marks.
    """
    spec = json.loads(text)
    plain = _PLAIN == (spec.get("normalizer"), spec.get("pre_tokenizer")) and not spec.get("post_processor") and spec.get("decoder") is None and spec["model"].get("end_of_word_suffix") == "</w>"
    return plain, '"NFC"' in json.dumps(spec.get("normalizer"))


class Encoder:
    """A tokenizer with a bounded cache of encoded pieces."""

    def __init__(self, text: str, leaf: int = LEAF, cache: int = CACHE, known: tuple[bool, bool] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(text)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.most, self.joins = leaf, cache, 0
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.low_added = [a.lower().encode() for a in added]
        self.plain, self.composes = kind(text) if known is None else known

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _placed(self, texts: list[str], at: list[int]) -> list[Tokens]:
        return [[(i, s + k, e + k) for i, (s, e) in zip(x.ids, x.offsets, strict=True)] for x, k in zip(self.tok.encode_batch(texts, add_special_tokens=False), at, strict=True)]

    def tree(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts joined token by token; their leaves are encoded in one batch."""
        parts = [[p for p in (self.added.split(t) if self.added else [t]) if p] for t in texts]
        flat = [unicodedata.normalize("NFC", p) if self.composes else p for ps in parts for p in ps]
        cuts = [_halved(0, len(p), self.leaf) for p in flat]
        leaves = iter(self._placed([p[a:b] for p, c in zip(flat, cuts, strict=True) for a, b in zip(c, c[1:])], [a for c in cuts for a in c[:-1]]))
        done = []
        for p, c in zip(flat, cuts, strict=True):
            level = [(a, b, next(leaves)) for a, b in zip(c, c[1:])]
            while len(level) > 1:
                level = [self._join(p, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            done.append([t[0] for t in level[0][2]] if level else [])
        ids = iter(done)
        return [[i for _ in ps for i in next(ids)] for ps in parts]

    def _join(self, text: str, left: tuple[int, int, Tokens], right: tuple[int, int, Tokens]) -> tuple[int, int, Tokens]:
        (a, at, x), (_, b, y) = left, right
        w = WINDOW
        self.joins += 1
        while True:
            lo, hi = max(a, at - w), min(b, at + w)
            mid = self._placed([text[lo:hi]], [lo])[0]
            ends = (0, 0) if lo == a else _agree_left(x, mid, lo, at - LOOK)
            starts = (len(mid), len(y)) if hi == b else _agree_right(mid, y, at + LOOK, hi)
            if ends and starts and ends[1] <= starts[0]:
                return a, b, x[: ends[0]] + mid[ends[1] : starts[0]] + y[starts[1] :]
            w *= 2

    def _lowered(self, text: str | None) -> bytes:
        """The text in UTF-8, in lower case as far as that does not change its encoding by a ``_PLAIN`` file."""
        raw = (text or "").encode()
        low = raw.lower()
        if any(a in low for a in self.low_added):  # those are looked for before lower-casing
            return raw
        if not any(m in raw for m in _COMPOSING):
            return low
        # The file composes before it lower-cases, and a mark may compose with a small letter only.
        return b" ".join([p.lower() if p.isascii() else p for p in raw.split()])

    def _token(self, run: bytes) -> tuple[bytes, bytes]:
        """The encoding of a run, from the cache or the library."""
        if (found := self.known.get(run) or self.older.get(run)) is None:
            self._learn({run})
            found = self.known[run]
        return found

    def _joined(self, text: bytes, cuts: list[int], leaves: list[list[tuple[bytes, bytes]]]) -> list[tuple[bytes, bytes]] | None:
        """The encoding of a text from those of its leaves, run by run; None where a run is too long to be told by its neighbours.

        At each join a window is encoded. The left side's tokens hold up to the last run that the window
        has at the same place with the same tokens, the right side's from the first such run on.
        """
        level = list(zip(cuts, cuts[1:], leaves))
        while len(level) > 1:
            above = []
            for (a, at, x), (_, b, y) in zip(level[::2], level[1::2]):
                w = WINDOW
                while (found := self._met(text, a, at, b, w, x, y)) is None:
                    w *= 2
                    if w > LONG_RUN:
                        return None
                self.joins += 1
                above.append((a, b, found))
            level = above + level[len(above) * 2 :]
        return level[0][2] if level else []

    def _met(self, text: bytes, a: int, at: int, b: int, w: int, x: list[tuple[bytes, bytes]], y: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]] | None:
        """The sides [a, at) and [at, b) joined over a window; None unless both agree with it, or it holds them from their ends on."""
        lo, hi = max(a, _edge(text, at - w)), min(b, _edge(text, at + w))
        window = [(m.start() + lo, m.end() + lo) for m in _RUN.finditer(text[lo:hi])]
        mid = [self._token(text[s:e]) for s, e in window]
        left, right = (0, 0) if lo == a else None, (len(window), len(y)) if hi == b else None
        for i in range(len(window) - 1, -1, -1):
            s, e = window[i]
            if e <= at and (s > lo or lo == a) and (keep := len(x) - len(text[e:at].split())) > 0 and x[keep - 1] == mid[i]:
                left = keep, i + 1
                break
        for i, (s, e) in enumerate(window):
            if s >= at and (e < hi or hi == b) and (skip := len(text[at:s].split())) < len(y) and y[skip] == mid[i]:
                right = i, skip
                break
        return x[: left[0]] + mid[left[1] : right[0]] + y[right[1] :] if left and right and left[1] <= right[0] else None

    def _letters(self, piece: bytes) -> tuple[bytes, bytes] | None:
        """The encoding of letters that the normaliser leaves alone, or None."""
        if piece.isalpha():  # of ASCII
            if not piece.islower():
                return None
            word = piece.decode()
        else:
            word = piece.decode()
            if not word.isalpha() or max(word) >= _LATIN or word != word.lower():
                return None
            word = piece.decode("latin-1").translate(_BYTES)
        tokens = self.tok.model.tokenize(word)
        return array("I", [t.id for t in tokens]).tobytes(), " ".join([t.value for t in tokens]).encode()

    def _packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return array("I", ids).tobytes(), self.decode(ids).encode()

    def _learn(self, new: set[bytes]) -> None:
        """Put the encodings of ``new`` pieces into the cache."""
        if len(self.known) + len(new) > self.most:
            self.known, self.older = {}, self.known
        rest: list[bytes] = []
        tails: dict[bytes, list[tuple[bytes, tuple[bytes, bytes]]]] = {}
        for w in new:
            if (found := self.older.get(w)) is not None:
                self.known[w] = found
                continue
            body = w if w.isalpha() else w.rstrip(_MARKS)
            if body and (head := self._letters(body)):
                if len(body) == len(w):
                    self.known[w] = head
                else:
                    tails.setdefault(w[len(body) :], []).append((w, head))
                continue
            rest.append(w)
        rest += [t for t in tails if t not in self.known and t not in new]
        for w, x in zip(rest, self._encode([w.decode() for w in rest]), strict=True):
            self.known[w] = self._packed(x)
        for tail, heads in tails.items():
            ids, names = self.known[tail]
            for w, head in heads:
                self.known[w] = head[0] + ids, head[1] + b" " + names

    def _need(self, runs: list[list[bytes]]) -> None:
        """Have the encodings of all these runs in the cache."""
        new = {w for ws in runs for w in ws if w not in self.known}
        if new and len(self.known) + len(new) > self.most:
            new = {w for ws in runs for w in ws}
        if new:
            self._learn(new)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Per text its ids as little-endian unsigned 32-bit integers, and what they decode to, in UTF-8."""
        if not self.plain:
            return [self._packed(ids) for ids in self.tree([t or "" for t in texts])]
        low = [self._lowered(t) for t in texts]
        cuts = [_halved(0, len(x), self.leaf, x) for x in low]
        leaves = [[x[a:b].split() for a, b in zip(c, c[1:])] for x, c in zip(low, cuts, strict=True)]
        windows = [x[_edge(x, at - WINDOW) : _edge(x, at + WINDOW)].split() for x, c in zip(low, cuts, strict=True) for at in c[1:-1]]
        self._need([ws for x in leaves for ws in x] + windows)
        known = self.known  # a window that grows may start another
        done = [self._joined(x, c, [[known[w] for w in ws] for ws in parts]) for x, c, parts in zip(low, cuts, leaves, strict=True)]
        hard = iter(self.tree([t or "" for t, x in zip(texts, done, strict=True) if x is None]))
        return [self._packed(next(hard)) if x is None else (b"".join([ids for ids, _ in x]), b" ".join([said for ids, said in x if ids])) for x in done]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes; without a decoder that is the tokens' strings, joined by spaces."""
        if self.tok.decoder is not None:
            return self.tok.decode(ids, skip_special_tokens=False)
        return " ".join([t for t in map(self.tok.id_to_token, ids) if t is not None])


def _edge(text: bytes, at: int) -> int:
    """``at`` inside the text, and back to the start of its character."""
    at = min(max(at, 0), len(text))
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _halved(a: int, b: int, leaf: int, text: bytes | None = None) -> list[int]:
    """Bounds of the leaves of [a, b), by halving; all have at most ``leaf`` characters (bytes of a ``text``, give or take a character's)."""
    n = 1
    while (b - a) > n * leaf:
        n *= 2
    places = {a + (b - a) * i // n for i in range(n + 1)} if b > a else {a}
    return sorted({_edge(text, x) for x in places} if text is not None else places)


def _agree_left(x: Tokens, mid: Tokens, lo: int, most: int) -> tuple[int, int] | None:
    """Counts of tokens up to the last common one that ends at or before ``most`` and starts after the window does."""
    ends = {x[i][2]: i for i in range(len(x)) if i + 1 == len(x) or x[i + 1][1] >= x[i][2]}
    for j in range(len(mid) - 2, -1, -1):
        t = mid[j]
        if lo < t[1] and t[2] <= most and mid[j + 1][1] >= t[2] and (i := ends.get(t[2])) is not None and x[i] == t:
            return i + 1, j + 1
    return None


def _agree_right(mid: Tokens, y: Tokens, least: int, hi: int) -> tuple[int, int] | None:
    """Indices of the first common token that starts at or after ``least`` and ends before the window does."""
    starts = {y[i][1]: i for i in range(len(y) - 1, -1, -1) if not i or y[i - 1][2] <= y[i][1]}
    for j in range(1, len(mid)):
        t = mid[j]
        if t[1] >= least and t[2] < hi and mid[j - 1][2] <= t[1] and (i := starts.get(t[1])) is not None and y[i] == t:
            return j, i
    return None


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, cache: int = CACHE) -> DataFrame:
    """``doc_id, n_tokens, ids_le, decoded`` of every row: ``ids_le`` holds the ids as little-endian unsigned 32-bit integers."""
    text = Path(tokenizer).read_text()
    sent = docs.sparkSession.sparkContext.broadcast((text, kind(text)))  # the file is parsed here, once
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_le binary, decoded string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value[0], leaf, cache, sent.value[1])  # a task's own, so that idle workers hold no cache
        for batch, texts in pieces(batches, 1):
            found = encoder.encode(texts)
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x[0]) // 4 for x in found], pa.int64()), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_tokens", "ids_le", "decoded"],
            )

    return rows.mapInArrow(tidied(run), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of ``encode``'s rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
