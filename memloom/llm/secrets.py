"""Secret scans: fixed patterns, and formats learned by grammar inference.

Base spans, per kind leftmost and without overlap:

* ``assign``: a name like password or token, a sign, and a value of 6 characters or more,
* ``access``: AKIA and capitals or digits, 20 characters or more,
* ``hex``: lower-case hexadecimal digits, 24 or more.

Learned spans come on top, never instead. They are learned from labelled tokens:

* credentials: what the base patterns mark in the documents themselves (the value of an
  ``assign``), labelled by the pattern, and examples of public formats, drawn from
  ``FORMATS`` by a seed;
* ordinary tokens: runs of token characters in the documents that no base pattern
  touches, and examples of plain ones, drawn from ``ORDINARY``.

The tokens of a label are put into a prefix tree over classes of characters. States
whose next-symbol and ending frequencies agree by the Hoeffding bound are merged, with
what follows them (ALERGIA; Carrasco and Oncina, 1994), which leaves a probabilistic
automaton per label. All candidates are then scored: each value of a base span, and
each run of ``LEAST`` token characters or more. The likeliest credential format names a
candidate if it is ``LEVEL`` nats likelier than an ordinary token. A run's closing full
stops are not part of it.

Fitting reads about ``FIT_ROWS`` documents, by a hash of id and text, and takes
``EXAMPLES`` tokens of each label, of ``MOST`` characters at most (the bounds are these
parameters); scanning reads every document and whole texts.

The scan works on UTF-8 bytes, in which every pattern is ASCII, and turns the
places of its hits into code points. An absent start sign is found by substring
search, so ordinary prose costs no regular expression.

Defined results: null and empty texts have no spans, the digest of nothing and an
empty list; ids may be null or repeat; an empty table gives an empty result; where the
documents hold no credential only public formats are learned; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.batches import pieces, tidied

BASE = ("assign", "access", "hex")
#: Public credential formats, as literal beginnings and (alphabet, count) runs.
_AZ, _az, _09 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
FORMATS: dict[str, list] = {
    "code_host": ["ghp_", (_AZ + _az + _09, 36)],
    "payment": ["sk_live_", (_AZ + _az + _09, 24)],
    "chat": ["xoxb-", (_09, 12), "-", (_09, 12), "-", (_AZ + _az + _09, 24)],
    "maps": ["AIza", (_AZ + _az + _09 + "_-", 35)],
    "jwt": ["eyJ", (_AZ + _az + _09, 33), ".eyJ", (_AZ + _az + _09, 60), ".", (_AZ + _az + _09 + "_-", 43)],
    "base64": [(_AZ + _az + _09 + "+/", 42), "="],
}
#: Tokens that are no credentials, in the same form. An alphabet may hold whole parts.
_SYLLABLES = ["ab", "con", "de", "en", "er", "ing", "la", "men", "na", "or", "per", "re", "ro", "son", "ta", "ter", "ti", "tion", "un", "ver"]
ORDINARY: dict[str, list] = {
    "word": [(_SYLLABLES, 7)],
    "name": [(_AZ, 1), (_SYLLABLES, 4), (_AZ, 1), (_SYLLABLES, 4)],
    "shout": [(_AZ, 18)],
    "snake": [(_SYLLABLES, 3), "_", (_SYLLABLES, 3), "_", (_SYLLABLES, 2)],
    "kebab": [(_AZ, 1), (_SYLLABLES, 3), "-", (_AZ, 1), (_SYLLABLES, 2), "-", (_09, 4), "-", (_SYLLABLES, 2)],
    "path": ["/", (_SYLLABLES, 2), "/", (_SYLLABLES, 3), "/", (_SYLLABLES, 2), ".", (_az, 3)],
    "host": ["www.", (_SYLLABLES, 3), ".com/", (_SYLLABLES, 2), "/", (_SYLLABLES, 2), "-", (_SYLLABLES, 2), "-", (_09, 4), "/", (_SYLLABLES, 2)],
    "number": [(_09, 20)],
    "figures": [(_09, 9), ".", (_09, 9)],
    "numbered": [(_SYLLABLES, 6), (_09, 2)],
    "coded": [(_09, 20), (_az, 1)],
    "date": [(_09, 4), "-", (_09, 2), "-", (_09, 2), "T", (_09, 6)],
    "rule": ["-" * 20],
    "line": ["=" * 20],
    "dots": ["." * 20],
}
EXAMPLES = 400
FIT_ROWS = 20_000
LEAST = 16
MOST = 200
#: Log odds that a candidate must reach: one run in 10,000 is taken to be a credential.
LEVEL = math.log(10_000)
ALPHA = 0.05
SEED = 11
PLAIN = "ordinary"

_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]+")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TOKEN_MAP = bytes(104 if _TOKEN.match(bytes([b])) else 32 for b in range(256))


def symbol(c: str) -> str:
    """The class of a character; signs stand for themselves."""
    return "0" if c.isdigit() else "h" if c in "abcdef" else "l" if c.islower() else "H" if c in "ABCDEF" else "U" if c.isupper() else c


#: Characters in a class.
_WIDTH = {"0": 10, "h": 6, "l": 20, "H": 6, "U": 20}


def _runs(mapped: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of marked bytes, ``least`` or longer."""
    want, at = b"h" * least, mapped.find(b"h" * least)
    while at >= 0:
        end = mapped.find(b" ", at)
        end = len(mapped) if end < 0 else end
        yield at, end
        at = mapped.find(want, end)


def _based(raw: bytes) -> list[tuple[int, int, int, int]]:
    """Start, end, kind and start of the value of the fixed patterns' spans, in bytes, ordered by start and then kind."""
    out = []
    low = raw.lower()
    starts = set()
    for w in _WORDS:
        at = low.find(w)
        while at >= 0:
            starts.add(at)
            at = low.find(w, at + 1)
    end = 0
    for at in sorted(starts):  # every match begins at one of the names
        if at >= end and (m := _ASSIGN.match(raw, at)):
            end = m.end()
            if len(m[1]) >= 6:
                out.append((at, end, 0, m.start(1)))
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1, m.start()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    out += [(a, b, 2, a) for a, b in _runs(raw.translate(_HEX_MAP), 24)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def candidates(raw: bytes, based: list[tuple[int, int, int, int]], least: int = LEAST) -> list[tuple[int, int, str]]:
    """Start, end and label of all that is scored: the values of base spans, and other runs of token characters (``PLAIN`` where no base span touches them)."""
    found: dict[tuple[int, int], str] = {}
    for _, b, k, at in based:
        found.setdefault((at, b), BASE[k])
    i, reach = 0, 0  # spans in order of their starts; ``reach`` is how far those before ``i`` go
    for a, b in _runs(raw.translate(_TOKEN_MAP), least):
        b = a + len(raw[a:b].rstrip(b"."))
        if b - a < least:
            continue
        while i < len(based) and based[i][0] < b:
            reach = max(reach, based[i][1])
            i += 1
        found.setdefault((a, b), "" if reach > a else PLAIN)
    return [(a, b, label) for (a, b), label in sorted(found.items())]


class Automaton:
    """A probabilistic automaton: per state the log-chance of each symbol with its next state, and of the end."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        # The prefix tree, with counts.
        nxt: list[dict[str, int]] = [{}]
        seen: list[dict[str, int]] = [defaultdict(int)]
        ends: list[int] = [0]
        for word in examples:
            at = 0
            for s in map(symbol, word):
                seen[at][s] += 1
                if s not in nxt[at]:
                    nxt[at][s] = len(nxt)
                    nxt.append({})
                    seen.append(defaultdict(int))
                    ends.append(0)
                at = nxt[at][s]
            ends[at] += 1
        self.nxt, self.seen, self.ends, self.bound = nxt, seen, ends, math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while blue := [(x, r, s) for r in red for s, x in nxt[r].items() if x not in red]:
            b, before, s = min(blue)
            for r in red:
                if self._alike(r, b):
                    nxt[before][s] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        self.chance, self.end = {}, {}
        for r in red:
            total = sum(seen[r].values()) + ends[r]
            self.chance[r] = {s: (math.log((c + 0.01) / (total + 0.2)), nxt[r][s]) for s, c in seen[r].items()}
            self.end[r] = math.log((ends[r] + 0.01) / (total + 0.2))
        del self.nxt, self.seen, self.ends

    def _total(self, q: int) -> int:
        return sum(self.seen[q].values()) + self.ends[q]

    def _alike(self, a: int, b: int) -> bool:
        """All frequencies of the two states, and of those below them, agree by the Hoeffding bound."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m:
                continue
            far = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[p] / n - self.ends[q] / m) > far:
                return False
            for s in self.nxt[p].keys() | self.nxt[q].keys():
                if abs(self.seen[p].get(s, 0) / n - self.seen[q].get(s, 0) / m) > far:
                    return False
                if s in self.nxt[p] and s in self.nxt[q] and self.nxt[p][s] != self.nxt[q][s]:
                    todo.append((self.nxt[p][s], self.nxt[q][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree at ``b`` to the states from ``a`` on."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for s, c in self.seen[q].items():
                self.seen[p][s] += c
            for s, x in self.nxt[q].items():
                if s in self.nxt[p]:
                    if self.nxt[p][s] != x:
                        todo.append((self.nxt[p][s], x))
                else:
                    self.nxt[p][s] = x

    def score(self, word: str) -> float:
        """The log-likelihood of a token and its end; a symbol that its state never saw costs as much as 1 in 5000."""
        at, total = 0, 0.0
        for s in map(symbol, word):
            p, to = self.chance[at].get(s, (-8.5, at))
            total += p - math.log(_WIDTH.get(s, 1))
            at = to
        return total + self.end[at]


class Chain(Automaton):
    """The coarsest automaton: a state for each symbol that came last."""

    def __init__(self, examples: list[str]):
        seen: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for word in examples:
            told = ["", *map(symbol, word), ""]
            for a, b in zip(told, told[1:]):
                seen[a][b] += 1
        names = {a: i for i, a in enumerate(sorted(seen))}
        logs = {a: {b: math.log((c + 0.01) / (sum(n.values()) + 0.2)) for b, c in n.items()} for a, n in seen.items()}
        self.chance = {names[a]: {b: (p, names[b]) for b, p in n.items() if b} for a, n in logs.items()}
        self.end = {names[a]: n.get("", -8.5) for a, n in logs.items()}


class Plain:
    """Ordinary tokens: a merged automaton, and for what it has not seen the chain of their symbols, half and half."""

    def __init__(self, examples: list[str]):
        self.fine, self.coarse = Automaton(examples), Chain(examples)

    def score(self, word: str) -> float:
        a, b = self.fine.score(word), self.coarse.score(word)
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)


@dataclass
class Formats:
    """Automata of credential formats by name, and the model of ordinary tokens over the same classes."""

    automata: dict[str, Automaton]
    plain: Plain

    def classify(self, word: str) -> tuple[str, float]:
        """The likeliest format, and how much likelier than an ordinary token it makes the word, in nats."""
        name, best = max(((n, a.score(word)) for n, a in self.automata.items()), key=lambda x: x[1])
        return name, best - self.plain.score(word)


def examples(parts: list, n: int, rng: np.random.Generator) -> list[str]:
    return ["".join(p if isinstance(p, str) else "".join(rng.choice(list(p[0]), p[1])) for p in parts) for _ in range(n)]


def learn(labelled: dict[str, list[str]] | None = None, formats: dict[str, list] = FORMATS, n: int = EXAMPLES, seed: int = SEED) -> Formats:
    """Automata of public formats and of ``labelled`` tokens; base kinds get names of their own, ``PLAIN`` joins the ordinary ones."""
    rng = np.random.Generator(np.random.PCG64(seed))
    automata = {name: Automaton(examples(parts, n, rng)) for name, parts in formats.items()}
    plain = [w for parts in ORDINARY.values() for w in examples(parts, n // len(ORDINARY) + 1, rng)]
    public = Formats(automata, Plain(plain))
    shown = labelled or {}
    # A public format that nobody marked is not an ordinary token.
    more = [w for w in shown.get(PLAIN, []) if public.classify(w)[1] < LEVEL]
    learned = {f"like_{kind}": Automaton(shown[kind]) for kind in BASE if shown.get(kind)}
    return Formats(learned | automata, Plain(plain + more) if more else public.plain)


def labelled_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, each: int = EXAMPLES) -> dict[str, list[str]]:
    """At most ``each`` distinct tokens of every label, by hash, from about ``rows`` documents."""
    n = docs.count()
    some = docs.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)).alias("h"))
    some = some.filter(F.col("h") < int(min(1.0, rows / max(n, 1)) * (1 << 30))).select("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, 0):
            found = set()
            for t in texts:
                raw = (t or "").encode()
                found.update((label, raw[a:b].decode()) for a, b, label in candidates(raw, _based(raw)) if label and b - a <= MOST)
            yield pa.record_batch([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["label", "token"])

    got = some.mapInArrow(tidied(run), "label string, token string").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("token"), "token"))
    out: dict[str, list[str]] = defaultdict(list)
    for r in got.withColumn("place", place).filter(F.col("place") <= each).orderBy("label", "place").collect():  # ``each`` of four labels
        out[r["label"]].append(r["token"])
    return dict(out)


def scan_text(text: str | None, formats: Formats, known: dict[bytes, str | None] | None = None, least: int = LEAST, level: float = LEVEL) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text, in code points. ``known`` keeps the verdicts on tokens between calls."""
    raw = (text or "").encode()
    known = {} if known is None else known
    based = _based(raw)
    base = [(a, b, BASE[k]) for a, b, k, _ in based]
    every = list(base)
    for a, b, _ in candidates(raw, based, least):
        word = raw[a:b]
        if word not in known:
            if len(known) > 50_000:
                known.clear()
            name, gain = formats.classify(word.decode())
            known[word] = name if gain >= level else None
        if known[word]:
            every.append((a, b, known[word]))
    if len(raw) != len(text or "") and every:
        lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        place = lambda b: int(lead[b - 1]) if b else 0
    else:
        place = lambda b: b
    base = [(place(a), place(b), k) for a, b, k in base]
    order = {k: i for i, k in enumerate([*BASE, *formats.automata])}
    return base, sorted(((place(a), place(b), k) for a, b, k in every), key=lambda x: (x[0], order[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, formats: Formats | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans``: arrays of structs ``kind, start, end`` of every row. Without ``formats``, the documents' own credentials are learned first."""
    formats = formats or learn(labelled_tokens(docs, id_col, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(formats)  # as many states as the labelled examples allow
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        known: dict[bytes, str | None] = {}
        for batch, texts in pieces(batches, 1):
            found = [scan_text(t, sent.value, known) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([told(b) for b, _ in found], span), pa.array([told(e) for _, e in found], span)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(tidied(run), f"doc_id {dict(rows.dtypes)['doc_id']}, base {kind}, spans {kind}")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, the base spans' digest and all spans as text, of ``scan``'s rows."""
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *(count(k) for k in BASE), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
