"""Toxicity of documents by weak supervision.

1. Voters. Words and word beginnings that labelled toxic documents hold more often
   than chance allows, and clean ones hardly ever, become lexicon entries and are
   dealt to lexicon voters; near copies of a document count once. How much more often
   is chosen by folds of the labelled rows: the factor with which lexicons of the other
   folds make the fewest errors on each. A voter votes toxic when one of its entries is
   in the document, else it abstains. Pattern voters look at shouting, exclamation runs
   and symbols, and one votes clean when no entry of any lexicon is there.
2. Label model. Expectation maximisation over the votes alone estimates, for both
   classes, how often each voter votes either way: its accuracy and coverage.
   Votes that still go together once the class is known show correlated voters;
   each voter's evidence is divided by the number of voters that it stands for,
   and the estimate is repeated.
3. Classifier. A logistic model over the presence of words and word beginnings is
   trained on the label model's posterior labels. It scores every document.

Fitting reads at most ``FIT_ROWS`` labelled rows (the bound is that parameter;
those with the smallest hashes of their ids, none of them held out). Terms are
counted on the executors, in whole numbers, so that no order of adding matters;
the driver gets the terms that qualify and which rows hold them. Scoring covers
every row and whole texts. Neither labels nor language, source or id are inputs of
a score.

Defined results: null and empty texts hold no words and get the model's base
score; labels that are null or not 0 or 1 are left out; with no usable label, or only
one kind, nothing is learned from words; null ids are never held out; ids may repeat,
each row is scored by its own text, and of a labelled id's texts the least one is
learned from; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import pieces, tidied
from memloom.llm.quality import held_out, labelled
from memloom.shared import cut

FIT_ROWS = 20_000
THRESHOLD = 0.5
STEMS = (3, 4, 5, 6, 7, 8)
VOTERS = 12
FOLDS = 3
FACTORS = (0.4, 0.65, 1.0, 1.5, 2.25)
BANDS = 6
#: A document's weight as a whole number: this over the number of its near copies.
UNIT = 1 << 20
_FLUSH = 100_000
_SALT = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, (BANDS * 4, 2), np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(r"[^\W\d_]+")
TOXIC, CLEAN, ABSTAIN = 1, -1, 0


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def terms(word: str) -> list[str]:
    """A word and its beginnings; these end in a sign that no word has."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def patterns(text: str | None) -> list[int]:
    """Votes of the pattern voters: shouting, exclamation runs, symbols between letters."""
    t = text or ""
    n = max(1, len(t))
    loud = sum(map(str.isupper, t)) > 0.5 * max(20, sum(map(str.isalpha, t)))
    return [TOXIC if loud else ABSTAIN, TOXIC if "!!!" in t else ABSTAIN, CLEAN if sum(map(t.count, "#$%&")) > 0.03 * n else ABSTAIN]


@dataclass
class LabelModel:
    """Per class and voter the chances of a vote for toxic, none, and a vote for clean."""

    prior: float
    chances: np.ndarray  # class, voter, vote + 1
    weight: np.ndarray  # of each voter: 1 / (voters that it stands for)
    accuracy: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])[None, :]
        odds = np.log(self.chances[1, at, votes + 1]) - np.log(self.chances[0, at, votes + 1])
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + odds @ self.weight)))


def label_model(votes: np.ndarray, prior: float, rounds: int = 30, passes: int = 2) -> LabelModel:
    """Estimate from votes alone; ``prior`` is the share of toxic documents to begin with."""
    n, m = votes.shape
    prior = min(max(prior, 1e-3), 0.5)
    weight = np.ones(m)
    is_vote = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    post = 1 / (1 + np.exp(-(votes.sum(axis=1) - 0.5) * 2.0))
    for _ in range(passes):
        for _ in range(rounds):
            both = np.stack([1 - post, post])
            chances = (np.einsum("cn,nmv->cmv", both, is_vote) + 0.1) / (both.sum(axis=1)[:, None, None] + 0.3)
            prior = min(max(float(post.mean()), 1e-3), 0.6)
            model = LabelModel(prior, chances, weight, np.zeros(m), np.zeros((m, m)))
            post = model.posterior(votes)
        both = np.stack([1 - post, post])
        x = votes.astype(np.float64)
        joint = np.zeros((m, m))
        for k in both:  # what is left of the votes' covariance within each class
            mean = (k @ x) / max(k.sum(), 1e-9)
            c = ((x - mean) * k[:, None]).T @ (x - mean) / max(k.sum(), 1e-9)
            joint += c * k.sum() / n
        sd = np.sqrt(np.maximum(np.diag(joint), 1e-9))
        correlation = np.clip(joint / sd[:, None] / sd[None, :], -1, 1)
        strong = np.where(np.abs(correlation) > 0.3, np.abs(correlation), 0)
        np.fill_diagonal(strong, 1)
        weight = 1 / strong.sum(axis=1)
    agreed = np.where(votes == TOXIC, post[:, None], 1 - post[:, None])
    cast = votes != ABSTAIN
    accuracy = (agreed * cast).sum(axis=0) / np.maximum(cast.sum(axis=0), 1)
    return LabelModel(prior, chances, weight, accuracy, correlation)


def contexts(low: np.ndarray) -> np.ndarray:
    """The first near copy of each document among them: copies of one document tell one thing once.

    ``low`` holds minimum hashes of the documents' word runs; near copies have one of ``BANDS`` groups of them in common.
    """
    n, width = len(low), low.shape[1] // BANDS
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for b in range(BANDS):
        first: dict[tuple, int] = {}
        for i, key in enumerate(map(tuple, low[:, b * width : (b + 1) * width].tolist())):
            x, y = find(i), find(first.setdefault(key, i))
            top[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


def minima(text: str | None) -> list[int]:
    """Minimum hashes of the text's runs of three words."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in (text or "").lower().encode().split()] or [0], np.uint64)
    with np.errstate(over="ignore"):
        runs = h if len(h) < 3 else h[:-2] * _SALT[0, 0] + (h[1:-1] ^ h[2:] * _SALT[1, 0]) * _SALT[2, 0]
        return [int(((runs * a) ^ ((runs * b) >> np.uint64(31))).min() >> np.uint64(1)) for a, b in _SALT]


@dataclass
class Lexicon:
    """Entries and the voter that each was dealt to."""

    voter: dict[str, int] = field(default_factory=dict)

    def votes(self, text: str | None) -> list[int]:
        hit = [ABSTAIN] * VOTERS
        for w in words(text):
            for t in terms(w):
                if (v := self.voter.get(t)) is not None:
                    hit[v] = TOXIC
        return [*hit, ABSTAIN if any(hit) else CLEAN, *patterns(text)]


def need(kinds: int, rate: float) -> float:
    """How many toxic documents must hold one of so many terms until chance can hardly be why."""
    return (np.log(kinds) + 2) / np.log(1 / rate)


def entries(toxic: np.ndarray, clean: np.ndarray, least: float) -> np.ndarray:
    """Which terms go into a lexicon: in ``least`` toxic documents or more, and in hardly any clean one."""
    return (toxic > 1) & (toxic >= least) & (clean <= 0.02 * toxic)


def chosen_factor(toxic: np.ndarray, clean: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, fold: np.ndarray, kinds: int) -> float:
    """The factor whose lexicons, learned without a fold, tell that fold's documents with the least weight of errors; of equals the strictest.

    ``toxic`` and ``clean`` count terms by fold; ``pairs`` are the rows and terms that go together.
    """
    row, term = pairs
    wrong = np.zeros(len(FACTORS))
    for f in range(toxic.shape[1]):
        rest = fold != f
        rate = float((y * weight)[rest].sum() / max(weight[rest].sum(), 1e-9))
        if not 0 < rate < 1:
            continue
        t, c = (x.sum(axis=1) - x[:, f] for x in (toxic, clean))
        for i, factor in enumerate(FACTORS):
            hit = np.zeros(len(y), bool)
            hit[row[entries(t, c, factor * need(kinds, rate))[term]]] = True
            wrong[i] += float(weight[(fold == f) & (hit != (y > 0))].sum())
    return max(f for f, x in zip(FACTORS, wrong) if x <= wrong.min() + 1e-9)


@dataclass
class Linear:
    """Weights of terms, and what is left over."""

    weights: dict[str, float]
    base: float

    def scores(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """``known`` keeps the evidence of words between calls; a term counts once a document, through its heaviest word."""
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            found: dict[str, float] = {}
            for w in words(t):
                if (hit := known.get(w)) is None:
                    if len(known) > 300_000:
                        known.clear()
                    hit = known[w] = [(x, self.weights[x]) for x in terms(w) if x in self.weights]
                if hit:
                    found.update(hit)
            out[i] = self.base + sum(found[k] for k in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def qualify(many: np.ndarray, toxic: np.ndarray, rate: float, sure: float = 4.3, clear: float = 0.9) -> np.ndarray:
    """Which terms the classifier looks at: those ``sure`` deviations off chance.

    Terms that speak for label 1 must do so in the share ``clear`` of their documents, or long texts would gather it from many weak ones.
    """
    told = np.abs(toxic - many * rate) / np.sqrt(many * rate * (1 - rate) + 0.25)
    return (told > sure) & ((toxic >= clear * many) | (toxic < many * rate))


def linear(names: list[str], pairs: tuple[np.ndarray, np.ndarray], post: np.ndarray, weight: np.ndarray, steps: int = 600, l2: float = 1e-4) -> Linear:
    """Logistic regression of posterior labels on the presence of terms."""
    row, col = pairs
    n = max(1e-9, float(weight.sum()))
    rate = min(max(float(post @ weight / n), 1e-3), 1 - 1e-3)
    x = np.append(np.zeros(len(names)), np.log(rate / (1 - rate)))
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, steps + 1):  # Adam with a falling rate
        raw = x[-1] + np.bincount(row, x[col], len(post))
        d = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - post) * weight / n
        g = np.append(np.bincount(col, d[row], len(names)) + l2 * x[:-1] / n, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    return Linear({t: float(w) for t, w in zip(names, x, strict=False) if abs(w) > 1e-3}, float(x[-1]))


def _told(sample: DataFrame) -> DataFrame:
    """``r, y, w, p, m``: what the voters and the classifier look at, and the minimum hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 1):
            columns = [pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string())), pa.array([patterns(t) for t in texts], pa.list_(pa.int32())), pa.array([minima(t) for t in texts], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(2), *columns], names=["r", "y", "w", "p", "m"])

    return sample.mapInArrow(tidied(run), "r int, y double, w array<string>, p array<int>, m array<long>")


def _counted(told: DataFrame, parts: np.ndarray) -> DataFrame:
    """``term, c0, c1, ...``: sums over the rows that hold a term; ``parts`` has a line for each row number and a column for each sum."""
    width = parts.shape[1]
    sent = told.sparkSession.sparkContext.broadcast(parts)  # as many lines as rows are fitted
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        total = np.zeros((2 * _FLUSH, width), np.int64)

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(place), pa.string()), *(pa.array(total[: len(place), i]) for i in range(width))], names=["term", *names])

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                for r, held in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    every = sorted({t for w in held for t in terms(w)})
                    for b in range(0, len(every), _FLUSH):
                        at = [place.setdefault(t, len(place)) for t in every[b : b + _FLUSH]]
                        total[at] += sent.value[r]
                        if len(place) >= _FLUSH:
                            yield out()
                            place.clear()
                            total[:] = 0
        if place:
            yield out()

    found = told.select("r", "w").mapInArrow(tidied(run), ", ".join(["term string", *(f"{c} long" for c in names)]))
    return found.groupBy("term").agg(*(F.sum(c).alias(c) for c in names))


def _holding(told: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and places in ``names`` of all rows and terms that go together."""
    sent = told.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})  # terms of the fitted rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                found = [sorted({sent.value[t] for w in held for t in terms(w) if t in sent.value}) for held in some.column(1).to_pylist()]
                yield pa.record_batch([some.column(0), pa.array(found, pa.list_(pa.int32()))], names=["r", "t"])

    got = told.select("r", "w").mapInArrow(tidied(run), "r int, t array<int>").toArrow().sort_by("r")
    lists = got.column("t").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    r = got.column("r").to_numpy()
    return np.repeat(r, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Linear, LabelModel | None, Lexicon]:
    """The classifier, with the label model and lexicon that it was trained from."""
    told = cut(_told(labelled(docs, labels, "toxic", rows)), "toxicity-rows")
    seen = told.select("r", "y", "p", "m").toArrow().sort_by("r")  # ``rows`` at most, without their words
    if not seen.num_rows:
        return Linear({}, -40.0), None, Lexicon()
    number = seen.column("r").to_numpy()
    y, low, shown = seen.column("y").to_numpy(), np.array(seen.column("m").to_pylist()), np.array(seen.column("p").to_pylist())
    group = contexts(low)
    whole = UNIT // np.bincount(group, minlength=len(group))[group]
    weight, fold = whole / UNIT, group % FOLDS
    place = np.full(number.max() + 1, -1)
    place[number] = np.arange(len(number))

    def at_rows(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(place), len(columns)), np.int64)
        out[number] = np.stack(columns, axis=1)
        return out

    def held(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        r, t = _holding(told, names)
        return place[r], t

    lex, rate = Lexicon(), float((y * weight).sum() / weight.sum())
    votes = np.zeros((len(y), VOTERS), np.int64)
    if 0 < rate < 1:
        by_fold = [whole * (y == k) * (fold == f) for k in (1, 0) for f in range(FOLDS)]
        counts = cut(_counted(told, at_rows(by_fold)), "toxicity-terms")
        kinds = counts.count()
        toxic, clean = ([F.col(f"c{k * FOLDS + f}") for f in range(FOLDS)] for k in (0, 1))
        some = F.lit(False)
        for f in [None, *range(FOLDS)]:  # hardly any clean document, with all folds or without one
            t, c = (sum((x for i, x in enumerate(side) if i != f), F.lit(0)) for side in (toxic, clean))
            some = some | ((t > UNIT) & (c <= 0.02 * t))
        least = min(FACTORS) * need(kinds, max(rate / 2, 1e-6)) * UNIT
        got = counts.filter(some & (sum(toxic, F.lit(0)) >= int(least))).orderBy("term").toArrow()
        names = got.column("term").to_pylist()
        sums = np.array([got.column(f"c{i}").to_numpy() for i in range(2 * FOLDS)]).T / UNIT
        pairs = held(names)
        factor = chosen_factor(sums[:, :FOLDS], sums[:, FOLDS:], pairs, y, weight, fold, kinds)
        t, c = sums[:, :FOLDS].sum(axis=1), sums[:, FOLDS:].sum(axis=1)
        good = np.flatnonzero(entries(t, c, factor * need(kinds, rate)))
        good = good[np.lexsort((good, -t[good]))]  # the commonest first, dealt in turn
        voter = np.full(len(names), -1)
        voter[good] = np.arange(len(good)) % VOTERS
        lex = Lexicon({names[i]: int(voter[i]) for i in good})
        row, term = (x[voter[pairs[1]] >= 0] for x in pairs)
        votes[row, voter[term]] = TOXIC
    votes = np.hstack([votes, np.where(votes.any(axis=1), ABSTAIN, CLEAN)[:, None], shown])
    model = label_model(votes, float(y.mean()))
    post = model.posterior(votes)
    counts = _counted(told, at_rows([whole, np.rint(whole * post).astype(np.int64)]))
    rate = min(max(float(post @ weight / weight.sum()), 1e-6), 1 - 1e-6)
    # Only terms that may be far enough off chance come to the driver; they are rated there.
    many, toxic = F.col("c0") / UNIT, F.col("c1") / UNIT
    off = F.abs(toxic - many * rate) > 4 * F.sqrt(many * rate * (1 - rate) + 0.25)
    got = counts.filter(off).orderBy("term").toArrow()
    good = qualify(got.column("c0").to_numpy() / UNIT, got.column("c1").to_numpy() / UNIT, rate)
    names = [t for t, g in zip(got.column("term").to_pylist(), good, strict=True) if g]
    return linear(names, held(names), post, weight), model, lex


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model, _, _ = fit(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of terms of the fitted rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch, texts in pieces(batches, 2):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sent.value.scores(texts, known), pa.float64())], names=["doc_id", "held_out", "score"])

    out = rows.mapInArrow(tidied(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
