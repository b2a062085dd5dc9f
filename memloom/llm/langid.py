"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code
point alone. A trigram's vector binds (multiplies) its letters' vectors, permuted
by their places; a document bundles (adds) the vectors of all its trigrams over
the whole text; a language's prototype bundles its training documents. A document
gets the language whose prototype has the largest cosine with it.

Letters are compared in lower case; everything else is one boundary sign.
Trigrams are counted first and multiplied with their vectors once per batch of
documents, so the cost follows the batch's distinct trigrams.

Training rows: text and non-null language of the rows that ``train`` selects, at
most about ``per_language`` of them each (by a hash of the id; the bound is this
parameter). Prototypes are summed on the executors; only one vector per language
reaches the driver and the workers. All languages are learned; a table that names
more than ``MOST_LANGUAGES`` of them is refused with an error, for the model would
not fit a worker.

A prediction takes the text alone to a worker, once, and brings the verdict back;
all other columns stay where they are.

Defined results: ``und`` with score 0 for null texts and texts without a letter,
and for all when nothing was learned; equal cosines go to the language that sorts
first; negative cosines score 0; null ids are never held out and may train; rows
that repeat an id are predicted each by its own text; texts of any length count
whole; an empty table gives an empty result; other columns are passed through,
and none of their names matters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import pieces, text_runs, tidied

DIMS = 1024
SEED = 20240229
PER_LANGUAGE = 4000
MOST_LANGUAGES = 20_000
UNKNOWN = "und"
#: Cells of the table that finds a trigram's place; wider alphabets are sorted instead.
_TABLE = 1 << 22
#: A text of ``SHOWN`` trigrams shows its language; what then lies within ``CHANCE`` deviations of a random text's cosine shows none.
SHOWN, CHANCE = 48, 2.0

_letters: dict[tuple[int, int], np.ndarray] = {}


def letter(code: int, dims: int) -> np.ndarray:
    """The random vector of a code point; 0 stands for the boundary."""
    if (v := _letters.get((code, dims))) is None:
        if len(_letters) > 20_000:
            _letters.clear()
        v = _letters[code, dims] = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dims, np.int8) * 2 - 1
    return v


def bundle(texts: list[str | None], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """One row per text, the sum of its trigrams' vectors, and the number of those trigrams."""
    low = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(x) for x in low])
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    alphabet = [0] + [int(c) for c in np.flatnonzero(seen) if chr(c).isalpha()]
    place = np.zeros(len(seen), np.int64)
    place[alphabet[1:]] = np.arange(1, len(alphabet))
    x = place[codes]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    x, owner = x[keep], owner[keep]
    middle = np.flatnonzero(x[1:-1]) + 1  # a trigram belongs to the text of its middle letter
    n = len(alphabet)
    grams = (x[middle - 1] * n + x[middle]) * n + x[middle + 1]
    owner = owner[middle]
    if n**3 <= _TABLE:
        at = np.zeros(n**3, np.int32)
        at[grams] = 1
        kinds = np.flatnonzero(at)
        at[kinds] = np.arange(len(kinds), dtype=np.int32)
        inverse = at[grams]
    else:
        kinds, inverse = np.unique(grams, return_inverse=True)
    out = np.zeros((len(texts), dims), np.float32)
    base = np.stack([letter(c, dims) for c in alphabet])
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    for a in range(0, len(kinds), 4096):  # so that the vectors of a batch stay small
        part = kinds[a : a + 4096]
        some = (inverse >= a) & (inverse < a + 4096) if len(kinds) > 4096 else slice(None)
        counts = np.bincount(owner[some] * len(part) + inverse[some] - a, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        vectors = twice[part // (n * n)] * once[part // n % n] * base[part % n]
        out += counts.astype(np.float32) @ vectors.astype(np.float32)
    return out, np.bincount(owner, minlength=len(texts))


@dataclass
class Profiles:
    """Languages in order, and their prototypes of length 1."""

    languages: list[str]
    vectors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and numbers of trigrams."""
        sums, n = bundle(texts, self.vectors.shape[1] if self.languages else 8)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), n
        length = np.linalg.norm(sums, axis=1)
        cosine = (sums @ self.vectors.T) / np.where(length > 0, length, 1)[:, None]
        best = cosine.argmax(axis=1)
        score = np.where(n > 0, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score, n


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = DIMS, per_language: int = PER_LANGUAGE) -> Profiles:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(train)
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Profiles([], np.zeros((0, dims)))
    # MOST_LANGUAGES rows at most, whatever the input.
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in counts], "lang string, share double"))
    rows = rows.join(share, "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch, texts in pieces(batches, 1, 64):
            vectors, _ = bundle(texts, dims)
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.mapInArrow(tidied(sums), "lang string, v array<double>").select("lang", F.posexplode("v"))
    # Whole numbers below 2**53: their sum does not depend on the order.
    found = parts.groupBy("lang", "pos").agg(F.sum("col").alias("s")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("v")).collect()
    protos = {r["lang"]: np.array([x["s"] for x in r["v"]]) for r in found}
    names = sorted(x for x, v in protos.items() if np.any(v))
    return Profiles(names, np.array([protos[x] / np.linalg.norm(protos[x]) for x in names]).reshape(len(names), dims))


def verdict(docs: DataFrame, model: Profiles, text: Column) -> Column:
    """``struct<lang_pred, score, grams>`` of a text: only it goes to the worker."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES vectors at most

    def judge(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores, grams = [], [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, texts in text_runs(batch, 64):
                found, s, n = sent.value.predict(texts)
                langs += found
                scores.append(s)
                grams.append(n)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(grams))], names=["lang_pred", "score", "grams"])

    @F.arrow_udf("struct<lang_pred: string, score: double, grams: long>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(judge)(batches)

    return judged(text)


def accepted(found: Column, dims: int = DIMS) -> Column:
    """Of ``verdict``'s structs: the text has letters, and is too short to tell or more like a learned language than chance would make it."""
    return (found["lang_pred"] != UNKNOWN) & ((found["grams"] < SHOWN) | (found["score"] >= CHANCE / dims**0.5))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a language that its labelled rows show, with all their columns. Where no label shows any, all rows with a letter stay."""
    model = fit(docs, ~held_out("id"), id_col, text_col)
    if not model.languages:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    return docs.filter(accepted(verdict(docs, model, F.col(text_col))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; learned from rows that are not held out."""
    model = fit(docs, ~held_out("id"))
    rows = docs.select("doc_id", held_out().alias("held_out"), verdict(docs, model, F.col("text")).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
