"""Quality of documents: histogram gradient-boosted trees over statistics of the whole text.

The trees are fitted on at most ``FIT_ROWS`` labelled rows (the bound is that
parameter; the rows are those with the smallest hashes of their ids), whose
statistics are computed on the executors. All documents are then scored by numpy
over the flattened trees, a batch at a time. Neither labels nor language, source
or id are inputs of a score.

Defined results: null and empty texts have statistics of 0 and get a score like
any other; labels that are null or not 0 or 1 are left out; with no usable label
every score is 0.5, and with one class only it is near that class; null ids are
never held out; ids may repeat, each row is scored by its own text, and of a labelled
id's texts the least one is learned from, with each of its labels; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm import trees
from memloom.llm.batches import pieces, tidied

FIT_ROWS = 20_000
THRESHOLD = 0.3
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|@~^<>{}[]\\/=+_")] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True


def statistics(text: str | None) -> list[float]:
    """Shares of kinds of bytes, words and lines; the whole text counts."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * 24
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    letters = max(1, int(hist[_UPPER].sum() + hist[_LOWER].sum() + hist[_HIGH].sum()))
    kinds = Counter(words)
    ranked = kinds.most_common(3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = hist[hist > 0] / size
    lengths = list(map(len, words))
    alike = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(lines)), size / n, max(lengths), float(np.std(lengths)),
        len(kinds) / n, ranked[0][1] / n, sum(c for _, c in ranked) / n, alike / n,
        len(set(lines)) / len(lines), n / len(lines),
        hist[_UPPER].sum() / letters, hist[_DIGIT].sum() / size, hist[_STOPS].sum() / n, hist[33] / n, hist[46] / n, hist[44] / n,
        hist[_MARKS].sum() / n, hist[124] / n, hist[_HIGH].sum() / size, float(-(share * np.log2(share)).sum()),
        sum(x.isalpha() or x[:-1].isalpha() for x in kinds) / len(kinds), sum(x.isupper() for x in kinds) / len(kinds), sum(x[-1] in b"#$%&*|!" for x in kinds) / len(kinds),
    ]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """``r, text, y`` of at most ``rows`` labelled rows that are not held out, numbered from 1; of an id's texts the least one."""
    good = labels.filter(~held_out() & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    # ``rows`` rows at most, in one task and in the broadcast: a bound that does not follow the input.
    some = good.orderBy(*by_hash).limit(rows).withColumn("r", F.row_number().over(Window.orderBy(*by_hash)))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return found.groupBy("r").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, **how) -> trees.Forest:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 1):
            yield pa.record_batch([batch.column(0), pa.array([statistics(t) for t in texts], pa.list_(pa.float64())), batch.column(2)], names=["r", "x", "y"])

    got = labelled(docs, labels, label, rows).mapInArrow(tidied(run), "r int, x array<double>, y double").toArrow().sort_by("r")
    if not got.num_rows:
        return trees.constant(0.5)
    return trees.fit(np.array(got.column("x").to_pylist()), got.column("y").to_numpy(), **how)


def score(docs: DataFrame, model: trees.Forest) -> DataFrame:
    """``doc_id, held_out, score`` of every row."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as many nodes as the parameters of fit() allow

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 2):
            p = sent.value.score(np.array([statistics(t) for t in texts]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"])

    return rows.mapInArrow(tidied(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
