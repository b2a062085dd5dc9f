"""An index of three-letter parts with their places: substrings and phrases without reading texts.

A text holds a string where parts of three letters that cover it lie at the string's offsets, so
merging their places, less the offsets, finds every occurrence exactly. Of a string the parts at
every third offset, and the last, are enough. Parts are dealt by a hash into folders, and sorted, so a search
reads the folders and row groups of its own parts. Texts are read only of documents that are told.

Texts are laid out one behind the other in blocks of ``BLOCK`` letters, with a letter's room between them, so that
no string is found across two. A row holds all places of a part in a block, each as the step from the one before it: a small number
a letter, and nothing a document, is what is moved and kept. A row of its own tells where a block's texts begin.

The searches are those of ``fulltext`` with the same results: whole words or substrings of three letters
or more, and phrases. Where an index can't tell (words of fewer letters, the raw query where nothing
else is found), they scan as ``fulltext`` does.

Defined results: null texts and texts of fewer than three letters have no parts; ids are integers, null
ones are not indexed; rows that repeat an id are one document, whose rows are all told.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import fulltext
from memloom.shared import cut, drop

HEADS, SIZE = 64, 3
#: Letters of a block, but for a longer text, which is a block of its own.
BLOCK = 1 << 20
#: The folder of the rows that tell where texts begin.
TEXTS = -1
#: Documents that may be named in a filter, which the scan takes; more are joined.
MOST_NAMED = 1_000
#: Documents that may be sent to all tasks, which the texts then need not move for.
MOST_SENT = 1_000_000
#: Parts of texts for each core, so that none waits for the last.
PARTS = 3
_ROWS = "gram string, block long, places array<int>, docs array<long>"
_FOUND = "word string, doc_id long, start int"


def _head(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(HEADS)).cast("int")


def _strings(parts: np.ndarray) -> pa.Array:
    """Rows of letters as strings."""
    size = (1 + (parts >= 0x80) + (parts >= 0x800) + (parts >= 0x10000)).sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(offsets), pa.py_buffer(parts.astype("<u4").tobytes().decode("utf-32-le").encode()))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _ordered(key: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The places ``at``, in order, by their keys below ``most``, and by themselves."""
    bits = len(key).bit_length()
    if most << bits >= 1 << 63:
        return at[np.argsort(key[at], kind="stable")]
    # Both in one number: numbers are sorted several times as fast as places by them.
    return np.sort(key[at] << bits | at) & ((1 << bits) - 1)


def _block(ids: np.ndarray, texts: pa.Array, block: int) -> pa.RecordBatch:
    """``_ROWS`` of a block: one row a part, and one with no part for where its texts begin."""
    letters = np.frombuffer("\0".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = pc.utf8_length(texts).to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    # Letters by their rank among those of the block, so that a part is a small number.
    used = np.flatnonzero(np.bincount(letters, minlength=1))
    rank = np.zeros(used[-1] + 1, np.int64)
    rank[used] = np.arange(len(used))
    no = rank[letters]
    key = (no[:-2] * len(used) + no[1:-1]) * len(used) + no[2:]
    whole = np.ones(len(letters) - SIZE + 1, bool)
    for i in range(1, SIZE + 1):  # parts that would reach over a text's end
        at = starts[1:] - i
        whole[at[at < len(whole)]] = False
    at = _ordered(key, np.flatnonzero(whole), len(used) ** SIZE)
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[at]) != 0]))
    some = at[first]
    gram = pa.concat_arrays([_strings(letters[some[:, None] + np.arange(SIZE)]), pa.nulls(1, pa.string())])
    at, first = np.concatenate([at, starts]), np.append(first, len(at))
    places = np.diff(at, prepend=0)
    places[first] = at[first]
    places = _lists(places.astype(np.int32), np.diff(np.append(first, len(at))))
    docs = pa.concat_arrays([pa.nulls(len(some), pa.list_(pa.int64())), _lists(ids, [len(ids)])])
    return pa.record_batch([gram, pa.array(np.full(len(some) + 1, block)), places, docs], names=["gram", "block", "places", "docs"])


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``_ROWS`` of blocks of consecutive rows ``doc_id, text``, but for those that have no part."""
    number = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        batch = batch.filter(pc.greater_equal(pc.utf8_length(batch.column(1)), SIZE))
        ids, texts = batch.column(0).to_numpy(), batch.column(1)
        ends = np.cumsum(pc.utf8_length(texts).to_numpy() + 1)
        a = 0
        while a < len(ids):
            before = ends[a - 1] if a else 0
            b = int(np.searchsorted(ends, before + most - size, side="right"))
            if b == a and not held:
                b = a + 1
            if b > a:
                held.append((ids[a:b], texts.slice(a, b - a)))
                size += int(ends[b - 1] - before)
            if b < len(ids):
                yield _block(np.concatenate([x for x, _ in held]), pa.concat_arrays([t for _, t in held]), number)
                held, size, number = [], 0, number + 1
            a = b
    if held:
        yield _block(np.concatenate([x for x, _ in held]), pa.concat_arrays([t for _, t in held]), number)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_ROWS`` with places in the place of steps."""
    for batch in batches:
        steps = batch.column(2)
        sizes, total = pc.list_value_length(steps).to_numpy(), np.cumsum(steps.flatten().to_numpy().astype(np.int64))
        ends = np.cumsum(sizes)
        before = np.where(ends > sizes, total[np.maximum(ends - sizes, 1) - 1], 0) if len(total) else ends
        yield pa.record_batch([batch.column(0), batch.column(1), _lists((total - np.repeat(before, sizes)).astype(np.int32), sizes), batch.column(3)], names=batch.schema.names)


def build(docs: DataFrame, path: str, id_col: str, form: Column, block: int = BLOCK) -> None:
    """Write the index of ``form``, an expression of a row's text as it is searched, in place of what was there."""
    docs, scanned = docs.filter(F.col(id_col).cast("long").isNotNull()), docs.rdd.getNumPartitions()
    if scanned > 1:  # else a small table
        # Parts of a scan may hold most rows in one. Dealt evenly before they get their form, texts keep all cores busy.
        docs = docs.repartition(max(PARTS * docs.sparkSession.sparkContext.defaultParallelism, scanned))
    # Short texts are left out later: a filter would work out the form again.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), form.alias("text"))
    # In order, so that a task that is run again makes the same blocks.
    parts = rows.sortWithinPartitions("doc_id", "text").mapInArrow(partial(_blocks, most=block), _ROWS)
    parts = parts.withColumn("head", F.when(F.col("gram").isNull(), TEXTS).otherwise(_head(F.col("gram"))))
    parts.repartition("head", F.pmod(F.xxhash64("gram", "block"), F.lit(4))).sortWithinPartitions("head", "gram", "block").write.mode("overwrite").partitionBy("head").parquet(f"{path}/grams")


def cover(word: str) -> list[tuple[int, str]]:
    """Offsets and parts that cover a string of three letters or more."""
    at = sorted({*range(0, len(word) - SIZE + 1, SIZE), len(word) - SIZE})
    return [(i, word[i : i + SIZE]) for i in at]


def hits(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """``word, doc_id, start``: every place where a text holds one of the ``words``, of three letters or more."""
    asked = [(w, i, g) for w in dict.fromkeys(words) for i, g in cover(w)]
    index = spark.read.schema(f"{_ROWS}, head int").parquet(f"{path}/grams")
    if not asked:
        return spark.createDataFrame([], _FOUND)
    need = {w: sum(w == x for x, _, _ in asked) for w, _, _ in asked}
    # The words of a question, which need no job.
    of = spark.createDataFrame(pa.table({"word": [w for w, _, _ in asked], "offset": pa.array([i for _, i, _ in asked], pa.int32()), "gram": [g for _, _, g in asked], "need": pa.array([need[w] for w, _, _ in asked], pa.int32())}))
    wanted = sorted({g for _, _, g in asked})
    heads = sorted({r["head"] for r in spark.createDataFrame(pa.table({"gram": wanted})).select(_head(F.col("gram")).alias("head")).collect()})
    found = index.filter(F.col("head").isin(heads) & F.col("gram").isin(wanted)).drop("head").mapInArrow(_counted, _ROWS).join(F.broadcast(of), "gram")
    starts = found.select("word", "need", "block", F.transform("places", lambda p: p - F.col("offset")).alias("starts"))
    # A block's part is one row, so a start is the string's where all of its parts have it.
    whole = starts.groupBy("word", "need", "block").agg(F.collect_list("starts").alias("lists")).filter(F.size("lists") == F.col("need"))
    rest = F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0)))
    whole = whole.select("word", "block", F.aggregate(rest, F.element_at("lists", 1), F.array_intersect).alias("starts")).filter(F.size("starts") > 0)
    # A block has one row of its texts, so what is found in it meets that row, and no text's row is taken apart.
    texts = index.filter(F.col("head") == TEXTS).select("block", "places", "docs")
    return whole.join(texts, "block").select("word", "starts", "places", "docs").mapInArrow(_told, _FOUND)


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_FOUND`` of rows with a word's starts in a block, and the steps and ids of the block's texts."""
    for batch in batches:
        for word, starts, steps, docs in zip(*batch.columns, strict=True):
            starts, begins = starts.values.to_numpy(), np.cumsum(steps.values.to_numpy().astype(np.int64))
            # The text that a place lies in is the last that begins at or before it.
            at = np.searchsorted(begins, starts, side="right") - 1
            words = pa.array(np.zeros(len(starts), np.int32))
            words = pa.DictionaryArray.from_arrays(words, pa.array([word.as_py()])).cast(pa.string())
            yield pa.record_batch([words, docs.values.take(pa.array(at)), pa.array((starts - begins[at]).astype(np.int32))], names=["word", "doc_id", "start"])


def _of(rows: DataFrame, id_col: str, found: DataFrame) -> DataFrame | None:
    """The rows of the documents found; None if there are none. Few are named in a filter that the scan takes, and up to ``MOST_SENT`` sent to it."""
    found = cut(found, "found")  # looked at, counted and joined, but searched once
    ids = [r["doc_id"] for r in found.limit(MOST_NAMED + 1).collect()]
    if len(ids) <= MOST_NAMED:
        drop(found)
        return rows.filter(F.col(id_col).isin(ids)) if ids else None
    sent = F.broadcast(found) if found.count() <= MOST_SENT else found
    return rows.join(sent.withColumnRenamed("doc_id", id_col), id_col, "left_semi")


def _spoken(spark: SparkSession, expression: Column) -> str:
    return spark.range(1).select(expression).first()[0]


def tiered_search(notes: DataFrame, path: str, query: str, columns: tuple[str, ...], normal, order: list[Column], k: int = 50, id_col: str = "id") -> DataFrame:
    """``fulltext.tiered_search`` by an index of ``tiered_form`` of the same columns."""
    spark = notes.sparkSession
    words = list(dict.fromkeys(w for w in _spoken(spark, F.lower(normal(F.lit(query)))).split(" ") if w))
    if all(len(w) >= SIZE for w in words):
        rows = _of(notes, id_col, hits(spark, path, words).select("doc_id").distinct())
        if rows is not None:
            return fulltext.tiered_search(rows, query, columns, normal, order, k)
    return fulltext.tiered_search(notes, query, columns, normal, order, k)


def tiered_form(columns: tuple[str, ...], normal) -> Column:
    """What ``fulltext.tiered_search`` looks for words in."""
    return F.lower(F.concat_ws(" ", *(normal(F.col(c)) for c in columns)))


def phrase_search(messages: DataFrame, path: str, query: str, text_col: str, normal, order: list[Column], k: int = 5, id_col: str = "id") -> DataFrame:
    """``fulltext.phrase_search`` by an index of ``normal(text_col)``: documents with the phrase, else those that have all of its words."""
    spark = messages.sparkSession
    phrase = _spoken(spark, normal(F.lit(query)))
    words = _spoken(spark, F.split(normal(F.lit(query)), r"(?U)\s+"))
    if len(phrase) >= SIZE:
        rows = _of(messages, id_col, hits(spark, path, [phrase]).select("doc_id").distinct())
        if rows is None and len(words) > 1 and all(len(w) >= SIZE for w in words):
            each = hits(spark, path, words).select("word", "doc_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
            rows = _of(messages, id_col, each.filter(F.col("n") == len(set(words))).select("doc_id"))
            if rows is None:
                return fulltext.phrase_search(messages.limit(0), query, text_col, normal, order, k)
        if rows is not None:
            return fulltext.phrase_search(rows, query, text_col, normal, order, k)
    return fulltext.phrase_search(messages, query, text_col, normal, order, k)
