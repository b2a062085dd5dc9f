"""Splitting of long texts into overlapping chunks that respect sentences.

A text is never taken apart: separators, strongest first, cut it at offsets, one
pass over the stretches that are still too long for each of them. Stretches are then
packed by binary search in their running length, and chunks are slices of the text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 512, 96
# Separators, strongest first; after the last a text is cut by length.
SEPARATORS = ["\n\n", "\n", "۔", "؟", "!", ". ", "? ", "! ", "،", ", ", "؛", "; ", ":", " "]


def stretches(text: str, size: int) -> list[tuple[int, int]]:
    """Offsets, in order, of what separators leave of the text: up to ``size`` characters and the separator behind them.

    A stretch that a weaker separator had to divide, and the last one, have none behind them.
    """
    done, wide = [], [(0, len(text))]
    for sign in SEPARATORS:
        wider = []
        for a, b in wide:
            while a < b:
                end = text.find(sign, a, b)
                cut, after = (b, b) if end < 0 else (end, end + len(sign))
                if cut - a > size:
                    wider.append((a, cut))
                elif cut > a:
                    done.append((a, after))
                a = after
        wide = wider
    done += [(i, min(i + size, b)) for a, b in wide for i in range(a, b, size)]
    return sorted(done)


def split(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of ``size`` characters at most, blank ones left out; each but the first begins with ``overlap`` characters of the one before."""
    text = text or ""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    parts = stretches(text, size)
    ends = list(accumulate((b - a for a, b in parts), initial=0))
    chunks, i = [], 0
    while i < len(parts):
        j = max(i + 1, bisect_right(ends, ends[i] + size) - 1)
        chunks.append("".join([text[a:b] for a, b in parts[i:j]]).strip())
        i = j
    chunks = [c for c in chunks if c]
    lead = [""] + [f"{c[-overlap:]} " if overlap > 0 else "" for c in chunks]
    return [x + c for x, c in zip(lead, chunks)]


def split_column(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """``array<string>`` of chunks, in Arrow batches."""

    @F.arrow_udf("array<string>")
    def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([split(t, size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return chunks(text)


def split_documents(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk_no, chunk`` of every document with text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split_column(F.col(text_col), size, overlap)).alias("chunk_no", "chunk"))
