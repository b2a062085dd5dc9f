"""Arrow batches in Python workers: small pieces, so memory follows the texts and not the row count."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def text_runs(texts: pa.Array, rows: int = 256, size: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Starts and texts of runs of at most ``rows`` texts, ended early once they have ``size`` characters."""
    start = 0
    while start < len(texts):
        part = texts.slice(start, rows).to_pylist()
        total = 0
        for n, t in enumerate(part, 1):
            total += len(t or "")
            if total >= size:
                break
        yield start, part[:n]
        start += n


def pieces(batches: Iterable[pa.RecordBatch], text_at: int, rows: int = 256, size: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches as ``text_runs`` cuts them, with their texts."""
    for batch in batches:
        for start, texts in text_runs(batch.column(text_at), rows, size):
            yield batch.slice(start, len(texts)), texts


def tidied(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run``, after which what its task held is given back: the inner frame is gone by then, with all that it named."""

    def whole(batches: Iterable) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what one task has touched would count for the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
