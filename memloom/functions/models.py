"""Models as functions that can be exchanged, with deterministic defaults that need no download."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]
Judge = Callable[[list[str]], list[str | None]]


def hashed_embedder(dims: int = 256, sizes: tuple[int, ...] = (3, 4)) -> Embedder:
    """Signed counts of hashed letter n-grams, of length 1: texts with common parts get close vectors."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                marked = f" {word} "
                for n in sizes:
                    for i in range(max(1, len(marked) - n + 1)):
                        h = zlib.crc32(marked[i : i + n].encode())
                        row[h % dims] += 1 if h & 0x8000_0000 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    return embed


def embed(df: DataFrame, text: Column, out: str = "embedding", make: Callable[[], Embedder] = hashed_embedder, prefix: str = "") -> DataFrame:
    """``df`` with the vectors of ``text``. ``make`` builds the model once a worker; queries may carry an instruction prefix."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model([prefix + (t or "") for t in texts])), index=texts.index)

    return df.withColumn(out, vectors(text))


def judge(df: DataFrame, prompt: Column, out: str, model: Callable[[], Judge]) -> DataFrame:
    """``df`` with a language model's answers; None stands for a failed call."""

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = model()
        for prompts in batches:
            yield pd.Series(ask(prompts.tolist()), index=prompts.index)

    return df.withColumn(out, answers(prompt))


def _outer_braces(text: str) -> str | None:
    depth, start, quoted, skip = 0, -1, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def repaired_json(text: str | None) -> str | None:
    """The first JSON object in a model's answer, in one canonical form: fences, talk around it, typographic or single quotes and trailing commas are repaired."""
    if not text:
        return None
    text = re.sub(r"```(?:json)?", "", text).strip()
    for candidate in (text, _outer_braces(text), _outer_braces(text.translate(str.maketrans("“”‘’", "\"\"''")))):
        if candidate is None:
            continue
        for fixed in (candidate, re.sub(r",\s*([}\]])", r"\1", candidate), re.sub(r",\s*([}\]])", r"\1", candidate.replace("'", '"'))):
            try:
                return json.dumps(json.loads(fixed), ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
    return None


@F.arrow_udf(T.StringType())
def repair_json(answers: pa.Array) -> pa.Array:
    return pa.array([repaired_json(t) for t in answers.to_pylist()], pa.string())


def parse_json(c: Column, schema: str) -> Column:
    """Parsed as it is where possible; only answers that are not JSON go through the repair."""
    plain = F.try_parse_json(c).isNotNull()
    return F.from_json(F.when(plain, c).otherwise(repair_json(c)), schema)
