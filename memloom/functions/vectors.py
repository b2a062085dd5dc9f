"""Vector functions. Sums run in double, in the order of the components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


@F.pandas_udf(T.BinaryType())
def pack_half(v: pd.Series) -> pd.Series:
    """Half-precision little-endian bytes, for stores that keep vectors so."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_half(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.frombuffer(x, "<f2").astype("f4").tolist())


def from_json(c: Column) -> Column:
    """A vector written as JSON text; null when it can't be read."""
    return F.from_json(c, "array<float>")
