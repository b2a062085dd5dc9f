"""The splitter as Column expressions: slower than the one by offsets, and made without it.

A text is an array of segments. One pass per separator, strongest first, opens the
segments that are still too long, and the last pass cuts by length. Segments are
then packed in order by an aggregate over the array, which also puts the end of the
chunk before in front of each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.split import OVERLAP, SEPARATORS, SIZE


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _segment(text: Column, sign: str, size: int) -> Column:
    """A part with its separator, unless it is long and has to be opened: its separator is then lost."""
    long = F.length(text) > size
    return F.struct(F.when(long, text).otherwise(F.concat(text, F.lit(sign))).alias("t"), long.alias("long"), (text != "").alias("some"))


def _opened(segments: Column, sign: str, size: int) -> Column:
    """The segments with the long ones divided at a separator. What lies between two separators in a row is no segment."""

    def parts(s: Column) -> Column:
        every = F.split(s["t"], re.escape(sign), -1)
        inner = F.transform(F.slice(every, F.lit(1), F.size(every) - 1), lambda p: _segment(p, sign, size))
        return F.filter(F.concat(inner, F.array(_segment(F.element_at(every, -1), "", size))), lambda x: x["some"])

    return F.flatten(F.transform(segments, lambda s: F.when(s["long"], parts(s)).otherwise(F.array(s))))


def _cut(segments: Column, size: int) -> Column:
    """The segments' texts, with what is still long cut by length."""
    pieces = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")), lambda i: F.substring(t, i * size + 1, F.lit(size)))
    return F.flatten(F.transform(segments, lambda s: F.when(s["long"], pieces(s["t"])).otherwise(F.array(s["t"]))))


def split_column(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """``array<string>``: chunks of packed segments; each but the first begins with the end of the one before. Blank texts have none."""
    text = F.coalesce(text, F.lit(""))
    segments = F.array(F.struct(text.alias("t"), F.lit(True).alias("long"), F.lit(True).alias("some")))
    for sign in SEPARATORS:
        segments = _opened(segments, sign, size)

    def closed(state: Column, held: Column) -> Column:
        """The state after its held segments became a chunk, if they say anything; ``held`` comes next."""
        chunk = _strip(state["held"])
        lead = F.when(F.lit(overlap > 0) & (F.size(state["done"]) > 0), F.concat(F.right(state["last"], F.lit(overlap)), F.lit(" "))).otherwise("")
        there = chunk != ""
        return F.struct(
            F.when(there, F.concat(state["done"], F.array(F.concat(lead, chunk)))).otherwise(state["done"]).alias("done"), held.alias("held"), F.when(there, chunk).otherwise(state["last"]).alias("last")
        )

    none = F.lit("")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("held"), none.alias("last"))
    step = lambda state, s: F.when(F.length(state["held"]) + F.length(s) > size, closed(state, s)).otherwise(F.struct(state["done"].alias("done"), F.concat(state["held"], s).alias("held"), state["last"].alias("last")))
    packed = F.aggregate(_cut(segments, size), start, step, lambda state: closed(state, none)["done"])
    whole = F.filter(F.array(_strip(text)), lambda t: t != "")
    return F.when((F.length(text) <= size) | (_strip(text) == ""), whole).otherwise(packed)
