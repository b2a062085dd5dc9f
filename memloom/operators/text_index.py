"""A full-text index that is kept up to date part by part.

Documents with integer ids lie in parts of ``span`` ids. An update writes the parts that it
touches anew, by dynamic partition overwrite, and leaves the files of all others alone: so what
has come, changed or gone costs its parts and not the index. ``fulltext.search_index`` reads it.

Within a part postings are sorted by the hash of a token's beginning and the token, so that
files and row groups of other tokens are skipped by their bounds. Updates are idempotent: one
that was cut off is repaired by repeating it.

Defined results: rows that repeat an id are one document, with the tokens of all; null ids are
not indexed; null, empty and wordless texts are documents without tokens; a document that comes
again is replaced; an id that both comes and goes in one update comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.fulltext import HEADS, head, tokens
from memloom.shared import cut, drop, names, remove, there_or_empty

SPAN = 100_000
#: Postings of a file, about; a part with more has several, by heads.
FILE_ROWS = 2_000_000
POSTINGS = "doc_id long, token string, tf long, n_tokens int, head int, part long"
DOCUMENTS = "doc_id long, n_tokens int, part long"


def part_of(doc_id: Column, span: int) -> Column:
    return F.floor(doc_id / F.lit(span)).cast("long")


def stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One of the two tables of an index; without rows before the first update."""
    return there_or_empty(spark, f"{path}/{name}", schema)


def postings(docs: DataFrame, id_col: str, text_cols: list[str], span: int) -> DataFrame:
    """``POSTINGS`` of documents, with one row of a null token for each document without tokens."""
    words = F.concat(*(tokens(F.col(c)) for c in text_cols))
    # Dealt by document once: counting tokens needs no other exchange, and a document's length no sort of its postings.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("t")).filter("doc_id IS NOT NULL").repartition("doc_id")
    whole = rows.groupBy("doc_id").agg(F.flatten(F.collect_list("t")).alias("t")).withColumn("n_tokens", F.size("t"))  # a document's rows
    counted = whole.select("doc_id", "n_tokens", F.explode_outer("t").alias("token")).groupBy("doc_id", "n_tokens", "token").agg(F.count("token").alias("tf"))
    return counted.select("doc_id", "token", "tf", "n_tokens", head(F.col("token")).alias("head"), part_of(F.col("doc_id"), span).alias("part"))


def update(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "id", text_cols: list[str] | None = None, gone: DataFrame | None = None, span: int = SPAN) -> dict[str, int]:
    """Put ``docs`` into the index at ``path`` and take the ids of ``gone`` (``doc_id``) out. Returns what was written: documents, postings, parts."""
    new = cut(postings(docs, id_col, text_cols or ["text"], span), "index-new")
    ids = cut(new.select("doc_id", "n_tokens", "part").distinct(), "index-ids")
    out = ids.select("doc_id", "part")
    if gone is not None:
        out = cut(out.unionByName(gone.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").select("doc_id", part_of(F.col("doc_id"), span).alias("part"))).distinct(), "index-out")
    parts = sorted(r["part"] for r in out.select("part").distinct().collect())  # as many as parts
    told, made = {"documents": 0, "postings": 0, "parts": len(parts)}, [new, ids, out]
    for name, schema, rows, by, order in (
        ("postings", POSTINGS, new.filter("token IS NOT NULL"), ["head"], ["part", "head", "token", "doc_id"]),
        ("documents", DOCUMENTS, ids, [], ["part", "doc_id"]),
    ):
        there = {int(n.partition("=")[2]) for n in names(spark, f"{path}/{name}") if n.startswith("part=")} & set(parts)
        if there:
            # What stays of the parts is written aside first: a part can't be read and overwritten at once. What is new lies aside already.
            held = cut(stored(spark, path, name, schema).filter(F.col("part").isin(sorted(there))).join(out.select("doc_id"), "doc_id", "left_anti"), f"index-{name}")
            rows = rows.unionByName(held)
            made.append(held)
        sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # as many as parts
        if sizes:
            # As many files a part as its rows need: parts are many, and a file for each head of each would be far more.
            files = min(HEADS, -(-max(sizes.values()) // FILE_ROWS))
            dealt = rows.repartition("part", *(F.pmod(c, F.lit(files)) for c in by))
            dealt.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")
        for part in there - set(sizes):  # nothing of it is left
            remove(spark, f"{path}/{name}/part={part}")
        told[name] = sum(sizes.values())
    drop(*made)
    return told
