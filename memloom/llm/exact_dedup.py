"""Exact deduplication of texts, safe against groups of any size. DataFrame functions only.

Texts are equal when they are identical after every run of ASCII white space
becomes one space. The work runs in three combining steps, each of which
compares the whole normalised text and not just its digest:

1. within an input partition (the map side of the first aggregate),
2. within a salted digest group, so that one group's rows go to many tasks,
3. over the salt winners of a digest.

The groups then go back to the documents by digest. Groups that hold more than
1/256 of all rows (there are at most 256 of them, whatever the input) are
broadcast, so no join task receives a whole large group.

Defined results: null texts count as empty and are equal to each other; where the
smallest id repeats in a group, its rows are one document: all are marked as kept,
and ``keep_first`` keeps one of them; null ids lose against any id and stay only in
groups that have no other; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.shared import cut

HOT_SHARE = 256


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def text_groups(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """One row per digest: ``_dg``, ``_keep``, ``_n`` and ``_variants``, the number of different texts below it."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_t"))
    rows = rows.select("_id", "_t", digest(F.col("_t")).alias("_dg"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    salted = rows.groupBy("_dg", "_t", "_salt").agg(F.min("_id").alias("_lo"), F.count(F.lit(1)).alias("_c"))
    # Dealt by digest alone, so the groups of a digest are counted without moving the texts again.
    texts = salted.select("_dg", "_t", "_lo", "_c").repartition("_dg").groupBy("_dg", "_t").agg(F.min("_lo").alias("_lo"), F.sum("_c").alias("_c"))
    return texts.groupBy("_dg").agg(F.min("_lo").alias("_keep"), F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_variants"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = 16, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) in the struct ``_row``, with ``_id``, ``_keep``, ``_n`` and ``_dg`` of each row's group."""
    groups = cut(text_groups(docs, id_col, text_col, digest, salts), "dedup-groups")
    total, clashes = groups.agg(F.sum("_n"), F.count_if(F.col("_variants") > 1)).first()
    keys = ["_dg"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in (columns or docs.columns))).alias("_row"), F.col(id_col).alias("_id"), digest(normalised(F.col(text_col))).alias("_dg"))
    if clashes:
        # Digests that stand for several texts: those groups are told apart by the text itself.
        keys = ["_dg", "_t"]
        bad = groups.filter("_variants > 1").select("_dg")
        again = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_t")).withColumn("_dg", digest(F.col("_t")))
        exact = again.join(bad, "_dg", "left_semi").groupBy("_dg", "_t").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        plain = groups.filter("_variants = 1").select("_dg", F.lit(None).cast("string").alias("_t"), "_keep", "_n")
        groups = cut(plain.unionByName(exact.select("_dg", "_t", "_keep", "_n")), "dedup-exact")
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in (columns or docs.columns))).alias("_row"), F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text")).withColumn("_dg", digest(F.col("_text")))
        rows = rows.join(bad.withColumn("_bad", F.lit(True)), "_dg", "left").withColumn("_t", F.when(F.col("_bad"), F.col("_text"))).drop("_bad")
    floor = max(2, (total or 0) // HOT_SHARE)
    hot = groups.filter(F.col("_n") > floor)
    cold = groups.filter(F.col("_n") <= floor)
    same = lambda other, tag: [F.col(f"_r.{k}").eqNullSafe(F.col(f"{tag}.{k}")) if k == "_t" else F.col(f"_r.{k}") == F.col(f"{tag}.{k}") for k in keys]
    hot = hot.select(*keys, F.col("_keep").alias("_hk"), F.col("_n").alias("_hn"))
    rows = rows.alias("_r").join(F.broadcast(hot.alias("_h")), same(hot, "_h"), "left").select("_r.*", "_hk", "_hn")
    # Rows that have their answer are dealt by their id, where nothing matches them.
    rows = rows.withColumn("_key", F.when(F.col("_hn").isNull(), F.col("_dg")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    cold = cold.select(F.col("_dg").alias("_cd"), *(F.col(k).alias("_ct") for k in keys[1:]), F.col("_keep").alias("_ck"), F.col("_n").alias("_cn"))
    on = [F.col("_key") == F.col("_cd")] + [F.col("_t").eqNullSafe(F.col("_ct")) for _ in keys[1:]]
    out = rows.join(cold, on, "left")
    return out.select("_row", "_id", F.coalesce("_hk", "_ck").alias("_keep"), F.coalesce("_hn", "_cn").alias("_n"), *keys)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    out = annotate(docs, id_col, text_col, columns=[id_col])
    return out.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_n").cast("long").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_dg").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    kept = annotate(docs, id_col, text_col).filter(F.col("_id").eqNullSafe(F.col("_keep")))
    # Only ids that repeat can leave a group with several rows, and these are looked for by their ids alone.
    again = cut(docs.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_again"), "dedup-ids")
    if again.isEmpty():
        return kept.select("_row.*")
    kept = cut(kept.select("_row", "_id", "_dg", *(["_t"] if "_t" in kept.columns else [])), "dedup-kept")
    keys = [c for c in kept.columns if c != "_row"]
    same = F.col("_id").eqNullSafe(F.col("_again"))
    once = kept.join(again, same, "left_semi").groupBy(*keys).agg(F.any_value("_row").alias("_row"))
    return kept.join(again, same, "left_anti").select("_row.*").unionByName(once.select("_row.*"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
