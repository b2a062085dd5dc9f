"""The index of three-letter parts against plain search and against the scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import fulltext, grams

ROWS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "concatenate all", "Catalog of cats", "a tomcat\nsat", "ab", "", None, "😀cat😀 é çat", "mat the cat sat", "aaaaaaa", "nothing here at all", "the the the"])]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    df = spark.createDataFrame([*ROWS, (None, "no id cat"), (0, "the dog")], "id long, content string").cache()
    grams.build(df, path, "id", F.lower("content"))
    return df, path


def test_places_are_those_of_the_strings(spark, indexed):
    _, path = indexed
    rng = random.Random(2)
    texts = [*ROWS, (0, "the dog")]
    whole = [t.lower() for _, t in texts if t and len(t) > 2]
    words = ["cat", "cat sat", "the cat sat on the mat", "aaaa", "😀cat😀", "zzz", "tomcat\nsat", "e the"] + [t[a : a + rng.randrange(3, 9)] for t in whole for a in range(0, len(t) - 2, 3)]
    words = [w for w in words if len(w) >= 3]
    expected = {(w, i, a) for w in words for i, t in texts if t for a in range(len(t)) if t.lower().startswith(w, a)}
    assert {tuple(r) for r in grams.hits(spark, path, words).collect()} == expected
    assert grams.hits(spark, path, []).count() == 0


def test_covering_parts():
    for n in range(3, 20):
        word = "abcdefghijklmnopqrst"[:n]
        assert {i + j for i, g in grams.cover(word) for j in range(3)} == set(range(n)) and all(word[i : i + 3] == g for i, g in grams.cover(word))


@pytest.mark.parametrize("query", ["cat", "cat dog", "catalog cats", "at", "zzz", "zzz at all", "çat", "Nothing HERE", ""])
def test_tiers_are_those_of_the_scan(indexed, tmp_path, query):
    df, _ = indexed
    path = str(tmp_path / "tiers")
    grams.build(df, path, "id", grams.tiered_form(("content",), text.norm_query))
    how = (("content",), text.norm_query, [F.col("id"), F.col("content")])
    by_index = grams.tiered_search(df.filter("id IS NOT NULL"), path, query, *how).select("id", "content", "tier").collect()
    assert by_index == fulltext.tiered_search(df.filter("id IS NOT NULL"), query, *how).select("id", "content", "tier").collect()


@pytest.mark.parametrize("query", ["the cat sat", "sat cat", "cat  mat", "the zzz", "of", "tomcat sat"])
def test_phrases_are_those_of_the_scan(indexed, tmp_path, query):
    df, _ = indexed
    path = str(tmp_path / "phrases")
    grams.build(df, path, "id", text.norm_fts(F.col("content")))
    how = ("content", text.norm_fts, [F.desc("id"), F.col("content")])
    by_index = grams.phrase_search(df.filter("id IS NOT NULL"), path, query, *how).select("id", "content", "tier").collect()
    assert by_index == fulltext.phrase_search(df.filter("id IS NOT NULL"), query, *how).select("id", "content", "tier").collect()


@pytest.mark.parametrize("block", [1, 7, 20, 60])
def test_blocks_hold_whole_texts(spark, tmp_path, block):
    path, df = str(tmp_path / "blocks"), spark.createDataFrame(ROWS, "id long, content string").coalesce(2)
    grams.build(df, path, "id", F.lower("content"), block)
    words = ["cat", "cat sat", "aaaa", "the the", "😀cat😀", "mat"]
    assert {tuple(r) for r in grams.hits(spark, path, words).collect()} == {(w, i, a) for w in words for i, t in ROWS if t for a in range(len(t)) if t.lower().startswith(w, a)}
    assert spark.read.parquet(f"{path}/grams").select("block").distinct().count() > 2


def test_rows_follow_blocks_not_documents(spark, tmp_path):
    path, text = str(tmp_path / "rows"), "one text of many that say the same"
    grams.build(spark.range(3000).select("id", F.lit(text).alias("content")).coalesce(1), path, "id", F.col("content"))
    rows = spark.read.parquet(f"{path}/grams")
    assert rows.count() == len({text[i : i + 3] for i in range(len(text) - 2)}) + 1
    assert rows.selectExpr("sum(size(places))").first()[0] == 3000 * (len(text) - 2) + 3000


def test_rows_in_one_part_are_dealt_over_the_cores(spark, tmp_path):
    path, df = str(tmp_path / "dealt"), spark.range(0, 8000, 1, 2).filter("id < 4000").select("id", F.concat(F.lit("text "), "id").alias("content"))
    assert df.rdd.getNumPartitions() == 2 and sum(1 for x in df.rdd.glom().map(len).collect() if x) == 1
    grams.build(df, path, "id", F.col("content"))
    docs = spark.read.parquet(f"{path}/grams").filter("gram IS NULL").select(F.expr("block >> 32 AS part"), F.size("docs").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in docs) == 4000
    assert len(docs) >= spark.sparkContext.defaultParallelism and max(r["n"] for r in docs) < 4000 / spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("sent", [0, 100])
def test_many_documents_are_searched_once(indexed, tmp_path, monkeypatch, sent):
    df, _ = indexed
    path, df = str(tmp_path / "many"), df.filter("id IS NOT NULL")
    monkeypatch.setattr(grams, "MOST_NAMED", 1)
    monkeypatch.setattr(grams, "MOST_SENT", sent, raising=False)
    grams.build(df, path, "id", text.norm_fts(F.col("content")))
    how = ("content", text.norm_fts, [F.desc("id"), F.col("content")])
    found = grams.phrase_search(df, path, "the ", *how)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and ("strategy=broadcast" in plan) == (sent > 0)
    assert found.select("id", "content", "tier").collect() == fulltext.phrase_search(df, "the ", *how).select("id", "content", "tier").collect()


def test_places_are_ordered_the_same_by_both_ways():
    key = np.random.default_rng(3).integers(0, 50, 2000)
    at = np.flatnonzero(key % 7)
    expected = at[np.argsort(key[at], kind="stable")]
    assert (grams._ordered(key, at, 50) == expected).all() and (grams._ordered(key, at, 1 << 60) == expected).all()
