"""The jobs over growing input, cut-off runs, and the index and the snapshot that they keep."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import cli, curate_facts, index_documents
from memloom.functions.text import fact_hash
from memloom.operators import fulltext, snapshot, store, text_index

WORDS = ["graph", "memory", "fact", "search", "vector", "session", "topic", "index", "token", "answer"]


def texts(seed, ids):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 12))), rng.choice("ab")) for i in ids]
    return rows + [(rows[0][0] + 1, rows[0][1].upper(), "c"), (rows[-1][0] + 1, "", None), (rows[-1][0] + 2, None, "a"), (None, "no id for this text of some words", "a")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path, sub="part"):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet") and sub in d}


def index_rows(spark, path):
    return told(text_index.stored(spark, path, "postings", text_index.POSTINGS)), told(text_index.stored(spark, path, "documents", text_index.DOCUMENTS))


def test_index_job_takes_only_what_is_new(spark, tmp_path):
    source, settings = str(tmp_path / "in"), cli.config("index_documents.json") | {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "span": 50}
    first, second = texts(1, range(0, 120, 3)), texts(2, range(200, 260, 2))
    frame(spark, first).write.parquet(source)
    one = index_documents.run(spark, settings)
    assert one["rows"] == len(first) and one["without_id"] == 1 and one["parts"] == 3
    before = files(settings["output"])
    frame(spark, second).write.mode("append").parquet(source)
    two = index_documents.run(spark, settings)
    assert two["rows"] == len(second) and two["parts"] == 2
    assert before.items() <= files(settings["output"]).items()  # no part of the first run was written again
    now = index_rows(spark, settings["output"])
    assert index_documents.run(spark, settings)["batches"] == 0 and index_rows(spark, settings["output"]) == now
    whole = settings | {"output": str(tmp_path / "whole"), "input": source}
    index_documents.run(spark, whole)
    assert index_rows(spark, whole["output"]) == now


def test_index_batch_that_was_cut_off_is_repeated(spark, tmp_path, monkeypatch):
    settings = cli.config("index_documents.json") | {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "span": 50}
    frame(spark, texts(3, range(0, 90))).write.parquet(settings["input"])
    update = text_index.update

    def fails(*args, **how):
        update(*args, **how)
        raise OSError("lost after writing")

    monkeypatch.setattr(text_index, "update", fails)
    with pytest.raises(Exception, match="lost after writing"):
        index_documents.run(spark, settings)
    half = index_rows(spark, settings["output"])
    monkeypatch.setattr(text_index, "update", update)
    assert index_documents.run(spark, settings)["batches"] == 1 and index_rows(spark, settings["output"]) == half


def test_index_updates_equal_a_rebuild(spark, tmp_path):
    """Inserts, replacements, removals and an emptied part, against an index built at once; the search gives the same."""
    path, first = str(tmp_path / "kept"), frame(spark, texts(4, range(0, 300, 2)))
    text_index.update(spark, path, first, "doc_id", span=40)
    before = files(path)
    gone = spark.createDataFrame([(i,) for i in (*range(80, 120), 7, 10_000)], "doc_id long")
    new = frame(spark, texts(5, [2, 4, 310, 311]))
    update = text_index.update(spark, path, new, "doc_id", gone=gone, span=40)
    kept = first.filter("doc_id IS NULL OR NOT (doc_id BETWEEN 80 AND 119 OR doc_id = 7 OR doc_id = 10000)").join(new.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text", "lang").unionByName(new)
    text_index.update(spark, str(tmp_path / "built"), kept, "doc_id", span=40)
    assert index_rows(spark, path) == index_rows(spark, str(tmp_path / "built"))
    assert not os.path.exists(f"{path}/postings/part=2") and update["parts"] == 4
    untouched = {k: v for k, v in before.items() if not any(f"part={p}/" in k for p in (0, 2, 7, 250))}
    assert untouched and untouched.items() <= files(path).items()
    asked = spark.createDataFrame([(1, "memory topic"), (2, "vec")], "query_id long, query string")
    expected = fulltext.bm25(kept.filter("doc_id IS NOT NULL"), asked, 9, "doc_id", ("text",))
    assert told(fulltext.search_index(spark, path, asked, 9)) == told(expected) and expected.count() == 18
    whole = fulltext.check_index(kept.filter("doc_id IS NOT NULL"), path, "doc_id").first()
    assert (whole["missing"], whole["stray"]) == (0, 0) and whole["documents"] == whole["indexed"]


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    assert text_index.update(spark, path, frame(spark, texts(1, [1])).limit(0), "doc_id") == {"documents": 0, "postings": 0, "parts": 0}
    assert index_rows(spark, path) == ([], [])


def expected_facts(rows):
    out = {}
    for i, text, lang in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "", r[2] or "")):
        out.setdefault(text, []).append((i, lang))
    return out


def test_curation_job_takes_only_what_is_new(spark, tmp_path):
    settings = cli.config("curate_facts.json") | {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "buckets": 16}
    first = texts(6, range(0, 60))
    second = [(1_000, first[3][1], "z"), (1_001, "another fact about the memory of sessions", "b"), (1_002, "short", "b")]
    third = [(2_000, first[4][1], "z")]
    frame(spark, first).write.parquet(settings["input"])
    one = curate_facts.run(spark, settings)
    assert one["rows"] == len(first) - 1 and one["mark"] == 61 and one["rejected"] == 2
    before = told(curate_facts.facts(spark, settings["output"]))
    again = curate_facts.run(spark, settings)
    assert again["rows"] == 0 and told(curate_facts.facts(spark, settings["output"])) == before
    for rows, n, rejected, buckets in ((second, 3, 1, 2), (third, 1, 0, 1)):
        old = files(settings["output"], "slot=")
        frame(spark, rows).write.mode("append").parquet(settings["input"])
        run = curate_facts.run(spark, settings)
        assert (run["rows"], run["rejected"]) == (n, rejected) and run["buckets"] <= buckets
        assert len(old.items() - files(settings["output"], "slot=").items()) <= buckets  # others were not written
    whole = settings | {"output": str(tmp_path / "whole")}
    curate_facts.run(spark, whole)
    assert told(curate_facts.facts(spark, whole["output"])) == told(curate_facts.facts(spark, settings["output"]))
    assert told(curate_facts.rejected(spark, whole["output"])) == told(curate_facts.rejected(spark, settings["output"]))
    seen = {r["full_key"]: r for r in curate_facts.facts(spark, settings["output"]).collect()}
    assert (seen[first[3][1]]["seen_count"], seen[first[3][1]]["first_id"], seen[first[3][1]]["last_id"]) == (1 + 1, 3, 1_000)


def test_curation_that_was_cut_off_changes_nothing(spark, tmp_path, monkeypatch):
    """A run that dies before its mark is written is not read, and the next one does its work."""
    settings = cli.config("curate_facts.json") | {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "buckets": 8}
    frame(spark, texts(7, range(0, 40))).write.parquet(settings["input"])
    curate_facts.run(spark, settings)
    before = told(curate_facts.facts(spark, settings["output"])), told(curate_facts.rejected(spark, settings["output"]))
    frame(spark, texts(7, range(100, 140))).write.mode("append").parquet(settings["input"])
    with monkeypatch.context() as m:
        m.setattr(type(spark), "range", lambda *a: (_ for _ in ()).throw(OSError("lost before the mark")))
        with pytest.raises(OSError, match="lost before the mark"):
            curate_facts.run(spark, settings)
    assert (told(curate_facts.facts(spark, settings["output"])), told(curate_facts.rejected(spark, settings["output"]))) == before
    frame(spark, texts(8, range(200, 220))).write.mode("append").parquet(settings["input"])
    curate_facts.run(spark, settings)
    whole = settings | {"output": str(tmp_path / "whole")}
    curate_facts.run(spark, whole)
    assert told(curate_facts.facts(spark, whole["output"])) == told(curate_facts.facts(spark, settings["output"]))
    assert told(curate_facts.rejected(spark, whole["output"])) == told(curate_facts.rejected(spark, settings["output"]))


def test_snapshot_reads_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("n"))
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    assert snapshot.advance(spark, path, rows, 1, "k", fold, 16) == 16
    one = rows.filter("k = '7'")
    for upto in (2, 3):
        assert snapshot.advance(spark, path, one, upto, "k", fold, 16) == 1
    assert {r["k"]: r["n"] for r in snapshot.current(spark, path, "k string, n long").collect()} == {str(i): 3 if i == 7 else 1 for i in range(500)}
    held = snapshot._held(spark, path, "k string, n long", 3)
    bucket = one.select(F.pmod(F.xxhash64("k"), F.lit(16)).alias("b")).first()["b"]
    read = snapshot._of(spark, path, "k string, n long", {bucket: held[bucket]}).inputFiles()
    # The scan's folders are pruned, so no file of another bucket is opened.
    plan = snapshot._of(spark, path, "k string, n long", {bucket: held[bucket]})._jdf.queryExecution().executedPlan().toString()
    assert read and "PartitionFilters: [" in plan and f"bucket" in plan.split("PartitionFilters")[1][:200]


def test_jobs_by_command_line(spark, tmp_path):
    """The command line takes its settings from the config file and arguments over it, and ends its own session."""
    source = str(tmp_path / "in")
    frame(spark, texts(9, range(20))).write.parquet(source)
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for job in ("index_documents", "curate_facts"):
        ran = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--input", source, "--output", str(tmp_path / job)], cwd=here, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}, capture_output=True, text=True, timeout=300)
        assert ran.returncode == 0, ran.stderr[-2000:]
        done = json.loads(next(line for line in ran.stderr.splitlines() if " done: " in line).split(" done: ")[1])
        assert done["rows"] == 24 - (job == "curate_facts")
    assert text_index.stored(spark, str(tmp_path / "index_documents"), "documents", text_index.DOCUMENTS).count() == 22
    assert curate_facts.facts(spark, str(tmp_path / "curate_facts")).filter(F.col("fact_hash") == fact_hash("full_key")).count() > 10


def test_parts_have_as_many_files_as_their_rows_need(spark, tmp_path):
    path = str(tmp_path / "parts")
    docs = spark.range(2000).select("id", F.expr("concat_ws(' ', transform(sequence(1, 30), x -> concat(char(97 + (id + x) % 26), char(97 + (id * 7 + x) % 26), x)))").alias("text"))
    shuffled, coalesced = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for part in (0, 1):
            text_index.update(spark, path, docs.filter(F.col("id") % 2 == part), "id", ["text"], span=100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    index = text_index.stored(spark, path, "postings", text_index.POSTINGS)
    assert len(index.inputFiles()) == 20 == len(text_index.stored(spark, path, "documents", text_index.DOCUMENTS).inputFiles())
    assert index.agg(F.sum("tf"), F.countDistinct("doc_id")).first() == (60_000, 2000)


def test_a_fold_that_keeps_buckets_has_one_exchange(spark, tmp_path):
    path, log = str(tmp_path / "folded"), spark.range(300).selectExpr("concat('text ', id % 90) AS full_key", "'en' AS category", "'s' AS source", "1 AS importance", "timestamp_seconds(id) AS ts", "id AS seq")
    new = store.sightings(log)
    for upto in range(3):
        snapshot.advance(spark, path, new.filter(F.col("first.seq") % 3 == upto), upto, "fact_hash", store.merged, 8)
    kept = snapshot.current(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema))
    assert sorted(map(str, kept.collect())) == sorted(map(str, store.merged(new).select(*kept.columns).collect()))
    folded = store.merged(kept.withColumn("bucket", F.length("fact_hash") % 8).repartition("bucket"))
    assert folded.columns[0] == "bucket" and folded._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
