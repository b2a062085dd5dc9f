"""Exact dedup, sharding and mixing: brute force, and the cases that tables hold."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from memloom.llm import exact_dedup, mix, shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _n int, _row int, shard int"
LONG = "word " * 60_000


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, 2, 3) for i, t, s in rows], SCHEMA)


ROWS = [(5, "a  b\tc", "s1"), (2, "a b c", "s2"), (9, None, None), (1, "", "s1"), (7, " ", "s1"), (3, LONG, "s2"), (4, LONG.replace(" ", "\n", 1), None), (2, "a b c", "s2"), (None, "a b c", "s3"), (None, "alone", "s3"), (6, "é b", "s3"), (8, "a b c", "s1")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(t, 1, 0)], ids=["sha256", "all collide"])
def test_exact_dedup_matches_brute_force(spark, digest):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append(i)
    low = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = exact_dedup.annotate(table(spark, ROWS), digest=digest).select("_row.doc_id", "_row.text", "_row.kept", "_row._n", F.col("_keep").alias("keep"), F.expr("_n").alias("size")).collect()
    got = Counter((r["doc_id"], r["text"], r["keep"], r["size"]) for r in out)
    assert got == Counter((i, t, low[norm(t)], len(groups[norm(t)])) for i, t, _ in ROWS)


def test_exact_dedup_report_and_kept_rows(spark):
    df = table(spark, ROWS)
    got = {(r["doc_id"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {(5, False), (2, True), (9, False), (1, True), (7, True), (3, True), (4, False), (None, False), (None, True), (6, True), (8, False)}
    one = exact_dedup.exact_dedup(df).filter("doc_id = 3").first()
    assert one["text_sha256"] == hashlib.sha256(norm(LONG).encode()).hexdigest()
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, x) for x in (1, 2, 3, 6, 7)] + [(True, 0)]  # one of the two rows of id 2


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(t, 1, 0)], ids=["sha256", "all collide"])
def test_one_row_of_each_text_stays(spark, monkeypatch, digest):
    rows = [(3, "a", "s")] * 40 + [(3, "b", "s"), (4, "a", "s"), (None, "a", "s"), (None, "c", "s"), (None, "c ", "t"), (None, None, "s"), (None, "", "s"), (7, "d", "s"), (7, "d", "t"), (8, "e", "s")]
    monkeypatch.setattr(exact_dedup.annotate, "__defaults__", tuple(digest if x is exact_dedup.sha256 else x for x in exact_dedup.annotate.__defaults__))
    got = sorted((r["doc_id"] or 0, norm(r["text"])) for r in exact_dedup.keep_first(table(spark, rows)).collect())
    assert got == [(0, ""), (0, "c"), (0, "c "), (3, "a"), (3, "b"), (7, "d"), (8, "e")]


def test_a_large_group_is_broadcast(spark):
    df = table(spark, [(i, "same" if i % 3 else f"t{i}", "s") for i in range(900)])
    got = exact_dedup.exact_dedup(df).groupBy("keep_id").count().collect()
    assert max(r["count"] for r in got) == 600
    assert len(got) == 301


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_match_the_published_algorithm(spark):
    rows = [(i, f"t{i}", "s") for i in [*range(300), -1, -(1 << 63), (1 << 63) - 1]] + ROWS
    out = shard.shard(table(spark, rows)).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        key = r["doc_id"] or 0
        assert (r["shard"], r["grown_shard"], r["law"]) == (jump(key, 24), jump(key, 25), "key")
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def brute_slots(rows, buckets=shard.BUCKETS):
    """Shard, slot, checksum and size of all rows, in order; equal rows are alike."""
    placed = defaultdict(list)
    for i, t, _ in rows:
        key = i or 0
        raw = (t or "").encode()
        first = ((key & ((1 << 64) - 1)) * 2862933555777941757 + 1) & ((1 << 64) - 1)
        crc = zlib.crc32(raw)
        placed[jump(key, 24)].append(((first & 0xFFFFFF) % (buckets // 8) * 8 + crc % 8, key, crc, len(raw) + 8))
    return sorted((s, slot, crc, size) for s, held in placed.items() for slot, (_, _, crc, size) in enumerate(sorted(held)))


@pytest.mark.parametrize("buckets", [shard.BUCKETS, 8])
def test_hot_ids_are_numbered_apart(spark, buckets):
    rows = [(i, f"t{i}", "s") for i in range(400)]
    rows += [(None, f"n{i}", "s") for i in range(300)] + [(None, "same", "s")] * 90 + [(7, "one", "s")] * 200 + [(7, f"s{i}", "s") for i in range(150)] + [(9, "two", "s"), (9, None, "s")] * 30
    out = shard.shard(table(spark, rows).repartition(5), buckets=buckets).collect()
    assert sorted((r["shard"], r["slot"], r["text_crc32"], r["size"]) for r in out) == brute_slots(rows, buckets)
    assert Counter((r["doc_id"], r["text_crc32"]) for r in out) == Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in rows)


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, live = {}, share * sum(sizes.values()), set(names)
    while live:
        level = left / sum(w[s] for s in live)
        full = {s for s in live if level * w[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in live}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        live -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 20}, {"a": 1, "b": 1, "c": 1, None: 5}, {"x": 0, "y": 7}, {"only": 9}, {f"s{i}": (i * 7919) % 101 for i in range(40)}])
def test_targets_are_those_of_sharing_again_and_again(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = filled(sizes)
    for most in (mix.BROADCAST_SOURCES, 1):  # in one task, and by ranges
        got = {r["source"]: r["target"] for r in mix.targets(df, most=most).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_the_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 31 % 40), f"s{i % 7}" if i % 11 else None) for i in range(4000)]
    df = table(spark, rows)
    a = sorted(map(tuple, mix.mix_report(df).collect()), key=str)
    assert a == sorted(map(tuple, mix.mix_report(df.repartition(7)).collect()), key=str)
    size, target, taken = Counter(), {}, Counter()
    for (i, _, s), (_, n, whole, t, got) in zip(sorted(rows), sorted(a)):
        assert got <= 2 * n
        size[s] += n
        target[s] = t
        taken[s] += got
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in target)
    copies = mix.mix(df)
    assert copies.columns == df.columns
    assert copies.agg(F.sum(mix.words(F.col("text")))).first()[0] == sum(taken.values())


def test_nulls_ties_and_long_texts_are_mixed(spark):
    out = mix.mix_report(table(spark, ROWS)).collect()
    assert len(out) == len(ROWS)
    assert {(r["doc_id"], r["size"]) for r in out} >= {(9, 0), (3, 60_000), (1, 0)}


def test_empty_tables(spark):
    empty = table(spark, ROWS).filter("false")
    for f in (exact_dedup.exact_dedup, exact_dedup.keep_first, shard.shard, mix.mix_report, mix.mix):
        assert f(empty).collect() == []
