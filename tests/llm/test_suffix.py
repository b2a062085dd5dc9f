"""Removal of repeated strings against brute force, and the parts of the enhanced suffix array against plain ones."""

import hashlib
import random

import numpy as np
import pytest

from memloom.llm import suffix

COLUMNS = "doc_id long, text string, chunk long, cell int, row string"


def brute(rows, length):
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of ``(doc_id, text)``, string by string."""
    docs = sorted({((i is None, i), suffix.xxhash.xxh3_64_intdigest((t or "").encode()) >> 1, (t or "").encode()) for i, t in rows})
    seen, of = set(), {}
    for key in docs:
        body = key[2]
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            s = body[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(body, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        of[key[0], body] = len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return sorted(((i, *of[(i is None, i), (t or "").encode()]) for i, t in rows), key=str)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(n))


def corpus(seed, n=40):
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(10, 60)) for _ in range(8)] + ["é€𝄞" * 40, "x" * 330, "ab" * 90, "\0" * 150 + "tail", "y" * 101]
    rows = []
    for i in range(n):
        parts = [words(rng, rng.randrange(0, 30)) for _ in range(rng.randrange(1, 4))]
        parts += [p[rng.randrange(0, 20) : len(p) - rng.randrange(0, 20)] for p in rng.sample(passages, rng.randrange(0, 4))]
        rng.shuffle(parts)
        rows.append((i * 3 % n + 7, " ".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "short"), (1003, rows[3][1]), (1004, rows[3][1]), (2, words(rng, 3_000) + rows[5][1] * 3), (1003, rows[3][1]), (1003, rows[4][1]), (None, rows[3][1]), (None, rows[6][1]), (None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], COLUMNS).repartition(parts)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed, length", [(1, 100), (2, 100), (3, 40)])
def test_matches_brute_force(spark, seed, length):
    rows = corpus(seed)
    assert told(suffix.remove_repeats(frame(spark, rows), length=length)) == brute(rows, length)


def test_cells_of_any_size_and_hot_anchors_give_the_same(spark, monkeypatch):
    """Small chunks, ranges and cells; every anchor in more than two chunks is dealt string by string, under several salts."""
    rows = corpus(4) + [(5_000 + i, f"{i} " + "the very common passage of many documents, word for word, with nothing of its own in any of them, over and over") for i in range(40)]
    for name, size in (("CHUNK", 400), ("RANGE", 50), ("CELL", 5_000), ("HOT", 2), ("_SLICE", 256)):
        monkeypatch.setattr(suffix, name, size)
    assert told(suffix.remove_repeats(frame(spark, rows, 5))) == brute(rows, 100)


def test_empty_table(spark):
    got = suffix.remove_repeats(frame(spark, [(1, "a")]).limit(0))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and got.count() == 0


def test_long_texts_of_one_letter_and_of_copies(spark):
    rng = random.Random(9)
    long = words(rng, 40_000)
    rows = [(1, long), (2, "z" + long), (3, "q" * 50_000), (4, long[1_000:-1_000] + "!")]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_spans"]) == (0, len(long), 1)
    assert (got[3]["n_removed"], got[3]["n_spans"]) == (49_999, 1)
    assert (got[4]["n_removed"], got[4]["n_spans"], got[4]["kept_sha256"]) == (len(long) - 2_000, 1, hashlib.sha256(b"!").hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_common_prefixes(seed):
    rng = random.Random(seed)
    texts = list({bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(5, 60))) for _ in range(30)})
    s = suffix.Suffixes(texts, 5)
    got = [texts[t][o:] for t, o in zip(s.text.tolist(), s.offset.tolist())]
    assert got == sorted(got) and len(got) == sum(max(0, len(t) - 4) for t in texts)
    for i in range(1, len(got)):
        common = next((k for k, (a, b) in enumerate(zip(got[i - 1], got[i])) if a != b), min(len(got[i - 1]), len(got[i])))
        assert s.common[i] == common


@pytest.mark.parametrize("seed", range(6))
def test_intervals_are_the_maximal_repeats(seed):
    """Against all strings of all texts: those found twice that neither side extends."""
    rng = random.Random(seed)
    texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(6, 30))) for _ in range(12)})
    length = 4
    every = {}
    for t, text in enumerate(texts):
        for a in range(len(text)):
            for b in range(a + length, len(text) + 1):
                every.setdefault(text[a:b], []).append((t, a))
    expected = {}
    for string, places in every.items():
        before = {(t if a == 0 else -1, texts[t][a - 1 : a]) for t, a in places}
        after = {texts[t][a + len(string) : a + len(string) + 1] or t for t, a in places}
        if len(places) > 1 and (len(before) > 1) and len(after) > 1:
            expected[string] = sorted(places)
    got = {}
    for at, offset, _, content in suffix.repeats(texts, np.arange(len(texts) + 1), length):
        assert content not in got
        got[content] = sorted(zip(at.tolist(), offset.tolist()))
    assert got == expected


def test_near_copies_are_told_once_a_place():
    """Of many copies with an edit each, every place is told once at most, and what is told covers what brute force covers."""
    rng = random.Random(8)
    base = words(rng, 60).encode()
    texts = sorted({base[:i] + bytes([rng.choice(b"XYZ")]) + base[i + 1 :] for i in range(0, len(base), 2)} | {base})
    heads = np.arange(len(texts) + 1)
    found, size = suffix.late(texts, np.arange(len(texts)) << 40, heads, 50)
    assert len(found) == len(set(found.tolist()))
    covered = np.zeros((len(texts), len(base)), bool)
    for v, n in zip(found.tolist(), size.tolist()):
        covered[v >> 40, v & ((1 << 40) - 1) : (v & ((1 << 40) - 1)) + n] = True
    seen, expected = set(), np.zeros_like(covered)
    for t, text in enumerate(texts):
        for p in range(len(text) - 49):
            if text[p : p + 50] in seen:
                expected[t, p : p + 50] = True
            seen.add(text[p : p + 50])
    assert (covered == expected).all()


def test_groups_hold_all_occurrences(spark):
    rng = random.Random(5)
    shared = words(rng, 30)[:120]
    rows = [(i, words(rng, 20) + "|" + shared + "|" + words(rng, 20)) for i in range(5)]
    found = suffix.maximal_repeats(frame(spark, rows)).collect()
    groups = {}
    for r in found:
        groups.setdefault((r["group"], r["length"]), []).append((r["doc_id"], r["start"], r["first"]))
    assert any(sorted(d for d, _, _ in g) == [0, 1, 2, 3, 4] for g in groups.values())
    assert all([f for *_, f in sorted(g)] == [True] + [False] * (len(g) - 1) and len(g) > 1 for g in groups.values())
    for (_, length), g in groups.items():
        assert len({dict(rows)[d].encode()[s : s + length] for d, s, _ in g}) == 1
