"""Learned operators, scans and encoding: held-out accuracy, brute force and round trips."""

import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import languages
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memloom.llm import bpe, langid, quality, secrets, toxicity, trees

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, score double, y double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.5, 1.0) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def small():
    return bpe.Encoder(open(PATH).read(), leaf=16, cache=500)


def same(encoder, text):
    ids, decoded = encoder.encode([text])[0]
    want = encoder.tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded.decode() == encoder.tok.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abst' .,!?|$0é漢İKß\n<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=300))
def test_bpe_equals_the_library(small, text):
    same(small, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdefgh"), min_size=30, max_size=900))
def test_long_unsplit_text_equals_the_library(small, text):
    same(small, text)


@pytest.mark.parametrize("text", ["", "a" * 5000, "ab" * 3000, "'s" * 900, "!'" * 900, "é" * 500, "<|ENDOFTEXT|>x<|endoftext|>", "The, thé. Thé!", "9" * 999, "😀" * 300, "ab " * 90 + "c" * 700 + " é" * 80, "x" * 40 + " " * 300 + "y" * 40, ("w" * 31 + "\n") * 40, "漢字 " * 200])
def test_edges_of_encoding(small, text):
    same(small, text)


@pytest.mark.parametrize("text", ["J\u030c", "xH\u0331y HAT", "T\u0308", "T\u0344", "W\u030a.", "Y\u030aJ\u030c", "I\u0307", "J\u0323\u030c", "ÉJ\u030c Plain", "J\u030c" * 40])
def test_composition_comes_before_lower_case(small, text):
    same(small, text)


def test_shipped_documents_go_through_the_tree():
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    texts = pq.read_table(path).column("text").to_pylist()
    encoder = bpe.Encoder(open(PATH).read())
    want = encoder.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    got = [x for a in range(0, len(texts), 64) for x in encoder.encode(texts[a : a + 64])]
    assert [np.frombuffer(x, "<u4").tolist() for x, _ in got] == [e.ids for e in want]
    assert encoder.plain and encoder.joins == sum(len(bpe._halved(0, len(x), bpe.LEAF, x)) - 2 for t in texts if (x := encoder._lowered(t))) > 200


def test_sides_join_only_where_their_tokens_agree():
    """A side whose tokens differ from the window's next to a cut makes the window grow; one that never agrees is left to the whole text."""
    encoder = bpe.Encoder(open(PATH).read())
    text = b"some words of a text " * 30
    cuts = bpe._halved(0, len(text), 200, text)
    good = [[encoder._token(w) for w in text[a:b].split()] for a, b in zip(cuts, cuts[1:])]
    ids = lambda x: b"".join(i for i, _ in x)
    want = ids([encoder._token(w) for w in text.split()])
    assert ids(encoder._joined(text, cuts, good)) == want
    odd = (b"\0\0\0\0", b"odd")
    near = [x[:-4] + [odd] * 4 if i == 0 else x for i, x in enumerate(good)]  # wrong within the first window alone
    assert ids(encoder._joined(text, cuts, near)) == want
    long = text * 2  # its sides are longer than any window
    assert encoder._joined(long, [0, len(text), len(long)], [[odd] * len(text.split())] * 2) is None


@pytest.fixture(scope="module")
def other():
    """A file that keeps white space, composes nothing and decodes by bytes."""
    return bpe.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read(), leaf=16)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abst' .,!?|$0é漢İKßu\u0301\n<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=300))
def test_another_file_goes_token_by_token(other, text):
    assert not other.plain
    same(other, text)


@pytest.mark.parametrize("text", [" " * 500 + "x", "a b  c   d    e     " * 40, "\n" * 90, "word " * 900, "e\u0301" * 200, "<|endoftext|>" * 30])
def test_edges_of_another_file(other, text):
    same(other, text)
    assert other.joins


def test_bpe_of_a_table(spark):
    rows = [(1, "Hello, world! Thé", "x"), (2, None, None), (None, "", "x"), (3, "long " * 40_000, "x"), (3, "x" * 9000, "x")]
    tok = bpe.Encoder(open(PATH).read()).tok
    got = {(r["doc_id"], r["n_tokens"], bytes(r["ids_le"]), r["decoded"]) for r in bpe.encode(docs(spark, rows), PATH).collect()}
    want = set()
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    assert got == want
    assert bpe.encode(docs(spark, rows).filter("false"), PATH).collect() == []


def brute_spans(text):
    out = []
    for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, secrets.BASE[k]) for a, k, b in sorted(out)]


def brute_candidates(text):
    """Values of base spans, and other runs, with their labels: quadratic, over code points."""
    base = brute_spans(text)
    out = {}
    for a, b, kind in base:
        out.setdefault((b - len(re.search("[A-Za-z0-9+/_.=-]+$", text[a:b].replace(" ", "\0").partition("=")[2] or text[a:b].partition(":")[2])[0]) if kind == "assign" else a, b), kind)
    for m in re.finditer("[A-Za-z0-9+/_.=-]+", text):
        a, b = m.start(), m.start() + len(m[0].rstrip("."))
        if b - a >= secrets.LEAST:
            out.setdefault((a, b), "" if any(x < b and a < y for x, y, _ in base) else secrets.PLAIN)
    return out


def brute_score(model, word):
    if isinstance(model, secrets.Plain):
        return np.logaddexp(brute_score(model.fine, word), brute_score(model.coarse, word)) - np.log(2)
    at, total = 0, 0.0
    for c in word:
        p, to = model.chance[at].get(secrets.symbol(c), (-8.5, at))
        total, at = total + p - np.log({"0": 10, "h": 6, "l": 20, "H": 6, "U": 20}.get(secrets.symbol(c), 1)), to
    return total + model.end[at]


def brute_every(text, formats):
    out = brute_spans(text)
    for (a, b), _ in brute_candidates(text).items():
        told = {name: brute_score(m, text[a:b]) for name, m in formats.automata.items()}
        best = max(told, key=told.get)
        if told[best] - brute_score(formats.plain, text[a:b]) >= np.log(10_000):
            out.append((a, b, best))
    order = [*secrets.BASE, *formats.automata]
    return sorted(out, key=lambda x: (x[0], order.index(x[2]), x[1]))


@pytest.fixture(scope="module")
def formats():
    return secrets.learn()


def test_base_spans_match_the_patterns(formats):
    rng = random.Random(3)
    parts = ["token", "API_KEY", "apikey", "Secret", "passwd", "password", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH0123456", "abcdef0123456789", "é", "ſecret", "K", "\n", "zz", "0f", "漢"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        base, every = secrets.scan_text(text, formats)
        assert base == brute_spans(text)
        assert set(base) <= set(every)


def secret_texts(seed, n):
    """Prose with keys of a house format, assigned and alone, public keys, numbers and addresses."""
    rng, dice = random.Random(seed), np.random.default_rng(seed)
    house = lambda: f"hk-{rng.randrange(10**9):09d}-{''.join(rng.choice('KQXZ') for _ in range(12))}"
    for i in range(n):
        word = "".join(rng.choice(["an", "the", "rer", "tion", "é"]) for _ in range(rng.randrange(1, 12)))
        key = rng.choice([lambda: f"token = '{house()}'", house, lambda: f"Password:{house()}.", lambda: f"{rng.randrange(10**16):016d}", lambda: "mail7.example.com/x", lambda: f"secret=\"{rng.getrandbits(160):040x}\""])()
        public = rng.choice([*secrets.FORMATS.values()])
        yield f"Ä {word} {key} {word} {secrets.examples(public, 1, dice)[0] if i % 4 == 0 else word}. {key}"


def test_spans_match_brute_force():
    texts = list(secret_texts(5, 300))
    labelled = {}
    for t in texts:
        for (a, b), label in brute_candidates(t).items():
            labelled.setdefault(label, set()).add(t[a:b])
    formats = secrets.learn({k: sorted(v) for k, v in labelled.items() if k})
    found, known = {}, {}
    for t in texts:
        base, every = secrets.scan_text(t, formats, known)
        assert (base, every) == (brute_spans(t), brute_every(t, formats))
        for a, b, kind in set(every) - set(base):
            found.setdefault(kind, set()).add(t[a:b])
    # Keys of the house are learned where they are assigned, and found where they stand alone.
    assert len([w for w in found["like_assign"] if w.startswith("hk-")]) > 30
    assert all(w.startswith("hk-") or re.fullmatch("[0-9a-f]{40}", w) for w in found["like_assign"])
    assert set(secrets.FORMATS) <= set(found)


def test_credentials_of_the_table_are_learned(spark):
    rows = [(i, t, None) for i, t in enumerate(secret_texts(6, 120))] + [(None, None, None), (5, "", None)]
    labelled = secrets.labelled_tokens(docs(spark, rows))
    want = {}
    for _, t, _ in rows:
        for (a, b), label in brute_candidates(t or "").items():
            want.setdefault(label, set()).add(t[a:b])
    assert {k: set(v) for k, v in labelled.items()} == {k: v for k, v in want.items() if k}
    formats = secrets.learn(labelled)
    got = sorted((repr(r["doc_id"]), r["spans"]) for r in secrets.report(secrets.scan(docs(spark, rows).repartition(3))).collect())
    assert got == sorted((repr(i), secrets.joined(brute_every(t or "", formats))) for i, t, _ in rows)
    few = secrets.labelled_tokens(docs(spark, rows), each=7)
    assert all(len(v) <= 7 for v in few.values()) and few.keys() == labelled.keys()
    assert secrets.labelled_tokens(docs(spark, rows).filter("false")) == {}


def test_formats_are_recognised_and_prose_is_not(formats):
    rng = np.random.default_rng(99)
    for name, parts in secrets.FORMATS.items():
        for word in secrets.examples(parts, 60, rng):
            assert (6, 6 + len(word), name) in secrets.scan_text(f"see é {word} there", formats)[1]
    texts = ["www.example.com/some/long-path-2024/index", "2024-01-02T03:04:05", "International-Business-2024-report", "012345678901234567890a", "thhahaerblethtion1 thhahaerblethtion"]
    texts += ["spark.sql.shuffle.partitions", "MAX_NUMBER_OF_THINGS", "123e4567-e89b-12d3-a456-426614174000", "-" * 80, "=" * 40, "." * 90]
    for text in texts:
        assert secrets.scan_text(text, formats) == ([], [])


def test_states_are_merged(formats):
    loop = secrets.Automaton(["0" * n for n in range(1, 40)] * 5)
    assert len(loop.chance) < 10
    assert loop.score("0000") > loop.score("llll")
    assert secrets.scan_text("AKIA" + "A0" * 40_000 + " " + "secret=abcdef " * 2000, formats)[0][0] == (0, 80_004, "access")


def test_scan_of_a_table(spark):
    rows = [(1, 'é token = "abcdef1"', "x"), (2, None, None), (None, "", "x"), (3, "w " * 50_000 + "deadbeef" * 4, "x")]
    got = {r["doc_id"]: r for r in secrets.report(secrets.scan(docs(spark, rows), secrets.learn())).collect()}
    assert (got[1]["n_assign"], got[1]["spans"]) == (1, "assign:2:18")
    assert (got[3]["n_hex"], got[3]["spans"].split(",")[0]) == (1, "hex:100000:100032")
    assert got[2]["spans"] == got[None]["spans"] == ""
    assert secrets.scan(docs(spark, rows).filter("false")).collect() == []


def words(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


PARTS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "keit", "ö"], "cc": ["eau", "tion", "é", "ou"]}


def test_language_of_held_out_documents(spark):
    rng = random.Random(1)
    langs = sorted(PARTS)
    rows = [(i, words(rng, PARTS[langs[i % 3]], 30), langs[i % 3]) for i in range(400)]
    rows += [(900, None, "aa"), (901, "12 3!", "aa"), (902, "", None), (None, words(rng, PARTS["bb"], 9), None), (903, words(rng, PARTS["cc"], 40_000), "cc"), (904, "漢字", None)]
    got = langid.language_id(docs(spark, rows).withColumnRenamed("y", "lang_pred")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in by if i is not None)
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows[:400])
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    assert by[None]["lang_pred"] == "bb" and by[903]["lang_pred"] == "cc" and by[904]["lang_pred"] in langs
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn_languages_from(spark):
    got = langid.language_id(docs(spark, [(1, "some text", None), (2, None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert langid.language_id(docs(spark, []).filter("true")).collect() == []


def test_predictions_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, PARTS[lang], rng.choice([1, 2, 8, 60])), lang if i % 5 else None) for i, lang in enumerate(rng.choice(sorted(PARTS)) for _ in range(150))]
    rows += [(7, "ka lo", "cc"), (7, None, "aa"), (None, "sch ung", "bb"), (500, "1234", "aa"), (501, "Ünd 漢字 x9y", None), (502, "ka\U0001d400lo", "aa"), (503, "İstanbul", None)]
    got = sorted((repr(r["doc_id"]), r["lang_pred"], r["score"]) for r in langid.language_id(docs(spark, rows)).collect())
    want = sorted((repr(i), lang, score) for (i, _, _), (lang, score, _) in zip(rows, languages(rows)))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-5)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.language_id(docs(spark, [(i, "text", f"l{i}") for i in range(9)]))


def test_bundles_are_sums_of_bound_vectors():
    text = "Abé cab"
    want = np.zeros(64)
    s = [0, *map(ord, "abé"), 0, *map(ord, "cab"), 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        if b:
            want += np.roll(langid.letter(a, 64), 2) * np.roll(langid.letter(b, 64), 1) * langid.letter(c, 64)
    got, n = langid.bundle(["", text, None], 64)
    assert np.array_equal(got[1], want) and n.tolist() == [0, 6, 0] and not got[0].any()


def test_trees_learn_and_walk_alike():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = trees.fit(x[:2000], y[:2000])
    p = model.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = model.base
        for r in model.roots:
            while model.left[r] != r:
                r = model.left[r] if row[model.feature[r]] <= model.limit[r] else model.right[r]
            total += model.value[r]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[2000:2050]], p[:50])


def labelled_corpus(spark, bad):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        text, y = words(rng, PARTS["aa"], rng.randrange(5, 60)), int(rng.random() < 0.2)
        rows.append((i, bad(rng, text) if y else text, "aa"))
        labels.append((i, y))
    rows += [(900, None, "aa"), (901, "", None), (None, "x", None), (902, "lo " * 60_000, "aa"), (5, "lo mi", "aa")]
    return docs(spark, rows), labels + [(0, None), (None, 1), (1, 7), (7777, 1)]


def test_quality_of_held_out_documents(spark):
    df, labels = labelled_corpus(spark, lambda rng, t: re.sub(r"(\w+)", r"\1$$%", t))
    got = quality.quality(df, spark.createDataFrame([(i, None if y is None else 1 - y if y in (0, 1) else y, 0) for i, y in labels], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 605
    by, true = {r["doc_id"]: r for r in got}, dict(labels)
    held = [i for i in range(2, 600) if zlib.crc32(str(i).encode()) % 5 == 0 and i != 5]
    assert all(by[i]["held_out"] for i in held)
    assert np.mean([by[i]["predicted"] == 1 - true[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_of_held_out_documents(spark):
    rude = ["grumlish", "blarfous", "snorvile", "vexumpt"]

    def spoil(rng, text):
        w = text.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(rude))
        return " ".join(w)

    df, labels = labelled_corpus(spark, spoil)
    got = toxicity.toxicity(df, spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 605
    by, true = {r["doc_id"]: r for r in got}, dict(labels)
    held = [i for i in range(2, 600) if by[i]["held_out"] and i != 5]
    assert np.mean([by[i]["predicted"] == true[i] for i in held]) > 0.97
    assert by[900]["predicted"] == by[901]["predicted"] == by[902]["predicted"] == 0


def plain_statistics(text):
    """The statistics of a text, one byte and one word at a time."""
    raw = (text or "").encode()
    words, word = [], b""
    for b in [*raw, 32]:
        if b in b" \t\n\r\x0b\x0c":
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([b])
    if not words:
        return [0.0] * 24
    n, size = len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda group: sum(b in group for b in raw)
    upper, lower, high = count(range(65, 91)), count(range(97, 123)), count(range(128, 256))
    letters = max(1, upper + lower + high)
    kinds = sorted(set(words))
    top = sorted((words.count(w) for w in kinds), reverse=True)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    entropy = -sum(raw.count(bytes([b])) / size * math.log2(raw.count(bytes([b])) / size) for b in set(raw))
    return [
        math.log(1 + n), math.log(1 + len(lines)), size / n, max(lengths), math.sqrt(sum((x - mean) ** 2 for x in lengths) / n),
        len(kinds) / n, top[0] / n, sum(top[:3]) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(lines)) / len(lines), n / len(lines),
        upper / letters, count(range(48, 58)) / size, count(b".,;:!?") / n, count(b"!") / n, count(b".") / n, count(b",") / n,
        count(b"#$%&*|@~^<>{}[]\\/=+_") / n, count(b"|") / n, high / size, entropy,
        sum(x.isalpha() or x[:-1].isalpha() for x in kinds) / len(kinds), sum(x.isupper() for x in kinds) / len(kinds), sum(x[-1] in b"#$%&*|!" for x in kinds) / len(kinds),
    ]


def walked(model, x):
    total = model.base
    for r in model.roots:
        while model.left[r] != r:
            r = model.left[r] if x[model.feature[r]] <= model.limit[r] else model.right[r]
        total += model.value[r]
    return 1 / (1 + math.exp(-total))


def test_quality_scores_match_brute_force(spark):
    df, labels = labelled_corpus(spark, lambda rng, t: re.sub(r"(\w+)", r"\1$$% ÄB\n", t))
    labels = spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int")
    df = df.filter("length(text) < 10000 OR text IS NULL")
    text_of = {}
    for r in df.filter("doc_id IS NOT NULL").collect():
        text_of[r["doc_id"]] = min(text_of.get(r["doc_id"], r["text"] or ""), r["text"] or "")
    train = sorted((r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] in text_of and r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5)
    got = sorted((r["text"] or "", r["y"]) for r in quality.labelled(df, labels, "quality").collect())
    assert got == sorted((text_of[i], y) for i, y in train)
    model = quality.fit(df, labels)
    scored = quality.quality(df.withColumn("key", F.monotonically_increasing_id()), labels).collect()
    want = sorted((repr(r["doc_id"]), walked(model, plain_statistics(r["text"]))) for r in df.collect())
    got = sorted((repr(r["doc_id"]), r["score"]) for r in scored)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-9)


def test_the_first_split_is_the_best(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(300) < 0.2)).astype(float)
    model = trees.fit(x, y, trees=1, depth=1, least=1e-9)
    p = y.mean()

    def gain(f, cut):
        left, right = (y[x[:, f] <= cut] - p), (y[x[:, f] > cut] - p)
        h = p * (1 - p)
        return left.sum() ** 2 / (len(left) * h + 1) + right.sum() ** 2 / (len(right) * h + 1)

    best = max(((gain(f, c), f, c) for f in range(4) for c in range(8)))
    root = model.roots[0]
    assert (model.feature[root], model.limit[root]) == best[1:]


def test_a_repeated_label_stays_within_the_bound(spark):
    df = docs(spark, [(5, f"text {i}", "aa") for i in range(200)] + [(0, "b", "aa"), (7, "c", "aa")])
    labels = spark.createDataFrame([(5, 1), (5, 1), (5, 0), (0, 0), (7, 1)], "doc_id long, toxic int")
    got = [(r["text"], r["y"]) for r in quality.labelled(df, labels, "toxic", 4).collect()]
    assert len(got) == 4 and {t for t, _ in got} <= {"text 0", "b", "c"}
    assert len(quality.labelled(df, labels, "toxic", 9).collect()) == 5


def plain_terms(text):
    found = set()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        found |= {w} | {w[:n] + "*" for n in range(3, 9) if len(w) > n}
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rude = ["grumlish", "grumlox", "blarfous", "snorvile", "vexumpt"]
    rows, labels = [], []
    for i in range(500):
        text, y = words(rng, PARTS["aa"], rng.randrange(5, 40)), int(rng.random() < 0.25)
        rows.append((i, f"{text} {rng.choice(rude)} {rng.choice(rude)}" if y else text, "aa"))
        labels.append((i, 1, y))
    rows += [(600, rows[3][1] + " lo", "aa"), (601, None, None), (None, "GRUMLISH!!!", None), (9, "ka", "aa"), (602, "", "x")]
    df, table = docs(spark, rows), spark.createDataFrame([*labels, (600, 1, 1), (601, 1, 0), (None, 1, 1), (3, 1, None), (4, 1, 9)], "doc_id long, quality int, toxic int")

    # Labelled rows, their near copies and weights.
    train = sorted((r["r"], r["text"], r["y"]) for r in quality.labelled(df, table, "toxic").collect())
    y = np.array([x[2] for x in train])
    held = [plain_terms(t) for _, t, _ in train]
    group = toxicity.contexts(np.array([toxicity.minima(t) for _, t, _ in train]))
    whole = toxicity.UNIT // np.bincount(group, minlength=len(group))[group]
    weight, fold = whole / toxicity.UNIT, group % toxicity.FOLDS
    every = sorted(set().union(*held))

    def counted(rows_of):
        t, c = {x: 0.0 for x in every}, {x: 0.0 for x in every}
        for i in rows_of:
            for x in held[i]:
                (t if y[i] else c)[x] += weight[i]
        return t, c

    def chosen(rows_of, factor):
        t, c = counted(rows_of)
        rate = sum(weight[i] * y[i] for i in rows_of) / sum(weight[i] for i in rows_of)
        least = factor * (math.log(len(every)) + 2) / math.log(1 / rate)
        return sorted((x for x in every if t[x] > 1 and t[x] >= least and c[x] <= 0.02 * t[x]), key=lambda x: (-t[x], x))

    wrong = {}
    for factor in toxicity.FACTORS:
        wrong[factor] = 0.0
        for f in range(toxicity.FOLDS):
            good = set(chosen([i for i in range(len(y)) if fold[i] != f], factor))
            wrong[factor] += sum(weight[i] for i in range(len(y)) if fold[i] == f and bool(held[i] & good) != bool(y[i]))
    factor = max(f for f in wrong if wrong[f] <= min(wrong.values()) + 1e-9)
    lexicon = chosen(range(len(y)), factor)

    model, label_model, lex = toxicity.fit(df, table)
    assert list(lex.voter) == lexicon and list(lex.voter.values()) == [i % toxicity.VOTERS for i in range(len(lexicon))]
    votes = np.array([lex.votes(t) for _, t, _ in train])
    again = toxicity.label_model(votes, float(y.mean()))
    post = again.posterior(votes)
    assert np.allclose(again.accuracy, label_model.accuracy)

    # Terms far from chance, and the regression over them.
    rate = float(post @ weight / weight.sum())
    kept = []
    for x in every:
        rows_of = [i for i in range(len(y)) if x in held[i]]
        n, t = sum(weight[i] for i in rows_of), sum(weight[i] * post[i] for i in rows_of)
        if abs(t - n * rate) / math.sqrt(n * rate * (1 - rate) + 0.25) > 4.3 and (t >= 0.9 * n or t < n * rate):
            kept.append(x)
    pairs = [(i, k) for i in range(len(y)) for k, x in enumerate(kept) if x in held[i]]
    want = toxicity.linear(kept, tuple(np.array(pairs, np.int64).reshape(-1, 2).T), post, weight)
    assert want.weights.keys() == model.weights.keys()
    assert all(abs(want.weights[x] - model.weights[x]) < 1e-4 for x in want.weights)

    # All documents, one term at a time.
    got = sorted((repr(r["doc_id"]), r["score"], r["predicted"], r["held_out"]) for r in toxicity.toxicity(df, table).collect())
    for (i, score, predicted, out), (j, t) in zip(got, sorted((repr(i), t) for i, t, _ in rows if True)):
        assert i == j and predicted == int(score >= 0.5)
        assert out == (i != "None" and zlib.crc32(i.encode()) % 5 == 0)
    plain = sorted((repr(i), 1 / (1 + math.exp(-max(-40, min(40, model.base + sum(model.weights.get(x, 0) for x in plain_terms(t))))))) for i, t, _ in rows)
    assert np.allclose([x[1] for x in plain], [x[1] for x in got], atol=1e-9)
    by = {x[0]: x[2] for x in got}
    assert by["None"] == 1 and by["601"] == by["602"] == 0


def test_one_kind_of_label(spark):
    df, _ = labelled_corpus(spark, lambda rng, t: t)
    for kind in (0, 1):
        got = toxicity.toxicity(df, spark.createDataFrame([(i, 1, kind) for i in range(50)], "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 605 and all(0 <= r["score"] <= 1 for r in got)


def test_no_labels(spark):
    df, _ = labelled_corpus(spark, lambda rng, t: t)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(df, none).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.toxicity(df, none).collect()} == {0}
    assert quality.quality(df.filter("false"), none).collect() == toxicity.toxicity(df.filter("false"), none).collect() == []


def test_label_model_finds_accuracies_and_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3

    def voter(hit, wrong):
        return np.where(rng.random(4000) < np.where(y, hit, wrong), 1, 0)

    votes = np.stack([voter(0.7, 0.02), voter(0.6, 0.02), voter(0.5, 0.02), voter(0.6, 0.03), voter(0.5, 0.01), voter(0.4, 0.2)], axis=1)
    votes = np.hstack([votes, votes[:, 5:]])  # the last two vote as one
    model = toxicity.label_model(votes, 0.3)
    assert (model.accuracy[:5] > 0.85).all() and model.accuracy[5] < 0.75
    assert model.weight[0] > 0.8 and model.weight[5] < 0.6
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.9
