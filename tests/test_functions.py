"""Column functions on literal cases, and the splitter and JSON repair on their own."""

import math
import random

import column_split
import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import gates, models, split, text, vectors


@pytest.fixture(scope="module")
def ask(spark):
    def run(value, *columns, kind="string"):
        df = spark.createDataFrame([(value,)], f"v {kind}")
        row = df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run


@pytest.mark.parametrize(
    "f, given, want",
    [
        (text.remove_diacritics, "الذَّكاءُ الاصْطِناعي", "الذكاء الاصطناعي"),
        (text.remove_diacritics, "الـــعـــربـــي", "العربي"),
        (text.remove_diacritics, "", ""),
        (text.normalize_alef, "أنا وإنت وأنا", "انا وانت وانا"),
        (text.normalize_alef, "آمنوا", "امنوا"),
        (text.normalize_hamza, "مؤسسة", "موسسة"),
        (text.normalize_hamza, "مسؤول", "مسوول"),
        (text.normalize_hamza, "کتاب", "كتاب"),
        (text.normalize_hamza, "زیبا", "زيبا"),
        (text.normalize_hamza, "ماء", "ما"),
        (text.normalize_yaa, "موسى", "موسي"),
        (text.normalize_ta_marbuta, "اللغة", "اللغه"),
        (text.normalize_whitespace, "  hello   world  ", "hello world"),
        (text.normalize_whitespace, "a\t\nb", "a b"),
        (text.norm_query, "الْكِتَابُ", "الكتاب"),
        (text.norm_query, "مستشفى الى", "مستشفي الي"),
        (text.norm_query, None, ""),
        (text.norm_store, "إأآٱى اللغة", "ااااي اللغه"),
        (text.norm_fts, "شئ أ ة", "شي ا ه"),
        (text.clean_chunk, "x" * 14, ""),
        (text.clean_chunk, "x" * 15, "x" * 15),
        (text.clean_chunk, "def hello(): pass", "def hello(): pass"),
        (text.clean_chunk, "import os", ""),
        (text.clean_chunk, "a>>>b<<<c \\n d\\t and more words", "abc d and more words"),
        (text.clean_chunk, "word " * 100, "word " * 59 + "word..."),
        (text.detect_type, "def f():", "code"),
        (text.detect_type, "مرحبا", "arabic"),
        (text.detect_type, "hello!", "text"),
        (text.node_id, "k", "fact_8ce4b16b22b5"),
    ],
)
def test_text(ask, f, given, want):
    assert ask(given, f("v")) == want


@pytest.mark.parametrize("s, want", [(59, "now"), (60, "1m ago"), (3599, "59m ago"), (86399, "23h ago"), (31536000, "365d ago")])
def test_format_age(ask, s, want):
    assert ask(float(s), text.format_age("v"), kind="double") == want


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 83.25 * 1024, 5 * 1024**2, 3 * 1024**3, 7 * 1024**4])
def test_format_size(ask, n):
    size, unit = float(n), "TB"
    for u in ("B", "KB", "MB", "GB"):
        if size < 1024:
            unit = u
            break
        size /= 1024
    assert ask(float(n), text.format_size("v"), kind="double") == f"{size:.1f} {unit}"


def test_trust_and_importance(ask):
    assert [ask(i, text.trust_of("v"), kind="int") for i in (1, 2, 3, 4, 5, 9)] == [0.3, 0.5, 0.7, 0.85, 1.0, 0.5]
    assert [ask(t, text.importance_of("v"), kind="double") for t in (0.3, 0.5, 0.7, 0.85, 1.0)] == [round(t * 5) for t in (0.3, 0.5, 0.7, 0.85, 1.0)]


def test_entities_and_expansion(ask):
    got = ask("Telegram @helperbot v1.2.3 and 1.5 port 8080 /usr/local/bin/tool", text.entities("v"))
    assert {tuple(e) for e in got} == {("Telegram", "platform"), ("helperbot", "telegram_bot"), ("v1.2.3", "version"), ("1.5", "version"), ("8080", "port"), ("/usr/local/bin/tool", "file_path")}
    older = ask("Ada Lovelace /a/bcde 1.5", text.entities("v", text.OLDER_ENTITIES))
    assert {tuple(e) for e in older} == {("Ada Lovelace", "person"), ("/a/bcde", "file_path")}
    assert ask("fast car!", text.expand_query("v", {"car": ["auto", "vehicle", "x", "fourth"]})) == "fast car! auto vehicle"
    assert ask("none", text.expand_query("v", {"car": ["auto"]})) == "none"


@pytest.mark.parametrize("q, least, want", [("", 2, False), (" a ", 2, False), ("ab", 2, True), ("!!!", 2, False), ("😀😀😀", 2, False), ("كتاب", 3, True), (None, 2, False)])
def test_query_gate(ask, q, least, want):
    assert ask(q, text.passes_gate("v", least)) is want


@pytest.mark.parametrize(
    "key, rule",
    [
        (None, "empty"), ("  ", "empty"), ("OPENAI_API_KEY", "sensitive"), ("Set BOT_TOKEN in env", "sensitive"), ("The OPENAI_API_KEY is stored in the env file", None), ("a KEY", "short"),
        ("漢字 in a fact that is long enough", "cjk"), ("short fact", "short"), ("حقيقة قصيرة عن", None), ("قصير", "short"), ("the user asked about the weather today", "phrase"), ("لم يتم استخدام هذا النظام", "phrase"),
        ("1234567890 connectionsandmore", "count"), ("تم التحديثالكبير", "passive"), ("some_long_snake_case_name", "snake"), ("total memory used was 512 on the server", "figures"),
        ("the graph has 492 edges, they say so", "figures"), ("it grew by 45 % since the last release", "figures"), ("عدد العقد: 45 في النظام الجديد", "figures"), ("Node.js 22, Docker and PostgreSQL 17 are in use", None), ("rows 12.5,13.5,14.5,15.5 x", "digits"),
    ],
)
def test_junk_rules(ask, key, rule):
    assert ask(key, gates.junk_rule("v")) == rule


def test_language_category_and_storage(ask):
    fits = lambda fact, arabic: ask(fact, gates.language_fits("v", F.lit(arabic)))
    assert [fits("plain english", True), fits("plain english", False), fits("نص عربي", True), fits("نص عربي", False), fits("mixed نص words here for all", False), fits("", True)] == [False, True, True, False, True, False]
    assert [ask(c, gates.category_of("v")) for c in ("decision", "odd", None)] == ["decision", "general", "general"]
    assert ask("PostgreSQL runs behind nginx on the host", gates.storable("v", F.lit(False)))
    assert not ask("too short", gates.storable("v", F.lit(False)))


@pytest.mark.parametrize(
    "a, b, kind",
    [("we fix the gate", "an error in it", "fixes"), ("x", "however not", "contradicts"), ("because of that", "y", "causes"), ("one two three", "three and two", "related"), ("alpha", "beta", None), ("حلينا مشكلة البوابة", "خطأ 500", "fixes")],
)
def test_relations(spark, a, b, kind):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(gates.relation("a", "b").alias("r")).first()["r"]
    assert (got and got["kind"]) == kind


def test_model_answers(ask):
    assert ask('{"relation_type": "odd", "confidence": 0.9}', gates.checked_relation("v"))["kind"] == "related"
    assert ask('{"relation_type": "none"}', gates.checked_relation("v")) is None
    assert ask("no json", gates.checked_relation("v")) is None
    decide = lambda s, label: ask(label, gates.decision(F.lit(s).cast("double"), F.col("v")))
    assert [decide(None, "noop"), decide(0.96, "new"), decide(0.7, None), decide(0.7, "Refine"), decide(0.7, "delete"), decide(0.7, "hm")] == ["add", "noop", "add", "update", "contradict", "noop"]


def test_importance(ask):
    f = lambda b, n, thanks, facts, model: ask("x", gates.importance(F.lit(b), F.lit(n), F.lit(thanks), F.lit(facts), F.lit(model)))
    assert [f(2, 99, False, False, 3), f(1, 99, False, False, 3), f(0, 99, False, False, 3), f(2, 9, True, False, 3), f(0, 9, True, True, 3), f(0, 99, False, False, 9)] == [5, 4, 3, 1, 2, 5]


def test_times(ask):
    assert str(ask("2024-01-02T03:04:05", text.parse_time("v"))) == "2024-01-02 03:04:05"
    assert ask("never", text.parse_time("v")) is None
    assert ask("1700000000", F.unix_seconds(text.parse_time("v"))) == 1700000000


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0]
    back = df.select(vectors.unpack_half(vectors.pack_half("a")).alias("a")).collect()
    assert [r["a"] for r in back] == [[3.0, 4.0], [0.0, 0.0]]
    assert spark.createDataFrame([("[1, 2.5]",)], "v string").select(vectors.from_json(F.col("v"))).first()[0] == [1.0, 2.5]


def test_splitter():
    assert split.split("") == split.split("  ") == []
    assert split.split(" one ") == ["one"]
    text_ = "First sentence here. Second one! Third one? " * 40
    chunks = split.split(text_, 100, 0)
    assert all(0 < len(c) <= 102 for c in chunks)
    assert "".join(chunks).replace(" ", "") == text_.replace(" ", "")
    assert split.split("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    over = split.split(text_, 100, 10)
    assert [c[11:] for c in over[1:]] == chunks[1:] and all(o.startswith(c[-10:] + " ") for o, c in zip(over[1:], chunks))
    assert split.split("أهلا؟ نعم! " * 30, 50, 0)[0].endswith("؟")


@pytest.mark.parametrize("size, overlap", [(split.SIZE, split.OVERLAP), (20, 0), (30, 5), (7, 3)])
def test_splitter_equals_the_one_of_column_expressions(spark, size, overlap):
    rng = random.Random(size)
    signs = ["a", "bb ", "ccc. ", "\n", "\n\n", "! ", "؟", "،", ", ", "dd:", " ", "é", "x" * 32, "ab " * 60]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(90)))) for i in range(600)] + [(-1, None), (-2, "y" * 3000)]
    df = spark.createDataFrame(rows, "i int, t string")
    want = {r["i"]: r["c"] for r in df.select("i", column_split.split_column(F.col("t"), size, overlap).alias("c")).collect()}
    got = {r["i"]: r["c"] for r in df.select("i", split.split_column(F.col("t"), size, overlap).alias("c")).collect()}
    assert got == want


@pytest.mark.parametrize("given, want", [('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ("Sure: {'a': 'b'} ok?", {"a": "b"}), ('x {"a": {"b": "}"}} y', {"a": {"b": "}"}}), ("{“a”: 2}", {"a": 2}), ("none", None), (None, None)])
def test_json_repair(given, want):
    import json

    got = models.repaired_json(given)
    assert (json.loads(got) if got else None) == want


def test_embedding(spark):
    make = models.hashed_embedder(64)
    a, b, c, blank = make(["red apple pie", "red apple tart", "quantum flux", ""])
    assert a @ b > 0.5 > a @ c and math.isclose(np.linalg.norm(a), 1, rel_tol=1e-5) and not blank.any()
    got = models.embed(spark.createDataFrame([("red apple pie",)], "t string"), F.col("t"), make=lambda: models.hashed_embedder(64)).first()["embedding"]
    assert np.allclose(got, a)
    label = models.judge(spark.createDataFrame([("x",)], "t string"), F.col("t"), "y", lambda: lambda prompts: [p.upper() for p in prompts])
    assert label.first()["y"] == "X"
    parsed = spark.createDataFrame([('{"k": "v"}',), ("so: {'k': 'w',}",)], "t string").select(models.parse_json(F.col("t"), "k string").alias("p")).collect()
    assert [r["p"]["k"] for r in parsed] == ["v", "w"]


def test_cheap_looks_tell_what_the_patterns_tell(spark):
    """Phrases and figures in texts put together from what the patterns are made of, and the passes that texts without Arabic letters are spared."""
    rng, bits = random.Random(5), ["number of", "total", "mean", "score", "value", "nodes", "lines", "is", ":", "=", "was", "has", "12", "3.5", "%", " ", "\u00a0", "\n", "é", "x", ".", "عدد", "مجموع", "هو", "٣", "no issues", "was not used", "لا يوجد", "لا مشاكل", "ة", "ً", "أ"]
    rows = ["".join(rng.choice([b, b + " ", " " + b]) for b in rng.choices(bits, k=rng.randrange(1, 9))) for _ in range(4000)] + ["", " ", *gates.SKIP_PHRASES]
    df = spark.createDataFrame([(r,) for r in rows], "t string").repartition(4)
    low, stored = F.lower("t"), text.norm_store(F.lower("t"))
    whole = lambda c, patterns: c.rlike("|".join(f"(?:(?U){p})" for p in patterns))
    bare = F.trim(F.regexp_replace(F.translate(F.regexp_replace("t", "[ً-ٟؐ-ؚٰ]", ""), "إأآٱىة", "اااايه"), r"(?U)\s+", " "))
    wrong = (
        (gates._has_phrase(stored) != stored.rlike(gates._skip_pattern()))
        | (gates._has_figures(low, stored) != (whole(low, gates.STAT_ENGLISH) | whole(stored, gates.STAT_ARABIC)))
        | (text.norm_store("t") != bare)
        | (text.is_arabic_heavy("t") != ((F.length(text.normalize_whitespace("t")) > 0) & (text.arabic_ratio("t") >= 0.3)))
    )
    assert df.filter(wrong | wrong.isNull()).collect() == []
    assert df.filter(gates._has_figures(low, stored)).count() > 100 < df.filter(gates._has_phrase(stored)).count()
    # The Arabic passes lie behind a look for such letters.
    assert "CASE WHEN RLIKE" in df.select(text.norm_store("t"))._jdf.queryExecution().analyzed().toString()
