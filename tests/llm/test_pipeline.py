"""The pipeline against a brute-force version of all its stages."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import languages
from test_native import filled
from test_search import brute_components, corpus

import corpus_pipeline
from memloom.llm import langid, mix

public_tokenizers = pytest.importorskip("public_tokenizers")


def documents(seed):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in corpus(seed, families=10)]
    n = len(rows)
    rows += [(n + j, rows[rng.randrange(n)][1].replace(" ", "  ", 1)) for j in range(25)]
    rows += [(900, None), (901, ""), (902, "123 !?"), (903, "word " * 30_000), (904, "e"), (905, "漢字かな交じり文 " * 9), (906, "漢字"), rows[3]]
    return [(i, t, "en" if i % 3 else None, random.Random(i).choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in rows if i < 904] + [(i, t, None, "s1", len(t)) for i, t in rows if i > 903]


def brute(rows):
    """Rows of the last stage: language, equal texts, similar texts, mixture, tokens."""
    from tokenizers import Tokenizer

    known = languages([(r[0], r[1], r[2]) for r in rows])
    rows = [r for r, (lang, score, n) in zip(rows, known) if lang != "und" and (n < 48 or score >= 2 / langid.DIMS**0.5)]
    assert not {900, 901, 902, 905} & {r[0] for r in rows} and {904, 906} <= {r[0] for r in rows}
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    rows = list(first.values())
    known, _ = brute_components([(r[0], r[1]) for r in rows], 5, 80, 100)
    heads = {i for i, _, c in known if i == c}
    rows = [r for r in rows if r[0] in heads]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].encode().split())
    target = filled(sizes)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for r in rows:
        rate = target[r[3]] / sizes[r[3]]
        u = int(hashlib.md5(f"{mix.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        ids = tok.encode(r[1], add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        copies = int(rate) + (u < rate - int(rate))
        if copies:
            out[r[0], len(ids), digest(np.array(ids, "<u4").tobytes()), digest(tok.decode(ids, skip_special_tokens=False).encode())] += copies
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_run_matches_brute_force(spark, tmp_path, seed):
    rows = documents(seed)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_without_any_language_all_texts_stay(spark):
    rows = [(1, "some text", None), (2, "漢字", None), (3, "12", None), (4, None, None), (None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.language_id(spark, df, "").collect()) == [0, 1, 2]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(documents(3), "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5
