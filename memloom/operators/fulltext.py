"""Full-text search: an inverted index, BM25 over prefix terms, substring tiers and snippets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.shared import cut

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """``doc_id, token, tf, n_tokens``: the index over all given columns of a row."""
    every = F.concat(*(tokens(F.col(c)) for c in text_cols))
    rows = docs.select(F.col(id_col).alias("doc_id"), every.alias("t")).withColumn("n_tokens", F.size("t"))
    return rows.select("doc_id", "n_tokens", F.explode("t").alias("token")).groupBy("doc_id", "n_tokens", "token").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str, least: int = 2) -> DataFrame:
    """``query_id, term``: each query's distinct terms of ``least`` characters or more."""
    parts = F.array_distinct(F.filter(tokens(F.col(text_col)), lambda t: F.length(t) >= least))
    return queries.select(F.col(id_col).alias("query_id"), F.explode(parts).alias("term"))


#: Query terms that may be broadcast, after counting them.
MOST_TERMS = 100_000
#: Numbers that a table of a block of texts, or of documents, and their terms may have: 16 MB.
CELLS = 1 << 21


def _begin(tokens_of: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows of ``token`` with its beginnings of these lengths as ``term``."""
    starts = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("token")) if lengths else F.array().cast("array<int>")
    return tokens_of.select("*", F.explode(starts).alias("n")).withColumn("term", F.substring(F.col("token"), F.lit(1), F.col("n")))


def _matches(tokens_of: DataFrame, terms: DataFrame, *more: str) -> DataFrame:
    """Rows of ``token`` and ``more`` columns joined with the distinct ``term`` that each token begins with.

    A token meets terms by its beginnings of the lengths that terms have, so the join is
    on whole terms: a frequent beginning is no hot key unless it is a term.
    """
    asked = terms.select("term").distinct()
    lengths = asked.agg(F.sort_array(F.collect_set(F.length("term")))).first()[0]  # as many as terms have lengths
    return _begin(tokens_of, lengths).join(asked, "term").select("term", *more)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "id", doc_texts: tuple[str, ...] = ("text",), query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """``query_id, rank, doc_id, score``: any-term prefix search, best first; scores are positive."""
    every = F.concat(*(tokens(F.col(c)) for c in doc_texts))
    rows = docs.select(F.col(doc_id).alias("doc_id"), every.alias("t")).withColumn("n_tokens", F.size("t"))
    # All tokens are counted without being made.
    n_tokens = sum(F.coalesce(F.regexp_count(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}]+")), F.lit(0)) for c in doc_texts)
    whole = docs.agg(F.sum(n_tokens).alias("all"), F.count(F.lit(1)).alias("n"))
    return _best(rows.select("doc_id", "n_tokens", F.explode("t").alias("token"), F.lit(1).alias("tf")), _texts(queries, query_id, query_text), whole, k)


def _texts(queries: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``query_id, text_no`` of the queries, and ``text_no, text``: those with one text are one search."""
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    texts = cut(asked.select("text").distinct().select(F.monotonically_increasing_id().alias("text_no"), "text"), "asked")
    return asked.join(texts, "text").select("query_id", "text_no"), texts


def _best(tokens_of: DataFrame, asked: tuple[DataFrame, DataFrame], whole: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query, from ``doc_id, n_tokens, token, tf``, the ``_texts`` of queries and the one row ``all, n``."""
    of, texts = asked
    terms = query_terms(texts, "text_no", "text")
    held = terms.limit(MOST_TERMS + 1).collect()
    if len(held) > MOST_TERMS:
        hits = _matches(tokens_of, terms, "doc_id", "n_tokens", "tf").groupBy("term", "doc_id", "n_tokens").agg(F.sum("tf").alias("f"))
        found = _ranked(terms, hits, whole, k)
    else:
        found = _scored(tokens_of, [tuple(r) for r in held], whole, k)
    return of.join(found.withColumnRenamed("query_id", "text_no"), "text_no").select("query_id", "rank", "doc_id", "score")


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    """Rows ``document's place, term, n_tokens, f`` of a batch ``doc_id, hits``, each term of a document once."""
    lists = batch.column(1)
    of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    no, size, tf = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
    by = np.lexsort((size, no, of))
    rows = np.stack([of, no, size, tf])[:, by]
    head = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])[: len(by)])
    return np.concatenate([rows[:3, head], np.add.reduceat(rows[3], head)[None, :]]) if len(head) else rows


def _blocks(asked: list[tuple[int, str]], no: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in blocks of bounded tables: the numbers of their texts, of their terms, and which text has which."""
    own: dict[int, list[int]] = {}
    for text, term in asked:
        own.setdefault(text, []).append(no[term])
    out, some, wide = [], [], 0
    for text in [*sorted(own), None]:
        more = len(own[text]) if text is not None else 0
        if some and (text is None or (len(some) + 1) * (wide + more) > CELLS or wide + more > CELLS // 128):
            of = np.unique(np.concatenate([own[x] for x in some]))
            has = np.zeros((len(of), len(some)))
            for i, x in enumerate(some):
                has[np.searchsorted(of, own[x]), i] = 1
            out.append((np.array(some), of, has))
            some, wide = [], 0
        if text is not None:
            some, wide = [*some, text], wide + more
    return out


def _scored(tokens_of: DataFrame, asked: list[tuple[int, str]], whole: DataFrame, k: int) -> DataFrame:
    """The k best documents of each text of ``asked`` (``MOST_TERMS`` rows ``text_no, term`` at most).

    A document's hits lie in one row. A task scores a block of documents against a block of
    texts as a product of matrices, and only the k best of each text leave it, so no table
    of texts times documents is made.
    """
    spark, kind = tokens_of.sparkSession, dict(tokens_of.dtypes)["doc_id"]
    no = {t: i for i, t in enumerate(sorted({t for _, t in asked}))}
    known = F.broadcast(spark.createDataFrame(list(no.items()), "term string, no int"))
    met = _begin(tokens_of, sorted({len(t) for t in no})).join(known, "term")
    hit = F.struct("no", F.col("n_tokens").cast("int").alias("n_tokens"), F.col("tf").cast("int").alias("f"))
    hits = cut(met.groupBy("doc_id").agg(F.collect_list(hit).alias("hits")), "hits")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(no), np.int64)
        for batch in batches:
            total += np.bincount(_counts(batch)[1], minlength=len(no))
        yield pa.record_batch([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], names=["no", "df"])

    df = np.zeros(len(no))
    for r in hits.mapInArrow(count, "no int, df long").groupBy("no").agg(F.sum("df").alias("df")).collect():  # as many as terms
        df[r["no"]] = r["df"]
    every, n = whole.select("all", "n").first()
    mean = (every or 0) / max(n, 1)
    idf = np.log((n - df + 0.5) / (df + 0.5))
    sent = spark.sparkContext.broadcast((np.where(idf <= 0, 1e-6, idf), _blocks(asked, no)))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, blocks = sent.value
        for batch in batches:
            of, term, size, f = _counts(batch)
            part = weight[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))
            order = pc.rank(batch.column(0), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            for texts, own, has in blocks:
                at = np.minimum(np.searchsorted(own, term), len(own) - 1)
                mine = np.flatnonzero(own[at] == term)
                step = max(1, CELLS // max(len(own), len(texts)))
                for a in range(0, batch.num_rows, step):
                    some = mine[np.searchsorted(of[mine], a) : np.searchsorted(of[mine], a + step)]
                    table = np.zeros((min(step, batch.num_rows - a), len(own)))
                    np.add.at(table, (of[some] - a, at[some]), part[some])
                    s = (table @ has).T  # parts are positive, so what is met is above 0
                    s = np.where(s > 0, np.round(s, 6), -1.0)
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else 0.0
                    text, doc = np.nonzero((s >= least) & (s >= 0))
                    by = np.lexsort((order[a + doc], -s[text, doc], text))
                    text, doc = text[by], doc[by]
                    first = np.searchsorted(text, text)
                    best = np.arange(len(text)) - first < k
                    text, doc = text[best], doc[best]
                    yield pa.record_batch([pa.array(texts[text]), batch.column(0).take(pa.array(a + doc)), pa.array(s[text, doc])], names=["query_id", "doc_id", "score"])

    found = hits.mapInArrow(score, f"query_id long, doc_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _ranked(terms: DataFrame, hits: DataFrame, whole: DataFrame, k: int) -> DataFrame:
    """``_scored`` by joins, for terms of any number: from ``term, doc_id, n_tokens, f`` and the one row ``all, n``."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.crossJoin(F.broadcast(whole)).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), (F.col("all") / F.col("n")).alias("mean"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    scored = terms.join(hits.join(df, "term").select("term", "doc_id", part.alias("part")), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


# A stored index: postings by the hash of a token's first two characters, documents with their lengths.

HEADS = 64


def head(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(c, 1, 2)), F.lit(HEADS)).cast("int")


def build_index(docs: DataFrame, path: str, id_col: str = "id", *text_cols: str) -> None:
    """Write the index of ``docs``: a search reads only the folders that its terms can be in."""
    index = postings(docs, id_col, *text_cols)
    # Sorted within a folder, so that row groups of other tokens are skipped by their bounds.
    index.withColumn("head", head(F.col("token"))).repartition("head", F.pmod(F.xxhash64("token"), F.lit(16))).sortWithinPartitions("head", "token").write.mode("overwrite").partitionBy("head").parquet(f"{path}/postings")
    every = F.concat(*(tokens(F.col(c)) for c in text_cols))
    docs.select(F.col(id_col).alias("doc_id"), F.size(every).alias("n_tokens")).write.mode("overwrite").parquet(f"{path}/documents")


def check_index(docs: DataFrame, path: str, id_col: str = "id") -> DataFrame:
    """One row ``documents, indexed, missing, stray``: an index is whole when the last two are 0."""
    have, held = docs.select(F.col(id_col).alias("doc_id")), docs.sparkSession.read.parquet(f"{path}/documents").select("doc_id")
    counts = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((have, "documents"), (held, "indexed"), (have.join(held, "doc_id", "left_anti"), "missing"), (held.join(have, "doc_id", "left_anti"), "stray"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])  # one row each


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """``bm25`` by a stored index: only postings that begin like a term are read."""
    asked = _texts(queries, query_id, query_text)
    terms = query_terms(asked[1], "text_no", "text")
    found = terms.select("term").distinct().limit(MOST_TERMS + 1).collect()
    index = spark.read.parquet(f"{path}/postings")
    if len(found) <= MOST_TERMS:
        heads = terms.select(head(F.col("term")).alias("head")).distinct().collect()  # HEADS at most
        index = index.filter(F.col("head").isin([r["head"] for r in heads]))
        if len(found) <= 200:  # few terms: the scan itself is bounded by them
            index = index.filter(reduce(lambda a, b: a | b, (F.col("token").startswith(r["term"]) for r in found), F.lit(False)))
    whole = spark.read.parquet(f"{path}/documents").agg(F.sum("n_tokens").alias("all"), F.count(F.lit(1)).alias("n"))
    return _best(index.select("doc_id", "n_tokens", "token", "tf"), asked, whole, k)


def snippet(text: Column, terms: Column, most: int = 40, mark: tuple[str, str] = ("<b>", "</b>")) -> Column:
    """Up to ``most`` words around the first match, with words that begin with a term marked."""
    words = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")
    hit = lambda w: F.exists(terms, lambda t: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+", "").startswith(t))
    first = F.coalesce(F.array_position(F.transform(words, hit), F.lit(True)), F.lit(1))
    start = F.greatest(F.lit(1), F.least(first - most // 4, F.size(words) - most + 1)).cast("int")
    return F.array_join(F.transform(F.slice(words, start, F.lit(most)), lambda w: F.when(hit(w), F.concat(F.lit(mark[0]), w, F.lit(mark[1]))).otherwise(w)), " ")


def _best_tier(rows: DataFrame, tier: Column, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of the first tier that has any, with its number, from one scan and one top-k."""
    top = rows.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", *order).limit(k)
    # At most k rows are left to look at together.
    best = top.withColumn("tier", F.struct("tier", F.min("tier").over(Window.partitionBy(F.lit(1))).alias("first")))
    return best.filter("tier.tier = tier.first").withColumn("tier", F.col("tier.tier")).orderBy(*order)


def tiered_search(notes: DataFrame, query: str, columns: tuple[str, ...], normal, order: list[Column], k: int = 50, where: Column | None = None) -> DataFrame:
    """Notes by whole words, else by substrings of three characters or more, else by the raw query; both sides normalised for the first two.

    Whole words are a part of the text with none of their letters beside it, so one pass
    of a pattern tells them, and no text is taken apart.
    """
    rows = notes if where is None else notes.filter(where)
    asked = normal(F.lit(query))
    spoken = rows.sparkSession.range(1).select(F.array_distinct(F.filter(F.split(F.lower(asked), " "), lambda w: w != ""))).first()[0]  # the query's own words
    text = F.lower(F.concat_ws(" ", *(normal(F.col(c)) for c in columns)))
    plain = [w for w in spoken if w == "".join(c for c in w if c.isalnum())]
    part = [w for w in spoken if len(w) >= 3]
    held = lambda t, words: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words), F.lit(False))
    alone = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, plain))})(?![\p{{L}}\p{{N}}])"
    by_word = lambda t: held(t, plain) & t.rlike(alone) if plain else F.lit(False)
    raw = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(query))), F.lit(False)) for c in columns))
    tier = F.element_at(F.transform(F.array(text), lambda t: F.when(by_word(t), 1).when(held(t, part), 2)), 1)
    return _best_tier(rows, F.coalesce(tier, F.when(raw, 3)), order, k)


def phrase_search(messages: DataFrame, query: str, text_col: str, normal, order: list[Column], k: int = 5) -> DataFrame:
    """Messages with the whole phrase, else with all of its words, newest first."""
    asked, text = normal(F.lit(query)), normal(F.col(text_col))
    words = F.split(asked, r"(?U)\s+")
    both = F.element_at(F.transform(F.array(text), lambda t: F.when(F.contains(t, asked), 1).when((F.size(words) > 1) & F.forall(words, lambda w: F.contains(t, w)), 2)), 1)
    return _best_tier(messages, both, order, k)
