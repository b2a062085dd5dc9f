"""One question at a time to a memory that is kept warm: a handful of small jobs, with the answer of ``search.unified_search``.

Facts with their cleaned contents and the postings of messages stay in the executors' memory (and on
their disks, where memory ends), made once and used by all questions. A question's vector and terms are
literals, so nothing is joined and nothing is embedded in a worker: the closest facts are one pass with a
top k; the postings that begin like its terms are grouped by message twice, first to count messages a
term, then to score them; and the few best messages are looked up by their ids.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions.models import Embedder, hashed_embedder
from memloom.functions.text import clean_chunk, norm_query, passes_gate
from memloom.operators import fulltext, rank, similarity
from memloom.plans.search import Memory, unified_search

#: Terms that one pass may look for; a question with more is a plan of its own.
MOST_TERMS = 32


class Warm:
    """A memory's live facts and messages, ready for questions. ``close`` lets go of them."""

    def __init__(self, memory: Memory, embedder: Embedder | None = None):
        self.memory, self.embedder = memory, embedder or hashed_embedder()
        said = memory.messages.filter(F.col("role").isin("user", "assistant"))
        self.facts = memory.facts.filter("valid_to IS NULL").select("id", "embedding", clean_chunk("full_key").alias("content")).cache()
        self.said = said.select("id", F.col("content").alias("raw"), clean_chunk("content").alias("content")).cache()
        # In the order of tokens, so that whole batches of others are skipped by their bounds.
        self.postings = fulltext.postings(said, "id", "content").sortWithinPartitions("token").cache()
        words, self.n = said.agg(F.sum(F.size(fulltext.tokens(F.col("content")))), F.count(F.lit(1))).first()
        self.mean = (words or 0) / self.n if self.n else 0.0

    def close(self) -> None:
        for df in (self.facts, self.said, self.postings):
            df.unpersist()

    def near_facts(self, vector: list[float], k: int, least: float) -> list[dict]:
        best = similarity.close_to(self.facts, vector, least).orderBy(F.desc("similarity"), "id").limit(k)
        return [{"content": r["content"], "similarity": r["similarity"], "type": "fact", "place": i + 1} for i, r in enumerate(best.select("content", "similarity").collect()) if r["content"]]

    def said_of(self, query: str, terms: list[str], k: int) -> list[dict]:
        """The k best messages by BM25, without echoes."""
        begins = [F.col("token").startswith(t) for t in terms]
        found = self.postings.filter(reduce(lambda a, b: a | b, begins)).groupBy("doc_id", "n_tokens").agg(*(F.sum(F.when(b, F.col("tf"))).alias(f"f{i}") for i, b in enumerate(begins)))
        many = found.agg(*(F.count(f"f{i}") for i in range(len(terms)))).first()
        if not any(many):
            return []
        idf = [math.log((self.n - df + 0.5) / (df + 0.5)) for df in many]
        size = fulltext.K1 * (1 - fulltext.B + fulltext.B * F.col("n_tokens") / F.lit(self.mean))
        parts = [F.coalesce(F.lit(w if w > 0 else 1e-6) * F.col(f"f{i}") * (fulltext.K1 + 1) / (F.col(f"f{i}") + size), F.lit(0.0)) for i, w in enumerate(idf)]
        best = found.select("doc_id", F.round(reduce(lambda a, b: a + b, parts), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k).collect()
        place = {r["doc_id"]: i + 1 for i, r in enumerate(best)}
        kept = self.said.filter(F.col("id").isin(list(place)) & ~rank.is_echo(F.col("raw"), F.lit(query)) & (F.col("content") != "")).collect()
        return [{"content": r["content"], "similarity": 0.70 - 0.03 * (place[r["id"]] - 1), "type": "session", "place": place[r["id"]]} for r in sorted(kept, key=lambda r: place[r["id"]])]

    def ask(self, question: DataFrame, limit: int, least: float) -> list[dict]:
        """``similarity, content, type`` of the best hits of a question of one row (``query_id, query``), best first."""
        # Of a local row, so no job.
        terms = F.array_distinct(F.filter(fulltext.tokens(F.col("query")), lambda t: F.length(t) >= 2))
        q = question.select("query", norm_query("query").alias("normal"), terms.alias("terms"), passes_gate("query", 2).alias("good")).first()
        if not q["good"]:
            return []
        if len(q["terms"]) > MOST_TERMS:
            return [r.asDict() for r in unified_search(self.memory, question, limit, least).orderBy("rank").select("similarity", "content", "type").collect()]
        vector = self.embedder([q["normal"]])[0].tolist()
        rows, seen = [], set()
        for level, hits in enumerate((self.near_facts(vector, limit * 3, least), self.said_of(q["query"], q["terms"], limit) if q["terms"] else [])):
            for r in hits:
                if r["content"] not in seen:
                    seen.add(r["content"])
                    rows.append((-round(r["similarity"], 12), level, r["place"], r))
        return [{c: r[c] for c in ("similarity", "content", "type")} for *_, r in sorted(rows, key=lambda x: x[:3])[:limit]]
