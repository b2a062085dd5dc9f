"""Whole queries as one plan: unified search, prefetch of a context, graph search and indexing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions.models import embed
from memloom.functions.split import split_documents
from memloom.functions.text import clean_chunk, detect_type, norm_query, normalize_whitespace, passes_gate
from memloom.operators import fulltext, graph, rank, similarity
from memloom.shared import cut, first_rows
from memloom.sources.files import load_directory, save_graph


@dataclass
class Memory:
    """The tables that queries read: facts with vectors, directed relations, messages with times."""

    facts: DataFrame  # id, full_key, category, embedding, valid_to, created_at
    relations: DataFrame  # from_id, to_id, kind, weight
    messages: DataFrame  # id, session_id, role, content, timestamp


def fact_hits(memory: Memory, queries: DataFrame, k: int, least: float, max_age_days: float | None = None, as_of: Column | None = None) -> DataFrame:
    """``query_id, place, id, similarity, content`` of live facts by vector, for queries with ``embedding``."""
    facts = memory.facts.filter(F.col("valid_to").isNull())
    if max_age_days is not None:
        facts = facts.filter(rank.seconds(as_of) - rank.seconds(F.col("created_at")) <= max_age_days * 86400)
    near = similarity.nearest(queries.select(F.col("query_id").alias("id"), "embedding"), facts, k, least, own_too=True)
    hits = near.join(facts.select("id", clean_chunk("full_key").alias("content")), "id").filter("content <> ''")
    return hits.select("query_id", F.col("rank").alias("place"), "id", "similarity", "content")


def one_hop(memory: Memory, hits: DataFrame, queries: DataFrame, kind: str = "similar", seeds: int = 2, each: int = 2, least: float = 0.5) -> DataFrame:
    """Neighbours of each query's best facts, scored against the query, where it has two hits or more."""
    from memloom.functions.vectors import cosine

    live = memory.facts.filter(F.col("valid_to").isNull())
    links = memory.relations.filter(F.col("kind") == kind).join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    many = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("query_id")
    links = first_rows(links, [F.col("from_id")], [F.desc("weight"), F.col("to_id")], each)
    found = hits.filter(F.col("place") <= seeds).join(many, "query_id", "left_semi").join(links, F.col("id") == F.col("from_id")).select("query_id", F.col("to_id").alias("id")).distinct()
    found = found.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").join(live.select("id", "full_key", "embedding"), "id")
    scored = found.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("_q")), 12))
    return scored.withColumn("content", clean_chunk("full_key")).filter((F.col("similarity") >= least) & (F.col("content") != "")).select("query_id", "id", "similarity", "content")


def message_hits(memory: Memory, queries: DataFrame, k: int = 5, as_of: Column | None = None, max_age_days: float = 7) -> DataFrame:
    """``query_id, place, content, timestamp``: full-text hits without echoes. Places count before the filters."""
    rows = memory.messages.filter(F.col("role").isin("user", "assistant"))
    asked = queries.select("query_id", "query", *(c for c in ("session_id",) if c in queries.columns))
    found = fulltext.bm25(rows, asked, k, doc_id="id", doc_texts=("content",))
    hits = found.join(rows.select(F.col("id").alias("doc_id"), F.col("content").alias("raw"), "timestamp", F.col("session_id").alias("_s")), "doc_id").join(asked, "query_id")
    if "session_id" in asked.columns:
        hits = hits.filter(~F.col("_s").eqNullSafe(F.col("session_id")) | F.col("session_id").isNull())
    if as_of is not None:
        hits = hits.filter(rank.in_window(F.col("timestamp"), as_of, max_age_days))
    hits = hits.filter(~rank.is_echo(F.col("raw"), F.col("query"))).withColumn("content", clean_chunk("raw"))
    return hits.filter("content <> ''").select("query_id", F.col("rank").alias("place"), "content", "timestamp")


def asked(queries: DataFrame, least: int, letters: bool = True) -> DataFrame:
    """Queries that pass the gate, normalised and embedded unless they bring a vector."""
    rows = queries.filter(passes_gate("query", least) if letters else passes_gate("query", least, None))
    return rows if "embedding" in rows.columns else embed(rows, norm_query("query"))


def prefetch(memory: Memory, queries: DataFrame, as_of: Column, k: int = 2, least: float = 0.5, rate: float = 0.0, max_age_days: float | None = None) -> DataFrame:
    """``query_id, content, rrf_score, rank, type, project, expanded, timestamp, similarity``: facts, their neighbours and messages, fused by rank."""
    q = asked(queries, 3)
    hits = fact_hits(memory, q, k * 3, least, max_age_days if max_age_days is not None else 30, as_of)
    facts = hits.select("query_id", "similarity", "content", "id", F.lit(False).alias("expanded")).unionByName(one_hop(memory, hits, q, least=least).select("query_id", "similarity", "content", "id", F.lit(True).alias("expanded")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    facts = facts.withColumn("rank", best).filter(F.col("rank") <= k)
    texts = message_hits(memory, q, as_of=as_of, max_age_days=max_age_days if max_age_days is not None else 7)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    texts = texts.withColumn("rank", order).withColumn("similarity", rank.place_score(F.col("place") - 1, 0.75))
    fused = rank.rrf(facts, texts, ts="timestamp", as_of=as_of, rate=rate)
    told = facts.select("query_id", "content", F.lit(0).alias("_l"), "rank", F.lit("fact").alias("type"), F.lit("facts").alias("project"), "expanded", F.lit(None).cast("timestamp").alias("timestamp"), "similarity")
    told = told.unionByName(texts.select("query_id", "content", F.lit(1).alias("_l"), "rank", F.lit("session").alias("type"), F.lit("sessions").alias("project"), F.lit(False).alias("expanded"), "timestamp", "similarity"))
    told = rank.keep_first(told.withColumn("_c", F.col("content")), "_c", ["_l", "rank"], ["query_id"]).drop("_l", "rank", "_c")
    return fused.join(told, ["query_id", "content"])


def context(memory: Memory, queries: DataFrame, as_of: Column, **how) -> DataFrame:
    """``query_id, context``: the best five of ``prefetch`` as text."""
    return rank.render(prefetch(memory, queries, as_of, **how), as_of)


def unified_search(memory: Memory, queries: DataFrame, limit: int = 5, least: float = 0.5, agent: str | None = None) -> DataFrame:
    """``query_id, rank, content, similarity, type``: facts by vector and messages by place, the first of equal contents."""
    q = asked(queries, 2)
    facts = fact_hits(memory, q, limit * 3, least).select("query_id", "content", "similarity", F.lit("fact").alias("type"), F.col("place"), F.lit(0).alias("_l"))
    texts = message_hits(memory, q, limit).select("query_id", "content", rank.place_score(F.col("place") - 1, 0.70).alias("similarity"), F.lit("session").alias("type"), "place", F.lit(1).alias("_l"))
    rows = rank.keep_first(facts.unionByName(texts), "content", ["_l", "place"], ["query_id"])
    if agent not in (None, "all", "*"):
        rows = rows.withColumn("agent_id", F.lit(agent))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "_l", "place"))
    return rows.withColumn("rank", best).filter(F.col("rank") <= limit).drop("_l", "place")


def graph_search(memory: Memory, queries: DataFrame, limit: int = 10, least: float = 0.5, texts: int = 3, seeds: int = 3) -> DataFrame:
    """``query_id, rank, id, content, similarity, total``: facts by vector, by text at 0.6, and neighbours at their edge's weight; ``total`` counts before the cut."""
    q = asked(queries, 2)
    live = memory.facts.filter(F.col("valid_to").isNull())
    hits = fact_hits(memory, q, limit, least)
    by_text = fulltext.bm25(live, q.select("query_id", "query"), texts, doc_id="id", doc_texts=("full_key", "category")).select("query_id", F.col("doc_id").alias("id"), F.lit(0.6).alias("similarity"), F.lit(1).alias("_l"))
    near = hits.filter(F.col("place") <= seeds).join(memory.relations, F.col("id") == F.col("from_id")).groupBy("query_id", F.col("to_id").alias("id")).agg(F.max("weight").alias("similarity")).withColumn("_l", F.lit(2))
    rows = hits.select("query_id", "id", "similarity", F.lit(0).alias("_l")).unionByName(by_text).unionByName(near)
    rows = first_rows(rows, [F.col("query_id"), F.col("id")], [F.col("_l")]).join(live.select("id", clean_chunk("full_key").alias("content")), "id")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "_l", "id"))
    whole = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return rows.select("query_id", best.alias("rank"), "id", "content", "similarity", whole.alias("total")).filter(F.col("rank") <= limit)


def graph_index(spark: SparkSession, path: str, store: str, project: str, k: int = 10, least: float = 0.7, size: int = 512, overlap: int = 96, communities: str = "leiden", **how) -> DataFrame:
    """Reads a directory, splits, embeds, links and divides it, saves the graph, and returns its statistics."""
    docs = load_directory(spark, path, **how)
    chunks = split_documents(docs, "source", "text", size, overlap)
    nodes = chunks.select(F.xxhash64("doc_id", "chunk_no").alias("id"), F.concat_ws("#", "doc_id", F.col("chunk_no").cast("string")).alias("node"), F.col("chunk").alias("content"), detect_type("chunk").alias("type"), F.create_map(F.lit("source"), F.col("doc_id")).alias("metadata"))
    nodes = embed(nodes, F.when(F.col("type") == "arabic", norm_query("content")).otherwise(normalize_whitespace("content")))
    nodes = cut(nodes, "index-nodes")
    edges = cut(graph.knn_edges(nodes, k, least), "index-edges")
    divide = {"leiden": graph.leiden, "louvain": graph.louvain, "components": graph.connected}[communities]
    member = cut(divide(nodes, edges), "index-communities")
    save_graph(store, project, nodes, edges, member)
    return graph.stats(nodes, edges).crossJoin(member.agg(F.countDistinct("community").alias("communities"))).crossJoin(graph.modularity(edges, member))  # one row each
