"""Queries that write files, tables or logs and read them again, and those of single operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom import catalog as c
from memloom import fixtures as fx
from memloom import schema
from memloom.functions import gates, models, text, vectors
from memloom.operators import graph, lifecycle, rank, similarity, store, summaries
from memloom.plans import projects, tools
from memloom.registry import folder, query
from memloom.shared import cut, dealt, drop, names, table
from memloom.sources import files
from memloom.streaming import incremental

_HASH = c._HASH
_RULES = f"rules AS ({c._junk_sql('documents')})"


# Directories and files


@query("SELECT item_id, md5(text || chr(10)) AS digest FROM benchmark WHERE item_id % 3 <> 0")
def directory_scan(spark, sf):
    """Benchmark texts as files of a directory; every third lies in a folder that is excluded."""
    path, b = folder(spark, "directory"), table(spark, sf, "benchmark").select("text", "item_id")
    for sub, rows in (("notes", b.filter("item_id % 3 <> 0")), ("build", b.filter("item_id % 3 = 0"))):
        rows.write.partitionBy("item_id").text(f"{path}/{sub}")
    out = files.load_directory(spark, path)
    return out.select(F.regexp_extract("source", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), F.md5("text").alias("digest"))


@query("SELECT md5(string_agg(text || chr(10), '' ORDER BY item_id)) AS digest FROM benchmark")
def single_file(spark, sf):
    """All benchmark texts as the lines of one file."""
    path = folder(spark, "file")
    table(spark, sf, "benchmark").repartition(1).sortWithinPartitions("item_id").select("text").write.text(path)
    name = next(n for n in names(spark, path) if n.endswith(".txt"))
    return files.load_file(spark, f"{path}/{name}").select(F.md5("text").alias("digest"))


def _fact_files(spark: SparkSession, sf: str) -> str:
    """Documents as facts in JSON lines, a folder a category, in two appends."""
    path, d = folder(spark, "facts"), table(spark, sf, "documents")
    rows = d.select("doc_id", F.col("text").alias("key"), F.col("lang").alias("category"), F.lit("s").alias("session_id"), F.lit("2024-01-01").alias("extracted_at"), F.lit(1).alias("importance"), "source")
    for part in (rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")):
        files.append_facts(part.drop("doc_id"), path)
    return path


@query(f"WITH {_RULES} SELECT md5(text) AS digest, lang AS category, {_HASH} AS fact_hash FROM documents JOIN rules USING (doc_id) WHERE rule IS NULL AND {_HASH} NOT IN (SELECT {_HASH} FROM documents JOIN labels USING (doc_id))")
def fact_files(spark, sf):
    """Facts of files that pass the gates and are not known yet."""
    known = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select(text.fact_hash("text").alias("fact_hash"))
    return files.read_facts(spark, _fact_files(spark, sf), known).select(F.md5("key").alias("digest"), "category", "fact_hash")


@query("SELECT DISTINCT md5(text) AS digest FROM documents WHERE text <> ''")
def fact_keys(spark, sf):
    """Every key of the files, junk or not."""
    return files.all_keys(spark, _fact_files(spark, sf)).select(F.md5("key").alias("digest"))


@query("WITH " + c._PAIRS + """, n AS (SELECT count(*) AS a, count(*) FILTER (label % 2 = 0) AS b, count(DISTINCT label) AS l FROM v),
e AS (SELECT count(*) FILTER (weight >= 0.33) AS a, count(*) FILTER (weight >= 0.33 AND weight < 0.35) AS b FROM p) SELECT 'one' AS project, n.a AS nodes, e.a AS edges, n.l AS communities FROM n, e UNION ALL SELECT 'two', n.b, e.b, n.l FROM n, e""")
def graph_store(spark, sf):
    """Projects that are saved, saved again with rebuilt edges, listed, loaded and deleted."""
    path, v = folder(spark, "graphs"), fx.vectors(spark, sf)
    nodes = v.select(F.col("id").alias("node"), "label", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    edges, member = cut(similarity.similar_pairs(v, 0.33), "edges"), v.select(F.col("id").alias("node"), F.col("label").alias("community"))
    for name in ("one", "three", "two"):
        files.save_graph(path, name, nodes, edges, member)
        if name == "three":
            files.delete_project(spark, path, name)
    drop(edges)  # each project has its own by now
    files.save_graph(path, "two", nodes.filter("label % 2 = 0"), graph.band_edges(v, 0.33, 0.35), member)
    out = []
    for r in files.list_projects(spark, path).collect():  # a handful of names
        n, e, m = files.load_graph(spark, path, r["project"])
        one = n.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(m.agg(F.countDistinct("community").alias("communities")))  # one row each
        out.append(one.select(F.lit(r["project"]).alias("project"), "nodes", "edges", "communities"))
    return out[0].unionByName(out[1])


@query("SELECT least('n' || vec_id, 'n' || (vec_id * 7 + 3) % 499) AS src, greatest('n' || vec_id, 'n' || (vec_id * 7 + 3) % 499) AS dst, 0.5::DOUBLE AS weight FROM embeddings")
def node_link(spark, sf):
    """Edges of node-link documents, one for each hundred nodes."""
    path = folder(spark, "node-link")
    v = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("block"), F.concat(F.lit("n"), "vec_id").alias("a"), F.concat(F.lit("n"), (F.col("vec_id") * 7 + 3) % 499).alias("b"))
    doc = v.groupBy("block").agg(F.collect_list(F.struct(F.col("a").alias("id"))).alias("nodes"), F.collect_list(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.lit(0.5).alias("weight"))).alias("links"))  # a hundred each
    doc.select("block", F.to_json(F.struct("nodes", "links")).alias("value")).write.partitionBy("block").text(path)
    return files.import_node_link(spark, path)[1].select("src", "dst", "weight")


@query("SELECT count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, 1 AS files FROM orders")
def compaction(spark, sf):
    """A table of many small files after it was compacted."""
    path = folder(spark, "many")
    table(spark, sf, "orders").select("o_orderkey").repartition(24).write.parquet(path)
    made = files.compact(spark, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")).withColumn("files", F.lit(made))


def _width(ddl: str) -> int:
    depth, n = 0, 1
    for x in ddl:
        depth += (x == "<") - (x == ">")
        n += x == "," and not depth
    return n


@query("SELECT name, columns, again, CASE name WHEN 'facts' THEN (SELECT count(*) FROM documents) WHEN 'relations' THEN (SELECT count(*) FROM lineitem) WHEN 'state' THEN (SELECT count(*) FROM orders) ELSE 0 END AS rows FROM (VALUES " + ", ".join(f"('{n.lower()}', {_width(getattr(schema, n))}, 0)" for n in schema.TABLES) + ") t(name, columns, again)")
def store_tables(spark, sf):
    """The tables of a new store, with their columns and the rows that were put into three of them; asked again, none is made."""
    path = folder(spark, "store")
    made = files.create_tables(spark, path)
    d, o = table(spark, sf, "documents"), table(spark, sf, "orders")
    rows = {
        "facts": d.select(F.col("doc_id").alias("id"), text.fact_hash("text").alias("fact_hash"), F.col("text").alias("full_key"), F.col("lang").alias("category"), "source"),
        "relations": fx.relations(spark, sf),
        "state": o.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").cast("timestamp").alias("updated_at")),
    }
    for name, df in rows.items():
        files.insert(df, path, name)
    again = len(files.create_tables(spark, path))
    out = None
    for name in made:  # the store's tables
        t = spark.read.parquet(f"{path}/{name}")
        one = t.agg(F.lit(name).alias("name"), F.lit(len(t.columns)).alias("columns"), F.lit(again).alias("again"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type = (SELECT min(event_type) FROM events) AS stop FROM events)
SELECT 'fact_invalidated' AS event_type, '{"fact_hash":"' || md5(user_id::VARCHAR) || '","superseded_by":' || event_id || '}' AS details, ts AS created_at FROM e WHERE stop""")
def audit_log(spark, sf):
    """One audit row for each event that ends a fact, appended and read again."""
    e, path = table(spark, sf, "events"), folder(spark, "audit")
    stop = F.broadcast(e.agg(F.min("event_type").alias("stop")))  # one row
    log = e.crossJoin(stop).select(F.col("user_id").cast("string").alias("full_key"), F.when(F.col("event_type") == F.col("stop"), "invalidate").otherwise("upsert").alias("op"), F.col("event_id").alias("superseded_by"), "ts")
    if not store.append_audit(store.audit(log), path):
        raise OSError("no audit rows were written")
    return spark.read.parquet(path)


# Look-ups, sets and the second store

_FACTS = "f AS (SELECT d.doc_id AS id, lang AS category, source AS session_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 0 WHERE l.doc_id IS NULL)"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as facts; those of bad quality have ended."""
    bad = table(spark, sf, "labels").filter("quality = 0").select("doc_id", fx.as_of().alias("valid_to"))
    return table(spark, sf, "documents").join(bad, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("session_id"), "valid_to")


@query(f"WITH {_FACTS} SELECT * FROM f WHERE id IN (0, 1, 2, 3, 5, 8, 13, 21, 34, 55)")
def fact_lookup(spark, sf):
    """Live facts by their ids."""
    return store.by_id(_facts(spark, sf), 0, 1, 2, 3, 5, 8, 13, 21, 34, 55).drop("valid_to")


@query(f"WITH {_FACTS} SELECT * FROM f WHERE session_id = 'src1'")
def session_facts(spark, sf):
    """Live facts of one session."""
    return store.by_session(_facts(spark, sf), "src1").drop("valid_to")


@query("""WITH s AS (SELECT doc_id, doc_id % 10 / 10.0 AS trust, lang FROM documents WHERE doc_id % 3 = 0), b AS (SELECT DISTINCT doc_id, n FROM s, (VALUES (0), (1)) x(k), LATERAL (SELECT (doc_id + k * 2) % 5 AS n)),
g AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT 'name' || n || ':kind' || n % 2)), ',') AS entities FROM b GROUP BY doc_id)
SELECT 'd' || d.doc_id AS full_key, coalesce(s.lang, 'general') AS category, s.trust::DOUBLE AS trust_score, coalesce(entities, '') AS entities FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)""")
def fact_enrichment(spark, sf):
    """Facts with trust, category and entities of the stored row with the same content; a third are stored."""
    d = table(spark, sf, "documents")
    facts = d.select(F.concat(F.lit("d"), "doc_id").alias("full_key"), F.lit("general").alias("category"))
    kept = d.filter("doc_id % 3 = 0")
    stored = kept.select(F.col("doc_id").alias("fact_id"), F.concat(F.lit("d"), "doc_id").alias("content"), (F.col("doc_id") % 10 / 10.0).alias("trust_score"), F.col("lang").alias("category"))
    bridge = kept.select(F.col("doc_id").alias("fact_id"), F.explode(F.array(F.col("doc_id") % 5, (F.col("doc_id") + 2) % 5)).alias("entity_id"))
    entities = spark.range(5).select(F.col("id").alias("entity_id"), F.concat(F.lit("name"), "id").alias("name"), F.concat(F.lit("kind"), F.col("id") % 2).alias("entity_type"))
    out = store.enriched(facts, stored, bridge, entities)
    told = F.array_join(F.transform(F.coalesce("entities", F.array()), lambda e: F.concat(e["name"], F.lit(":"), e["entity_type"])), ",")
    return out.select("full_key", "category", "trust_score", told.alias("entities"))


@query("""WITH k AS (SELECT 'c' || event_id % 50 AS content, max(event_id % 10 / 10.0) AS t FROM events WHERE event_id % 50 < 40 GROUP BY 1)
SELECT 'c' || i AS content, greatest(i % 5, coalesce(round_even(t * 5, 0), 0))::INTEGER AS importance, coalesce(t, 0.25)::DOUBLE AS trust FROM range(50) r(i) LEFT JOIN k ON content = 'c' || i""")
def node_trust(spark, sf):
    """Nodes that take over the stored trust, and importance where that says more."""
    nodes = spark.range(50).select(F.concat(F.lit("c"), "id").alias("content"), (F.col("id") % 5).cast("int").alias("importance"), F.lit(0.25).alias("trust"))
    stored = table(spark, sf, "events").filter("event_id % 50 < 40").select(F.concat(F.lit("c"), F.col("event_id") % 50).alias("content"), (F.col("event_id") % 10 / 10.0).alias("trust_score"))
    return store.with_trust(nodes, stored).select("content", "importance", "trust")


@query(f"""WITH d AS (SELECT doc_id, {_HASH} AS h FROM documents), k AS (SELECT h FROM d JOIN labels USING (doc_id)), g AS (SELECT h FROM d JOIN labels USING (doc_id) WHERE quality = 0)
SELECT min(doc_id) AS id, h AS fact_hash FROM d WHERE h NOT IN (SELECT h FROM k WHERE h NOT IN (SELECT h FROM g)) GROUP BY h""")
def forgotten_keys(spark, sf):
    """What counts as new once the keys of purged facts are forgotten."""
    d, labels = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("full_key")), table(spark, sf, "labels")
    hashes = lambda rows: d.join(rows, d["id"] == F.col("doc_id"), "left_semi").select(text.fact_hash("full_key").alias("fact_hash"))
    return store.not_yet_known(d, store.forgotten(hashes(labels), hashes(labels.filter("quality = 0")))).select("id", "fact_hash")


@query("""SELECT c_custkey AS key, 'old' AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL
SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey""")
def new_members(spark, sf):
    """Keys that a table lacks, the first row of each, beside its own."""
    old = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("old").alias("value"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"), "o_orderkey")
    return store.insert_or_ignore(old, new, ["key"], [F.col("o_orderkey")])


@query("SELECT vec_id, true AS close, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def vector_codec(spark, sf):
    """Vectors through half precision and back, and through JSON text."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", vectors.unpack_half(vectors.pack_half("embedding")).alias("half"))
    near = F.forall(F.zip_with("embedding", "half", lambda a, b: F.abs(a - b) <= F.abs(a) / 1024 + 1e-6), lambda x: x)
    return v.select("vec_id", near.alias("close"), F.round(vectors.norm(vectors.from_json(F.to_json("embedding"))), 6).alias("length"))


# Purges and migrations

_SENSITIVE = f"(regexp_matches(t, '^[A-Z_]{{3,}}$') OR (regexp_matches(t, '{gates.SENSITIVE}') AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) <= 5))"


@query(f"""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM {c._lit_sql()}), s AS (SELECT doc_id, {_SENSITIVE} AS s FROM t)
SELECT 'facts' AS kind, count(*) AS kept FROM s WHERE NOT s UNION ALL SELECT 'nodes', count(*) FROM s WHERE NOT s UNION ALL SELECT 'edges', count(*) FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 WHERE NOT a.s AND NOT b.s""")
def secret_purge(spark, sf):
    """Facts, nodes and edges after the names of secrets are gone."""
    t = c._texts(spark, sf)
    nodes = t.select(F.col("doc_id").alias("node"), F.col("text").alias("content"))
    edges = t.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst")).join(t.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    kept = files.without_secrets(t.select(F.coalesce("text", F.lit("")).alias("key")), nodes.withColumn("content", F.coalesce("content", F.lit(""))), edges)
    counts = [df.agg(F.lit(n).alias("kind"), F.count(F.lit(1)).alias("kept")) for n, df in zip(("facts", "nodes", "edges"), kept)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _old_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    nodes = d.select(F.concat(F.lit("d"), "doc_id").alias("node"), F.when(F.col("doc_id") % 10 == 0, "category").otherwise("fact").alias("type"), F.col("text").alias("content"), F.col("lang").alias("category"), (F.col("doc_id") % 5 + 1).cast("int").alias("importance"))
    edges = d.select(F.concat(F.lit("d"), "doc_id").alias("src"), F.concat(F.lit("d"), F.col("doc_id") + 1).alias("dst"), F.when(F.col("doc_id") % 4 == 0, "belongs_to").otherwise("similar").alias("type"), F.lit(0.5).alias("weight"))
    return nodes, edges


_MOVED = f"{_RULES}, f AS (SELECT doc_id, 'd' || doc_id AS node, lang AS category, (doc_id % 5 + 1)::INTEGER AS importance, {_HASH} AS fact_hash FROM documents JOIN rules USING (doc_id) WHERE rule IS NULL AND doc_id % 10 <> 0)"


@query(f"WITH {_MOVED} SELECT node, category, importance, fact_hash FROM f")
def migrated_facts(spark, sf):
    """Facts of a graph that move into the store: no junk and no categories."""
    return files.migrate_graph(*_old_graph(spark, sf))[0].drop("full_key")


@query(f"WITH {_MOVED} SELECT a.node AS from_node, b.node AS to_node, 'similar' AS kind, 0.5::DOUBLE AS weight FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 4 <> 0")
def migrated_relations(spark, sf):
    return files.migrate_graph(*_old_graph(spark, sf))[1].withColumn("weight", F.col("weight").cast("double"))


_OLDER = " UNION ".join(f"SELECT id, unnest(regexp_extract_all(t, '{p}', 1)) AS name, '{k}' AS type FROM d" for k, p in text.OLDER_ENTITIES)


@query(f"""WITH d AS (SELECT doc_id AS id, text AS t FROM {c._lit_sql()}), e AS (SELECT DISTINCT id, name, type FROM ({_OLDER}) WHERE length(name) >= 2
UNION SELECT unnest([doc_id, doc_id + 1]), 'relation:follows', 'relation' FROM documents WHERE doc_id % 7 = 0)
SELECT id AS fact_id, name, type FROM e""")
def migrated_entities(spark, sf):
    """Entities of facts in the trust store, and of relations as entities of their ends."""
    t = c._texts(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("full_key"), F.lit("c").alias("category"), F.lit(3).alias("importance"), F.array(F.lit("a"), F.lit("b")).alias("aliases"), F.lit(None).cast("timestamp").alias("created_at"))
    rel = table(spark, sf, "documents").filter("doc_id % 7 = 0").select(F.col("doc_id").alias("from_id"), (F.col("doc_id") + 1).alias("to_id"), F.lit("follows").alias("kind"))
    _, entity, bridge = files.migrate_store(t, rel)
    return bridge.join(entity, "entity_id").select("fact_id", "name", "type")


@query(f"SELECT doc_id AS id, md5({c._NF}) AS digest, [0.3, 0.5, 0.7, 0.85, 1.0][doc_id % 5 + 1]::DOUBLE AS trust_score, 'x' || doc_id || ',y' AS tags FROM documents")
def migrated_rows(spark, sf):
    """Rows of the trust store: importance becomes trust, aliases tags."""
    d = table(spark, sf, "documents")
    facts = d.select(F.col("doc_id").alias("id"), F.col("text").alias("full_key"), F.col("lang").alias("category"), (F.col("doc_id") % 5 + 1).cast("int").alias("importance"), F.array(F.concat(F.lit("x"), "doc_id"), F.lit("y")).alias("aliases"), F.lit(None).cast("timestamp").alias("created_at"))
    rows, _, _ = files.migrate_store(facts, spark.createDataFrame([], "from_id long, to_id long, kind string"))
    return rows.select("id", F.md5("content_normalized").alias("digest"), "trust_score", "tags")


# Gates and functions

_RATIO_OF = c._RATIO.format("t")
_SAYS = "trim(regexp_replace(t, '\\s+', ' ', 'g')) <> ''"


@query(f"""WITH r AS ({c._junk_sql()}), x AS (SELECT doc_id, coalesce(text, '') AS t FROM {c._lit_sql()}), g AS (SELECT *, {_SAYS} AND {_RATIO_OF} >= 0.1 AS part, {_SAYS} AND {_RATIO_OF} >= 0.5 AS heavy FROM x),
l AS (SELECT *, t <> '' AND (part OR NOT regexp_matches(t, '^[\\x00-\\x7F]*$')) AS arabic, t <> '' AND NOT heavy AS other FROM g)
SELECT doc_id, arabic, other, length(trim(t, ' ')) >= 15 AND rule IS NULL AND t <> '' AND NOT heavy AS storable FROM l JOIN r USING (doc_id)""")
def fact_gates(spark, sf):
    """Whether a fact fits an Arabic and another session, and may be stored for the latter."""
    t = c._texts(spark, sf)
    return t.select("doc_id", gates.language_fits("text", F.lit(True)).alias("arabic"), gates.language_fits("text", F.lit(False)).alias("other"), gates.storable("text", F.lit(False)).alias("storable"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'decision' WHEN event_id % 3 = 1 THEN 'general' ELSE 'general' END AS category FROM events")
def fact_categories(spark, sf):
    """Categories that are not known become general."""
    e = table(spark, sf, "events")
    return e.select("event_id", gates.category_of(F.when(F.col("event_id") % 3 == 0, "decision").when(F.col("event_id") % 3 == 1, F.col("event_type"))).alias("category"))


@query("SELECT item_id, CASE WHEN item_id % 5 = 4 THEN NULL ELSE item_id END AS a, CASE WHEN item_id % 5 = 4 THEN NULL ELSE 'x' END AS b FROM benchmark")
def json_repair(spark, sf):
    """Models' answers as JSON: plain, fenced, with talk around them, single quotes and trailing commas, or none."""
    forms = ['{"a": %d, "b": "x"}', '```json\n{"a": %d, "b": "x",}\n```', "Sure: {'a': %d, 'b': 'x'} as asked", "{“a”: %d, “b”: “x”}", "no answer %d"]
    answer = F.element_at(F.array(*(F.format_string(f, "item_id") for f in forms)), (F.col("item_id") % 5 + 1).cast("int"))
    got = table(spark, sf, "benchmark").select("item_id", models.parse_json(answer, "a long, b string").alias("x"))
    return got.select("item_id", "x.a", "x.b")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fixes' WHEN 1 THEN 'related' END AS kind, CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 END::DOUBLE AS confidence FROM events""")
def checked_relations(spark, sf):
    """A model's relations: unknown kinds become related, none and what is no JSON nothing."""
    forms = ['{"relation_type": "Fixes"}', '{"relation_type": "odd", "confidence": 0.25}', '{"relation_type": "none"}', "not json"]
    answer = F.element_at(F.array(*(F.lit(f) for f in forms)), (F.col("event_id") % 4 + 1).cast("int"))
    got = table(spark, sf, "events").select("event_id", gates.checked_relation(answer).alias("r"))
    return got.select("event_id", "r.kind", "r.confidence")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1700000000 + event_id WHEN 1 THEN floor(epoch(ts))::BIGINT ELSE 0 END AS seconds FROM events")
def parsed_times(spark, sf):
    """Times written as seconds, as ISO text, or not at all."""
    e = table(spark, sf, "events")
    told = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") + 1_700_000_000).cast("string")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return e.select("event_id", F.unix_seconds(text.parse_time(told, F.timestamp_seconds(F.lit(0)))).alias("seconds"))


@query("SELECT item_id, 1.0::DOUBLE AS length, true AS same FROM benchmark")
def embedded_texts(spark, sf):
    """Vectors of texts: of length 1, and the same for the same words."""
    b = table(spark, sf, "benchmark")
    out = models.embed(models.embed(b, F.col("text")), F.concat(F.lit("  "), "text", F.lit("\n")), "again")
    return out.select("item_id", F.round(vectors.norm(F.col("embedding")), 5).alias("length"), (F.col("embedding") == F.col("again")).alias("same"))


_SYNONYMS = {"the": ["which", "a", "these", "those"], "of": ["from", "by"]}


@query("""WITH w AS (SELECT item_id, text, list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '[؟!.,:;،؛]+$', '')) AS ws FROM benchmark),
m AS (SELECT *, list_sort(list_concat(CASE WHEN list_contains(ws, 'the') THEN ['which', 'these'] ELSE [] END, CASE WHEN list_contains(ws, 'of') THEN ['from'] ELSE [] END)) AS more FROM w)
SELECT item_id, CASE WHEN len(more) > 0 THEN text || ' ' || array_to_string(more, ' ') ELSE text END AS query FROM m""")
def expanded_queries(spark, sf):
    """Queries with up to three synonyms a word; short ones don't count."""
    return table(spark, sf, "benchmark").select("item_id", text.expand_query("text", _SYNONYMS).alias("query"))


@query("SELECT event_type AS agent_id, count(*) AS rows FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL")
def agent_rows(spark, sf):
    """How many rows one agent has."""
    e = table(spark, sf, "events").withColumnRenamed("event_type", "agent_id")
    first = e.agg(F.min("agent_id")).first()[0]
    return tools.agent_stats(tools.of_agent(tools.of_agent(e, "all"), first))


def _two_projects(spark: SparkSession, sf: str) -> str:
    """All vectors as the nodes of two projects, by the parity of their labels; the second is saved twice, at last without every seventh."""
    path, v = folder(spark, "projects"), fx.vectors(spark, sf)
    nodes = v.select(F.concat(F.lit("n"), "id").alias("node"), "id", F.col("full_key").alias("content"), F.lit("fact").alias("type"), "embedding", "label")
    edges = similarity.similar_pairs(v, 0.33).select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"), "weight")
    edges = cut(edges, "edges")  # saved three times, found once
    member = nodes.select("node", F.col("label").alias("community"))
    for name, some in (("one", "label % 2 = 0"), ("two", "label % 2 = 1"), ("two", "label % 2 = 1 AND id % 7 <> 0")):
        files.save_graph(path, name, nodes.filter(some), edges, member)
    return path


@query(f"""WITH {c._UNIT}, asks AS (SELECT *, 'n' || id AS node FROM v WHERE id % 50 = 0), nodes AS (SELECT *, 'n' || id AS node, CASE WHEN label % 2 = 0 THEN 'one' ELSE 'two' END AS project FROM v WHERE label % 2 = 0 OR id % 7 <> 0),
s AS (SELECT a.id AS query_id, b.project, b.node, {c._COS} AS similarity FROM asks a, nodes b WHERE {c._COS} >= 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY similarity DESC, node)::INTEGER AS rank, count(*) OVER (PARTITION BY query_id, project) AS total FROM s)
SELECT query_id, project, rank, node, round(similarity, 6) AS similarity, total, NULL::VARCHAR AS error FROM r WHERE rank <= 5
UNION ALL SELECT id, 'none', NULL, NULL, NULL, 0, 'No project: none' FROM asks""")
def project_search(spark, sf):
    """Every fiftieth vector asked in two stored projects and in one that isn't there."""
    v = fx.vectors(spark, sf).filter("id % 50 = 0")
    asked = v.select(F.col("id").alias("query_id"), "embedding", F.explode(F.array(*(F.lit(p) for p in ("one", "two", "none")))).alias("project"))
    out = projects.search(spark, _two_projects(spark, sf), asked, 5, 0.1)
    return out.select("query_id", "project", "rank", "node", F.round("similarity", 6).alias("similarity"), "total", "error")


@query(f"""WITH {c._UNIT}, s AS (SELECT 'n' || b.id AS node, {c._COS} AS similarity FROM v a, v b WHERE a.id = 0 AND b.label % 2 = 1 AND b.id % 7 <> 0)
SELECT row_number() OVER (ORDER BY similarity DESC, node)::INTEGER AS rank, node, round(similarity, 6) AS similarity FROM s QUALIFY rank <= 20""")
def sql_project_search(spark, sf):
    """A stored project asked in SQL, by a table function over all its nodes."""
    name = projects.sql_functions(spark, _two_projects(spark, sf), f"search_{uuid.uuid4().hex}")
    vector = ", ".join(f"{float(x)!r}D" for x in fx.vectors(spark, sf).filter("id = 0").first()["embedding"])
    return spark.sql(f"SELECT rank, node, round(similarity, 6) AS similarity FROM {name}('two', array({vector}), 20)")


_ASKS = 4
_CALLS = [("nothing", "{}"), ("unified_search", '{"query": "x"}'), ("unified_search", '{"query": " !!! "}'), ("graph_search", '{"query": "?", "project": "p"}'), ("graph_search", "{"), ("graph_index", "{}"), ("graph_search", '{"query": "words", "project": "p"}')]
_SAID = [
    '{"error": "Unknown tool: nothing"}', '{"query": "x", "results": [], "total": 0}', '{"query": " !!! ", "results": [], "total": 0}', '{"query": "?", "project": "p", "results": [], "total": 0}',
    '{"error": "Internal error occurred"}', '{"error": "Internal error occurred"}', '{"query": "words", "project": "p", "error": "No project: p", "results": [], "total": 0}',
]


@query(f"""SELECT 'call ' || call AS call, answer FROM (VALUES {", ".join(f"({i}, '{a}')" for i, a in enumerate(_SAID))}) t(call, answer)
UNION ALL SELECT project || ' ' || a.item_id, count(b.item_id)::VARCHAR FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT {_ASKS}) a, (VALUES ('even', 0), ('odd', 1)) p(project, side) LEFT JOIN benchmark b ON b.item_id % 2 = side AND b.text = a.text GROUP BY project, a.item_id""")
def tool_answers(spark, sf):
    """What tools say to questions that can't be asked; and in which of two projects, made of all benchmark texts, a text is found word for word."""
    path, b = folder(spark, "projects"), table(spark, sf, "benchmark")
    nodes = cut(models.embed(b.select("item_id", F.col("item_id").cast("string").alias("node"), F.col("text").alias("content")), text.norm_query("content")), "nodes")
    for side, name in enumerate(("even", "odd")):
        files.save_graph(path, name, nodes.filter(F.col("item_id") % 2 == side), spark.createDataFrame([], "src string, dst string, weight double"), nodes.select("node", F.col("node").alias("community")))
    with tools.Tools(fx.memory(spark, sf), fx.as_of(), path, least=0.999999) as kit:
        out = [(f"call {i}", kit.call(*x)) for i, x in enumerate(_CALLS)]
        for r in b.orderBy("item_id").limit(_ASKS).collect():  # the questions of one user
            for name in ("even", "odd"):
                said = json.loads(kit.call("graph_search", {"query": r["text"], "project": name}))
                out.append((f"{name} {r['item_id']}", str(said["total"])))
    return spark.createDataFrame(out, "call string, answer string")


# Graph


@query("SELECT DISTINCT 'd' || doc_id AS src, 'cat_' || lang AS dst, 0.9::DOUBLE AS weight, 'belongs_to' AS type FROM documents")
def belongs_to(spark, sf):
    return graph.belongs_to(table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("node"), F.col("lang").alias("category")))


@query("WITH " + c._UNIT + f""", h AS (SELECT b.id, {c._COS} AS s, b.label FROM v a, v b WHERE a.id = 0 AND {c._COS} >= 0.2 ORDER BY s DESC, b.id LIMIT 5),
n AS (SELECT DISTINCT (id * 7 + 3) % 499 AS id FROM (SELECT id FROM h ORDER BY s DESC, id LIMIT 2) WHERE (id * 7 + 3) % 499 NOT IN (SELECT id FROM h))
SELECT n.id, round({c._COS}, 6) AS similarity, true AS expanded FROM n JOIN v b ON b.id = n.id, v a WHERE a.id = 0 AND {c._COS} >= -0.5""")
def expanded_hits(spark, sf):
    """Neighbours of one query's best hits that are not among them."""
    m = fx.memory(spark, sf)
    q = m.facts.filter("id = 0").first()["embedding"]
    out = graph.expand(similarity.top_k(m.facts, q, 5, 0.2), m.relations, m.facts, q, least=-0.5)
    return out.select("id", F.round("similarity", 6).alias("similarity"), "expanded")


@query("WITH " + c._LABELLED + """, s AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m), c AS (SELECT label, count(*) AS nodes FROM v GROUP BY label), i AS (SELECT la AS label, count(*) AS edges FROM e WHERE la = lb GROUP BY la),
top AS (SELECT c.label, nodes, coalesce(edges, 0) AS edges, row_number() OVER (ORDER BY nodes DESC, c.label) AS place FROM c LEFT JOIN i USING (label) QUALIFY place <= 10),
l AS (SELECT 0 AS a, 0 AS b, '# Graph report: demo' AS line UNION ALL SELECT 0, 1, '- nodes: ' || n FROM s UNION ALL SELECT 0, 2, '- edges: ' || m FROM s UNION ALL SELECT 0, 3, '- density: ' || printf('%.4f', 2.0 * m / (n * (n - 1))) FROM s
UNION ALL SELECT 0, 4, '- average degree: ' || printf('%.2f', 2.0 * m / n) FROM s UNION ALL SELECT place, 0, '## Community ' || label || ': ' || nodes || ' nodes, ' || edges || ' edges' FROM top
UNION ALL SELECT * FROM (SELECT place, row_number() OVER (PARTITION BY top.label ORDER BY v.id) AS r, '- `' || v.id || '` (text): vector ' || v.id FROM top JOIN v ON v.label = top.label QUALIFY r <= 5))
SELECT (row_number() OVER (ORDER BY a, b))::INTEGER AS n, line FROM l""")
def graph_report(spark, sf):
    """The lines of a report on the labels as communities."""
    v = fx.vectors(spark, sf)
    nodes = v.select(F.col("id").alias("node"), F.lit("text").alias("type"), F.concat(F.lit("vector "), "id").alias("content"))
    told = graph.report(nodes, similarity.similar_pairs(v, 0.3), v.select(F.col("id").alias("node"), F.col("label").alias("community")), "demo")
    return spark.createDataFrame([(i, line) for i, line in enumerate((x for x in told.split("\n") if x), 1)], "n int, line string")


@query(f"""WITH m AS (SELECT conv_id * 10000 + turn AS f, lower(text) AS a, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM conversations),
k AS (SELECT f, CASE WHEN {c._HAS("a", gates.FIX_WORDS)} AND {c._HAS("b", gates.PROBLEM_WORDS)} THEN 'fixes' WHEN {c._HAS("a", gates.CONTRARY_WORDS)} OR {c._HAS("b", gates.CONTRARY_WORDS)} THEN 'contradicts'
WHEN {c._HAS("a", gates.CAUSE_WORDS)} OR {c._HAS("b", gates.CAUSE_WORDS)} THEN 'causes' WHEN len(list_intersect(list_filter(regexp_split_to_array(a, '\\s+'), lambda w: w <> ''), list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> ''))) >= 2 THEN 'related' END AS kind FROM m WHERE b IS NOT NULL)
SELECT f AS from_id, f + 1 AS to_id, kind, CASE kind WHEN 'fixes' THEN 0.35 WHEN 'causes' THEN 0.35 WHEN 'contradicts' THEN 0.3 ELSE 0.25 END::DOUBLE AS weight FROM k WHERE kind IS NOT NULL""")
def typed_relations(spark, sf):
    """Relations between each message and the next that are told surely enough."""
    m = fx.messages(spark, sf)
    after = m.select("session_id", (F.col("id") - 1).alias("id"), F.col("content").alias("b"))
    pairs = m.join(after, ["session_id", "id"]).select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"), F.col("content").alias("a"), "b")
    return lifecycle.typed_relations(pairs, 0.25).withColumn("weight", F.col("weight").cast("double"))


# Sessions and streams


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '... [truncated]' ELSE text END AS t FROM conversations WHERE trim(text, ' ') <> ''),
l AS (SELECT conv_id, turn, string_split(t, chr(10))[1] AS t FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 100)
SELECT conv_id::VARCHAR AS session_id, 'en' AS language, 1 AS tries, arg_min(t, turn) AS first, arg_max(t, (length(t), t)) AS fact, (1 + least(4, count(*) // 4))::INTEGER AS importance FROM l GROUP BY conv_id""")
def session_summaries(spark, sf):
    """Sessions summarised by a stand-in for a model: their first line, and their longest as a fact."""
    out = summaries.summarise(fx.messages(spark, sf), summaries.first_lines)
    return out.select("session_id", "language", "tries", F.element_at("summary", 1).alias("first"), F.element_at("facts", 1)["key"].alias("fact"), "importance")


@query(f"SELECT count(DISTINCT {_HASH}) AS facts, count(DISTINCT {_HASH}) AS keys FROM documents")
def streamed_facts(spark, sf):
    """Facts that a stream lets through once a key, in two runs of which the second finds nothing new."""
    path = folder(spark, "stream")
    table(spark, sf, "documents").select(F.col("text").alias("key"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts")).write.parquet(f"{path}/in")
    for _ in range(2):
        stream = incremental.new_facts(spark.readStream.schema("key string, ts timestamp").parquet(f"{path}/in"))
        incremental.run_available(stream, incremental.append_once(f"{path}/out"), f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("fact_hash").alias("keys"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g), x AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS messages FROM s GROUP BY user_id, n)
SELECT user_id::VARCHAR AS session_id, started, messages FROM x WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def streamed_sessions(spark, sf):
    """Users' sessions that have rested for half an hour when the stream has been read."""
    path = folder(spark, "sessions")
    table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts").write.parquet(f"{path}/in")
    kind = table(spark, sf, "events").schema["ts"].dataType.simpleString()
    stream = spark.readStream.schema(f"session_id string, ts {kind}").parquet(f"{path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    incremental.run_available(incremental.idle_windows(stream, ts="ts"), incremental.append_once(f"{path}/out"), f"{path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{path}/out").select("session_id", "started", "messages")
    return out.withColumn("started", F.col("started").cast(kind))
