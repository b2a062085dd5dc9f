"""Sources, sinks, search plans and streaming, end to end on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from memloom import schema
from memloom.functions.models import embed
from memloom.operators import fulltext, store, summaries
from memloom.plans import search, tools
from memloom.sources import files
from memloom.streaming import incremental


def test_directories(spark, tmp_path):
    for name in ("a.md", "b.py", "c.bin", "node_modules/d.md", "sub/e.txt"):
        f = tmp_path / "in" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"text of {name}")
    (tmp_path / "in/big.txt").write_text("x" * 500_001)
    got = {r["source"].split("/in/")[1]: r["text"] for r in files.load_directory(spark, str(tmp_path / "in")).collect()}
    assert got == {n: f"text of {n}" for n in ("a.md", "b.py", "sub/e.txt")}
    assert files.load_directory(spark, str(tmp_path / "in"), ["*.bin"], parsers={".bin": lambda c: F.lit("parsed")}).first()["text"] == "parsed"
    assert files.load_file(spark, str(tmp_path / "in/a.md")).count() == 1
    with pytest.raises(ValueError):
        files.load_file(spark, "/x/node_modules/d.md")
    with pytest.raises(ValueError, match="excluded"):
        files.load_file(spark, str(tmp_path / "in/big.txt"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.load_directory(spark, str(tmp_path / "missing")).collect()


def test_fact_files(spark, tmp_path):
    good = [{"key": "PostgreSQL runs behind nginx on the host", "category": "technical"}, {"key": "The parser keeps comments of the source", "importance": 3}]
    (tmp_path / "notes.jsonl").write_text("\n".join([*map(json.dumps, good), "", "not json", json.dumps({"key": " "}), json.dumps({"key": "13 nodes"})]))
    got = files.read_facts(spark, str(tmp_path / "notes.jsonl"))
    assert {(r["key"], r["category"]) for r in got.collect()} == {(good[0]["key"], "technical"), (good[1]["key"], "notes")}
    assert files.read_facts(spark, str(tmp_path / "notes.jsonl"), got.limit(2).select("fact_hash")).count() == 0
    assert files.all_keys(spark, str(tmp_path / "notes.jsonl")).count() == 4
    out = str(tmp_path / "out")
    files.append_facts(got.drop("fact_hash"), out)
    files.append_facts(got.drop("fact_hash"), out)
    assert spark.read.json(out).count() == 4


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y")], "node string, content string")
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    member = spark.createDataFrame([("a", 0), ("b", 0)], "node string, community long")
    for p in ("one", "two"):
        files.save_graph(str(tmp_path / "g"), p, nodes, edges, member)
    files.save_graph(str(tmp_path / "g"), "one", nodes.limit(1), edges, member)
    assert [df.count() for df in files.load_graph(spark, str(tmp_path / "g"), "one")] == [1, 1, 2]
    assert [r[0] for r in files.list_projects(spark, str(tmp_path / "g")).collect()] == ["one", "two"]
    files.delete_project(spark, str(tmp_path / "g"), "one")
    assert [r[0] for r in files.list_projects(spark, str(tmp_path / "g")).collect()] == ["two"]
    with pytest.raises(FileNotFoundError):
        files.load_graph(spark, str(tmp_path / "g"), "one")
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "b", "target": "a", "weight": 1.0}]}))
    n, e = files.import_node_link(spark, str(tmp_path / "graph.json"))
    assert n.count() == 2 and tuple(e.select("src", "dst").first()) == ("a", "b")
    (tmp_path / "bad.json").write_text("{ not json")
    with pytest.raises(ValueError):
        files.import_node_link(spark, str(tmp_path / "bad.json"))
    assert [df.count() for df in files.import_node_link(spark, str(tmp_path / "bad.json"), repair=True)] == [0, 0]
    assert not (tmp_path / "bad.json").exists() and list(tmp_path.glob("bad.json.bak-*"))
    with pytest.raises(FileNotFoundError):
        files.import_node_link(spark, str(tmp_path / "bad.json"))


def test_saves_keep_times_and_switch_at_once(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = lambda *rows: spark.createDataFrame(rows, "node string, created_at string")
    edges, member = spark.createDataFrame([], "src string, dst string, weight double"), spark.createDataFrame([], "node string, community long")
    files.save_graph(path, "p", nodes(("a", "monday"), ("b", "monday")), edges, member)
    before = files.load_graph(spark, path, "p")[0]
    files.save_graph(path, "p", nodes(("b", "friday"), ("c", "friday")), edges, member)
    assert sorted(map(tuple, files.load_graph(spark, path, "p")[0].collect())) == [("b", "monday"), ("c", "friday")]
    assert before.count() == 2  # who reads the version before is not disturbed

    class Broken(Exception):
        pass

    def fail(*_):
        raise Broken

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(files, "replace_text", fail)
        with pytest.raises(Broken):
            files.save_graph(path, "p", nodes(("z", "never")), edges, member)
    assert sorted(r["node"] for r in files.load_graph(spark, path, "p")[0].collect()) == ["b", "c"]
    files.save_graph(path, "p", nodes(("d", "x")), edges, member)
    assert len([x for x in (tmp_path / "g/p").iterdir() if x.name.startswith("v-")]) == 2


def test_tables_and_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    assert len(files.create_tables(spark, path)) == 7 and files.create_tables(spark, path) == []
    assert spark.read.parquet(f"{path}/facts").columns[:3] == ["id", "fact_hash", "full_key"]
    many = str(tmp_path / "many")
    spark.range(1000).repartition(20).write.parquet(many)
    assert files.compact(spark, many) == 1 and spark.read.parquet(many).count() == 1000
    assert [x.name for x in tmp_path.iterdir() if "many." in x.name] == []


def test_audit_and_index(spark, tmp_path):
    log = spark.createDataFrame([("upsert", "Key A", None, 1), ("invalidate", "Key  A", 7, 2)], "op string, full_key string, superseded_by long, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    rows = store.audit(log)
    assert store.append_audit(rows, str(tmp_path / "audit")) and store.append_audit(rows, str(tmp_path / "audit"))
    got = spark.read.parquet(str(tmp_path / "audit")).collect()
    assert len(got) == 2 and json.loads(got[0]["details"])["superseded_by"] == 7
    (tmp_path / "file").write_text("x")
    assert store.append_audit(rows, str(tmp_path / "file/below")) is False
    docs = spark.createDataFrame([(i, f"alpha{i % 7} beta gamma{i}") for i in range(50)], "id long, text string")
    index = str(tmp_path / "index")
    fulltext.build_index(docs, index, "id", "text")
    q = spark.createDataFrame([(0, "alpha3 gamma1"), (1, "beta"), (2, "zz"), (3, "!")], "query_id long, query string")
    want = sorted(map(tuple, fulltext.bm25(docs, q, 9).collect()))
    assert sorted(map(tuple, fulltext.search_index(spark, index, q, 9).collect())) == want and len(want) > 15
    assert tuple(fulltext.check_index(docs, index).first()) == (50, 50, 0, 0)
    assert tuple(fulltext.check_index(docs.filter("id > 0").unionByName(spark.createDataFrame([(99, "x")], docs.schema)), index).first()) == (50, 50, 1, 1)
    assert fulltext.search_index(spark, index, q.filter("false"), 9).collect() == []


def test_purge_and_migrations(spark):
    facts = spark.createDataFrame([("SECRET_TOKEN",), ("plain fact",)], "key string")
    nodes = spark.createDataFrame([("f1", "MY_API_KEY", "fact", "c", 3), ("f2", "PostgreSQL runs behind nginx on the host", "fact", "c", 2), ("c", "c", "category", "c", 1)], "node string, content string, type string, category string, importance int")
    edges = spark.createDataFrame([("f1", "f2", 0.5, "similar"), ("f2", "c", 0.9, "belongs_to"), ("f2", "f2x", 0.5, "similar")], "src string, dst string, weight double, type string")
    f, n, e = files.without_secrets(facts, nodes, edges)
    assert (f.count(), n.count(), e.count()) == (1, 2, 2)
    moved, links = files.migrate_graph(nodes, edges)
    assert [r["node"] for r in moved.collect()] == ["f2"] and links.count() == 0
    store = spark.createDataFrame([(1, "Telegram bot on port 8080", "technical", 4, ["alias"], None), (2, "x", "general", 1, [], None)], "id long, full_key string, category string, importance int, aliases array<string>, created_at timestamp")
    rows, entity, bridge = files.migrate_store(store, spark.createDataFrame([(1, 2, "fixes")], "from_id long, to_id long, kind string"))
    assert {r["trust_score"] for r in rows.collect()} == {0.85, 0.3}
    assert {r["name"] for r in entity.collect()} == {"Telegram", "8080", "relation:fixes"} and bridge.count() == 4


def test_schemas_parse(spark):
    for name in ("FACTS", "RELATIONS", "SESSIONS_DONE", "STATE", "AUDIT", "MISTAKES", "ARCHIVE", "SESSIONS", "MESSAGES", "ENTITIES", "FACT_ENTITIES", "NODES", "EDGES", "CHUNKS", "JSONL_FACT", "SUMMARY", "HIT"):
        assert spark.createDataFrame([], getattr(schema, name)).count() == 0


@pytest.fixture
def memory(spark):
    texts = ["the cat sat on the warm mat", "a cat sat upon the warm mat", "stock prices fell on monday", "bond prices rose on monday", "rain is expected in the north"]
    facts = embed(spark.createDataFrame([(i, t, "general", None) for i, t in enumerate(texts)], "id long, full_key string, category string, valid_to timestamp"), F.col("full_key")).withColumn("created_at", F.lit("2024-01-30").cast("timestamp"))
    rel = spark.createDataFrame([(0, 4, "similar", 0.9), (1, 0, "similar", 0.8)], "from_id long, to_id long, kind string, weight double")
    msg = spark.createDataFrame([(1, "s1", "user", "my cat sat on the mat all day", "2024-01-29"), (2, "s1", "system", "cat sat mat", "2024-01-29"), (3, "s2", "assistant", "the cat is old news by now", "2023-01-01")], "id long, session_id string, role string, content string, timestamp string")
    return search.Memory(facts, rel, msg.withColumn("timestamp", F.col("timestamp").cast("timestamp")))


def test_searches(spark, memory):
    as_of = F.lit("2024-01-31").cast("timestamp")
    q = spark.createDataFrame([(0, "cat sat mat"), (1, "x"), (2, "!!!")], "query_id long, query string")
    got = search.prefetch(memory, q, as_of, least=0.2).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got if r["type"] == "session"} == {0}
    assert got[0]["content"] == "the cat sat on the warm mat" and [r["content"] for r in got if r["type"] == "session"] == ["my cat sat on the mat all day"]
    text = search.context(memory, q, as_of, least=0.2).filter("query_id = 0").first()["context"]
    assert text.startswith("## Memory Context") and "[session:2d ago] my cat" in text and "[graph:facts] the cat sat" in text
    found = search.unified_search(memory, q, 3, 0.2, agent="me").collect()
    assert {r["rank"] for r in found if r["query_id"] == 0} == {1, 2, 3} and {r["agent_id"] for r in found} == {"me"}
    near = search.graph_search(memory, q, 3, 0.2).filter("query_id = 0").collect()
    assert {r["rank"] for r in near} == {1, 2, 3} and near[0]["total"] >= 3


def test_indexing(spark, tmp_path):
    for i, t in enumerate(["apples and pears are fruit", "pears and apples grow on trees", "engines burn fuel", "fuel is burnt by engines"]):
        (tmp_path / f"{i}.txt").write_text(t)
    row = search.graph_index(spark, str(tmp_path), str(tmp_path / "store"), "demo", least=0.3, communities="components").first()
    assert row["nodes"] == 4 and row["edges"] >= 2 and row["communities"] == 2
    assert [r[0] for r in files.list_projects(spark, str(tmp_path / "store")).collect()] == ["demo"]


def test_streams(spark, tmp_path):
    schema_ = "session_id string, key string, ts timestamp"
    rows = [("s1", "Key A", "2024-01-01 00:00:00"), ("s1", "key b", "2024-01-01 00:10:00"), ("s1", "Key  A", "2024-01-01 00:20:00"), ("s2", "Key A", "2024-01-01 00:05:00"), ("s3", "late", "2024-01-01 06:00:00")]
    spark.createDataFrame(rows, "session_id string, key string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema_).parquet(str(tmp_path / "in"))
    run = lambda df, name: incremental.run_available(df, incremental.append_once(str(tmp_path / name)), str(tmp_path / f"ck-{name}")).awaitTermination()
    run(incremental.idle_windows(stream(), ts="ts"), "idle")
    idle = spark.read.parquet(str(tmp_path / "idle"))
    assert {(r["session_id"], r["messages"]) for r in idle.collect()} == {("s1", 3), ("s2", 1)}
    run(incremental.new_facts(stream()), "facts")
    assert sorted(r["key"].split()[0].lower() for r in spark.read.parquet(str(tmp_path / "facts")).collect()) == ["key", "key", "late"]
    seen = []
    q = incremental.sightings(stream()).writeStream.outputMode("complete").foreachBatch(lambda df, _: seen.append({r["seen_count"] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ck-s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen[-1] == {3, 1}
    # A second run finds nothing new.
    run(incremental.new_facts(stream()), "facts")
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 3


def test_summaries(spark):
    said = [("s1", "user", "hello there, please set the port"), ("s1", "assistant", "the port is set to 8080 now"), ("s2", "user", "مرحبا أريد ضبط المنفذ"), ("s2", "assistant", "done"), ("s3", "user", "أهلا وسهلا بكم"), ("s4", "user", "broken"), ("s5", "user", "  "), ("s6", "user", "done before")]
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(said)], "id long, session_id string, role string, content string")

    def model():
        tries = {}

        def ask(prompts):
            out = []
            for p in prompts:
                body = p.partition("\n\n")[2]
                tries[body] = tries.get(body, 0) + 1
                if "broken" in body:
                    out.append(None if tries[body] == 1 else "no json")
                elif "وسهلا" in body:
                    out.append('{"summary": ["english only"], "facts": []}')
                elif "مرحبا" in body:
                    out.append('{"summary": ["ضبط المنفذ"], "facts": [{"key": "المنفذ مضبوط", "category": "odd"}], "importance": 9}' if "آخر" in p else '{"summary": ["wrong"]}')
                else:
                    out.append(None if tries[body] < 3 else "```json\n{'summary': ['port'], 'facts': [{'key': 'the port is 8080', 'category': 'technical'}, {'key': ''}],}\n```")
            return out

        return ask

    done = spark.createDataFrame([("s6",)], "session_id string")
    got = {r["session_id"]: r for r in summaries.summarise(m, model, done).collect()}
    assert got.keys() == {"s1", "s2"}
    assert (got["s1"]["language"], got["s1"]["tries"], got["s1"]["importance"]) == ("en", 1, 3)
    assert [tuple(f) for f in got["s1"]["facts"]] == [("the port is 8080", "technical")]
    assert (got["s2"]["language"], got["s2"]["tries"], got["s2"]["importance"], got["s2"]["facts"][0]["category"]) == ("ar", 3, 5, "general")
    told = {r["session_id"]: r for r in summaries.transcripts(m, chars=5).collect()}
    assert told["s1"]["transcript"] == "[user]: hello... [truncated]\n[assistant]: the p... [truncated]" and "s5" not in told
    assert [told[s]["arabic"] for s in ("s1", "s2", "s3")] == [False, True, True]


def test_tools(spark, memory, tmp_path):
    now = [0.0]
    kit = tools.Tools(memory, F.lit("2024-01-31").cast("timestamp"), str(tmp_path / "store"), agent="me", least=0.2, results=tools.Results(clock=lambda: now[0]))
    ask = lambda name, **args: json.loads(kit.call(name, args))
    found = ask("unified_search", query="cat sat mat", limit=3)
    assert found["total"] == 3 and [r["type"] for r in found["results"]] == ["session", "fact", "fact"] and {r["agent_id"] for r in found["results"]} == {"me"}
    assert json.loads(kit.call("unified_search", '{"query": "cat sat mat", "limit": 3}')) == found and len(kit.results) == 1
    assert ask("unified_search", query="cat sat mat", limit=3, agent_id="you")["total"] == 0
    assert ask("unified_search", query="!!!") == {"query": "!!!", "results": [], "total": 0}
    near = ask("graph_search", query="cat sat mat", top_k=2)
    assert len(near["results"]) == 2 and near["total"] >= 2
    assert ask("graph_search", query="x", project="p") == {"query": "x", "project": "p", "results": [], "total": 0}
    assert ask("nothing") == {"error": "Unknown tool: nothing"}
    assert json.loads(kit.call("unified_search", "{")) == {"error": "Internal error occurred"}
    assert ask("graph_index") == {"error": "Internal error occurred"}
    assert kit.context("cat sat mat").startswith("## Memory Context") and kit.context("x") == ""
    assert len(kit.results) == 3
    now[0] = 301.0
    assert kit.results.get(tools.Results.key("unified", "cat sat mat", 3)) is None
    (tmp_path / "in").mkdir()
    for i, t in enumerate(["apples and pears", "engines burn fuel"]):
        (tmp_path / f"in/{i}.txt").write_text(t)
    assert ask("graph_index", path=str(tmp_path / "in"))["project"] == "in" and len(kit.results) == 0
    assert ask("graph_search", query="cat sat mat", project="p") == {"query": "cat sat mat", "project": "p", "error": "No project: p", "results": [], "total": 0}
    known = ask("graph_search", query="apples and pears", project="in")
    assert known["total"] == 1 and known["results"][0]["content"] == "apples and pears" and len(kit.results) == 1
    (tmp_path / "in/0.txt").write_text("pears and plums alone")
    ask("graph_index", path=str(tmp_path / "in"))  # a save is seen at once
    assert [r["content"] for r in ask("graph_search", query="pears and plums alone", project="in")["results"]] == ["pears and plums alone"]
    assert ask("graph_search", query="pears and plums alone", project="in", relation_type="fixes")["total"] == 0
    arabic = search.Memory(memory.facts, memory.relations, spark.createDataFrame([(1, "s1", "user", "قرأنا الكتابَ أمس", "2024-01-29")], "id long, session_id string, role string, content string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    kit.refresh(arabic)
    assert ("قرأنا الكتابَ أمس", 0.7) in [(r["content"], r["similarity"]) for r in ask("unified_search", query="الكتاب امس")["results"]]
    assert {t["name"] for t in kit.schemas()} == {"unified_search", "graph_index", "graph_search"} and "graph_search" in kit.prompt_block()
    with kit:
        assert kit.available
    assert ask("unified_search", query="cat") == {"error": "Memory not initialized"}


def test_results_are_bounded():
    now = [0.0]
    held = tools.Results(ttl=10, most=2, clock=lambda: now[0])
    for k in "abc":
        held.put(k, k)
    assert held.get("a") is None and held.get("b") == "b" and len(held) == 2
    held.put("d", "d")
    assert held.get("c") is None and held.get("b") == "b"
    now[0] = 10.0
    assert held.get("b") is None and held.get("d") is None and len(held) == 0


def test_loaded_projects_go_when_unused_and_follow_saves(spark, tmp_path):
    from memloom.plans import projects
    from memloom.sources import files

    store = str(tmp_path / "store")

    def save(name, *nodes):
        rows = spark.createDataFrame([(n, n, [1.0, float(i)]) for i, n in enumerate(nodes)], "node string, content string, embedding array<float>")
        files.save_graph(store, name, rows, spark.createDataFrame([(nodes[0], nodes[-1], 0.5, "fixes")], "src string, dst string, weight double, type string"), rows.select("node", F.col("node").alias("community")))

    for name in ("a", "b", "c"):
        save(name, f"{name}0", f"{name}1", f"{name}2")
    held = projects.Graphs(spark, store, most=2)
    a = held.get("a")
    assert projects.answer(a, [1.0, 0.0], 2, 0.5)[0][0]["id"] == "a0" and projects.answer(a, [1.0, 0.0], 2, 0.5)[1] == 2
    assert [r["id"] for r in projects.answer(a, [1.0, 1.0], 5, 0.0, "fixes")[0]] == ["a2", "a0"] and projects.answer(a, [1.0, 1.0], 5, 0.0, "causes") == ([], 0)
    assert held.get("b") and held.get("a") is a and held.get("c") and len(held) == 2 and "b" not in held
    save("a", "a9")
    assert held.get("a") is not a and projects.answer(held.get("a"), [1.0, 0.0], 5, 0.0)[1] == 1
    files.delete_project(spark, store, "a")
    assert held.get("a") is None and "a" not in held and held.get("none") is None
    assert projects.stats(spark, store, "b")["nodes"] == 3 and "error" in projects.stats(spark, store, "none")
    asked = spark.createDataFrame([(1, "b", [1.0, 0.0]), (1, "c", [1.0, 2.0]), (2, "none", [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, "b", None)], "query_id long, project string, embedding array<float>")
    got = {(r["query_id"], r["project"]): (r["node"], r["total"], r["error"]) for r in projects.search(spark, store, asked, 1, 0.0).collect()}
    assert got == {(1, "b"): ("b0", 3, None), (1, "c"): ("c2", 3, None), (2, "none"): (None, 0, "No project: none")}


def test_single_questions_have_the_answers_of_the_plan(spark):
    from memloom import fixtures
    from memloom.plans import single

    m = fixtures.memory(spark, "/root/testdata/sf0.001")
    # Facts whose vectors are those of their texts, so that questions come close to them.
    from memloom.functions import models

    facts = models.embed(m.facts.drop("embedding"), F.col("full_key")).withColumn("embedding", F.col("embedding"))
    m = search.Memory(facts.cache(), m.relations, m.messages)
    warm = single.Warm(m)
    long = " ".join(f"word{i}" for i in range(40)) + " number"
    for query in ("stored fact about topic 3", "number", "the answer to my question", "zzzz qqqq", "!!", long):
        q = spark.createDataFrame([(0, query)], "query_id long, query string")
        plan = search.unified_search(m, q, 5, 0.3).orderBy("rank").select("similarity", "content", "type").collect()
        got = warm.ask(q, 5, 0.3)
        assert [(r["content"], r["type"], round(r["similarity"], 9)) for r in got] == [(r["content"], r["type"], round(r["similarity"], 9)) for r in plan]
    warm.close()


def test_consolidated_summaries_are_embedded_again(spark):
    from memloom.functions import models
    from memloom.operators import lifecycle

    facts = models.embed(spark.createDataFrame([(1, "short text", "c"), (2, "a longer text of the group", "c"), (3, "alone", "c")], "id long, full_key string, category string"), F.col("full_key"))
    plan = spark.createDataFrame([(1, [1, 2], "a longer text of the group", "c")], "leader long, source_ids array<long>, summary string, category string")
    at = F.lit("2024-01-01").cast("timestamp")
    vectors = {r["id"]: r["embedding"] for r in facts.collect()}
    kept = {r["id"]: r["embedding"] for r in lifecycle.apply_consolidation(facts, plan, at)[0].collect()}
    made = {r["id"]: r["embedding"] for r in lifecycle.apply_consolidation(facts, plan, at, models.hashed_embedder)[0].collect()}
    assert kept == {1: vectors[1], 3: vectors[3]} and made == {1: vectors[2], 3: vectors[3]}
