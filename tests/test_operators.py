"""Operators against sequential and numpy versions."""

import random

import numpy as np
import pytest
import sequential
from pyspark.sql import functions as F

from memloom.operators import fulltext, graph, lifecycle, local, pruned_pairs, rank, sessions, similarity, store, vector_index
from memloom.operators.components import components


def unit(n, dims, seed, groups=8, spread=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")


def frame(spark, x, **more):
    return spark.createDataFrame([(i, v.tolist(), *(m[i] for m in more.values())) for i, v in enumerate(x)], "id long, embedding array<float>" + "".join(f", {k} boolean" for k in more))


def cosines(x):
    y = x.astype("f8")
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return y @ y.T


@pytest.mark.parametrize("block", [4096, 17])
def test_pairs_nearest_and_knn(spark, block):
    x = unit(90, 12, 1)
    s, df = cosines(x), frame(spark, x)
    got = {(r["src"], r["dst"]): r["weight"] for r in similarity.similar_pairs(df, 0.6, 0.9, block=block).collect()}
    want = {(i, j): s[i, j] for i in range(90) for j in range(i + 1, 90) if 0.6 <= s[i, j] < 0.9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    near = {(r["query_id"], r["rank"]): r["id"] for r in similarity.nearest(df, df, 4, block=block).collect()}
    for i in range(90):
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:4]
        assert [near[i, r] for r in range(1, 5)] == order
    edges = {(r["src"], r["dst"]) for r in graph.knn_edges(df, 4, 0.5, block=block).collect()}
    assert edges == {(min(i, j), max(i, j)) for (i, _), j in near.items() if s[i, j] >= 0.5}


@pytest.mark.parametrize("block", [4096, 13])
def test_index_of_cells(spark, block):
    x = unit(900, 16, 3, groups=30, spread=0.4)
    df = frame(spark, x)
    index = vector_index.fit(df, k=8, sample=400)
    assert index.recall >= 0.95 and 1 <= index.probes < len(index.centroids) == 30
    exact = {(r["query_id"], r["id"]): r["similarity"] for r in similarity.nearest(df.filter("id % 9 = 0"), df, 8).collect()}
    found = {(r["query_id"], r["id"]): r["similarity"] for r in vector_index.nearest(df.filter("id % 9 = 0"), df, index, 8, block=block).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact) and len(found) == len(exact)
    assert all(abs(exact[p] - found[p]) < 1e-9 for p in exact.keys() & found.keys())
    every = vector_index.Cells(index.centroids, 30, 1.0)
    assert {tuple(r) for r in vector_index.nearest(df, df, every, 4, 0.5).collect()} == {tuple(r) for r in similarity.nearest(df, df, 4, 0.5).collect()}
    assert sum(r["n"] for r in vector_index.assigned(df, index, 1).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()) == 900
    edges = graph.knn_edges(df, 4, 0.5, index=every)
    assert {tuple(r) for r in edges.collect()} == {tuple(r) for r in graph.knn_edges(df, 4, 0.5).collect()}
    none = vector_index.fit(df.filter("false"))
    assert vector_index.nearest(df, df.filter("false"), none, 3).collect() == []


def test_small_graphs(spark):
    two = frame(spark, np.array([[1, 0], [1, 0]], "f4"))
    assert [(r["src"], r["dst"], round(r["weight"], 6)) for r in graph.knn_edges(two, 10, 0.4).collect()] == [(0, 1, 1.0)]
    assert graph.knn_edges(two.limit(0), 10, 0.4).collect() == graph.knn_edges(two.filter("id = 0"), 10, 0.4).collect() == []
    top = similarity.top_k(two.withColumn("live", F.col("id") == 1), [1.0, 0.0], 5, 0.5, where=F.col("live"))
    assert [r["id"] for r in top.collect()] == [1]


def greedy_groups(s, least):
    used, out = set(), {}
    for i in range(len(s)):
        if i in used:
            continue
        members = [j for j in range(i + 1, len(s)) if j not in used and s[i, j] >= least]
        if members:
            used |= {i, *members}
            out[i] = {i, *members}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leader_groups_are_those_of_the_scan(spark, seed):
    x = unit(70, 6, seed, groups=12, spread=0.45)
    got = {}
    for r in lifecycle.leader_groups(frame(spark, x), 0.8).collect():
        got.setdefault(r["leader"], set()).add(r["id"])
    assert got == greedy_groups(cosines(x), 0.8)


@pytest.mark.parametrize("seed, most", [(4, 10**6), (5, 10**6), (6, 10**6), (7, 0)])
def test_merges_are_those_of_the_scan(spark, monkeypatch, seed, most):
    monkeypatch.setattr(lifecycle.leaders, "__defaults__", (*lifecycle.leaders.__defaults__[:-1], most))
    x = unit(70, 6, seed, groups=12, spread=0.45)
    old = [bool(v) for v in np.random.default_rng(seed).random(70) < 0.25]
    s, lead, want = cosines(x), [i for i in range(70) if old[i]], {i: i for i in range(70) if old[i]}
    for i in range(70):
        if not old[i]:
            best = max(lead, key=lambda j: (round(s[i, j], 9), -j), default=None)
            want[i] = best if best is not None and s[i, best] >= 0.8 else i
            if want[i] == i:
                lead.append(i)
    df = frame(spark, x, existing=old)
    got = {r["id"]: r["target"] for r in lifecycle.merge_targets(df, 0.8).collect()}
    assert got == want
    facts = df.withColumn("full_key", F.concat(F.lit("k"), "id")).withColumn("category", F.lit("c")).withColumn("importance", F.lit(1)).withColumn("trust", F.lit(0.5))
    out = lifecycle.merged(facts, lifecycle.merge_targets(df, 0.8)).collect()
    assert sum(r["seen_count"] for r in out) == 70 and all(len(r["aliases"]) == min(10, r["seen_count"] - 1) for r in out)
    assert all(r["importance"] == (2 if r["seen_count"] > 1 else 1) for r in out)


def test_consolidation_and_decisions(spark):
    x = np.repeat(np.eye(4, dtype="f4"), 3, axis=0)
    facts = frame(spark, x).withColumn("full_key", F.concat(F.lit("fact "), F.repeat(F.lit("x"), F.col("id").cast("int")))).withColumn("category", F.when(F.col("id") < 3, "preference").otherwise("fact")).withColumn("importance", F.lit(1))
    assert lifecycle.consolidation(facts, max_facts=12).collect() == []
    plan = lifecycle.consolidation(facts, max_facts=5).cache()
    assert sorted((r["leader"], r["source_ids"], r["summary"]) for r in plan.collect()) == [(i, [i, i + 1, i + 2], "fact " + "x" * (i + 2)) for i in (3, 6, 9)]
    after, archive = lifecycle.apply_consolidation(facts, plan, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r["id"] for r in after.collect()) == [0, 1, 2, 3, 6, 9] and archive.count() == 9
    decided = lifecycle.decisions(facts.filter("id = 11"), facts.filter("id < 10"), label=lambda df: df.withColumn("label", F.lit("contradict")), same=2.0)
    assert decided.first()["decision"] == "contradict"
    events = lifecycle.decision_events(decided, facts, F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted(r["op"] for r in events) == ["invalidate", "upsert"] and {r["superseded_by"] for r in events} == {None, 11}


def test_community_detection(spark):
    edges = [(c * 5 + i, c * 5 + j, 0.9) for c in range(3) for i in range(5) for j in range(i + 1, 5)] + [(0, 5, 0.1), (9, 10, 0.1)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.range(16)
    for f in (graph.louvain, graph.leiden):
        got = {r["node"]: r["community"] for r in f(nodes, e).collect()}
        assert len(got) == 16 and len({got[i] for i in range(15)}) == 3
        assert all(len({got[c * 5 + i] for i in range(5)}) == 1 for c in range(3))
        member = spark.createDataFrame(list(got.items()), "node long, community long")
        assert graph.modularity(e, member).first()[0] > 0.6
    comp = {r["node"]: r["community"] for r in graph.connected(nodes, e).collect()}
    assert comp == {i: 0 for i in range(15)} | {15: 15}
    stats = graph.stats(nodes, e).first()
    assert (stats["nodes"], stats["edges"]) == (16, 32) and abs(stats["avg_degree"] - 4) < 1e-9
    named = nodes.select(F.col("id").alias("node"), F.lit("text").alias("type"), F.lit("hello\nworld").alias("content"))
    told = graph.report(named, e, spark.createDataFrame([(i, i // 5) for i in range(15)], "node long, community long"), "demo")
    assert "Community 0: 5 nodes, 10 edges" in told and "hello world" in told


def planted(n, size, inside=0.8, seed=7):
    """Edges of a graph with groups of ``size`` nodes, the share ``inside`` of them within."""
    dice = random.Random(seed)
    pairs = [(i, i // size * size + dice.randrange(size) if dice.random() < inside else dice.randrange(n)) for i in range(n) for _ in range(5)]
    return sorted({(min(p), max(p), 1.0) for p in pairs if p[0] != p[1]})


def settled(e, got):
    return graph._proposals(graph._Level(graph._whole_weights(e), got.select("node")), got, 1.0).isEmpty()


@pytest.mark.parametrize("find", [graph.louvain, graph.leiden])
def test_communities_settle(spark, find):
    e = spark.createDataFrame(planted(2000, 100), "src long, dst long, weight double").cache()
    nodes = spark.range(2000)
    got = find(nodes, e).cache()
    truth = nodes.select(F.col("id").alias("node"), F.floor(F.col("id") / 100).alias("community"))
    assert graph.modularity(e, got).first()[0] >= graph.modularity(e, truth).first()[0] - 0.005
    assert settled(e, got)


@pytest.mark.parametrize("find, most", [(graph.louvain, 0), (graph.leiden, 12)])
def test_communities_are_the_same_wherever_they_are_found(spark, find, most):
    """In one task, and in rounds of joins to the end or until contraction has left little; by names, with loops, repeated and weightless edges."""
    dice = random.Random(3)
    pairs = [(f"n{a}", f"n{b}", dice.choice([0.1, 0.3, 0.7, 1.0])) for a, b, _ in planted(14, 7)]
    pairs += [(b, a, 0.2) for a, b, _ in pairs[:9]] + [("n1", "n1", 5.0), ("n2", "n9", 0.0), ("n3", "n13", None)]
    e = spark.createDataFrame(pairs, "src string, dst string, weight double").cache()
    nodes = spark.range(16).select(F.concat(F.lit("n"), "id").alias("id"))
    one = sorted(map(tuple, find(nodes, e).collect()))
    assert len(one) == 16 and len({c for _, c in one}) > 3
    assert sorted(map(tuple, find(nodes, e, most=most).collect())) == one


def test_rounds_have_a_limit(spark):
    e = spark.createDataFrame(planted(20, 10, 0.9), "src long, dst long, weight double")
    with pytest.raises(RuntimeError, match="did not settle in 1 rounds"):
        graph.louvain(spark.range(20), e, most=0, rounds=1)


def whole_net(n, e, seed=0):
    src, dst, w = (np.array(x) for x in zip(*e))
    return local.Net(n, src, dst, np.round(w * 2.0**20), np.random.default_rng(seed).integers(0, 1 << 63, n).astype(np.uint64))


@pytest.mark.parametrize("seed", range(6))
def test_refined_communities_are_connected_and_no_worse(seed):
    e = planted(300, 15, 0.6, seed)
    net = whole_net(300, e, seed)
    score = lambda part: float(net.score(np.array(part), 1.0)) / net.twice**2
    plain, fine = local.communities(net), local.communities(net, refine=True)
    assert score(fine) >= score(plain) - 0.01 and score(plain) > 0.3
    near = {v: set() for v in range(300)}
    for a, b, _ in e:
        near[a].add(b)
        near[b].add(a)
    for c in set(fine.tolist()):
        members = {v for v in range(300) if fine[v] == c}
        seen, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            seen.add(v)
            todo += [u for u in near[v] if u in members and u not in seen]
        assert seen == members and c == min(members)


@pytest.mark.parametrize("refine", [False, True])
def test_rounds_are_as_good_as_one_node_after_another(refine):
    """Against the published sequential methods, over several graphs: each may end in another optimum, but not in worse ones."""
    gaps = []
    for seed in range(8):
        e = planted(300, 15, 0.6, seed)
        net = whole_net(300, e, seed)
        other = sequential.communities(sequential.Net(300, *(np.array(x) for x in zip(*e))), refine=refine)
        gaps.append(float(net.score(local.communities(net, refine=refine), 1.0) - net.score(np.array(other), 1.0)) / net.twice**2)
    assert min(gaps) >= -0.005 and sum(gaps) / len(gaps) >= -0.001


@pytest.mark.parametrize("most", [10, 10**6])
def test_leaders_of_long_chains(spark, most):
    n = 1000 if most > 10 else 40
    path = [(i, i + 1) for i in range(n - 1)] + [(n + i, n + j) for i in range(60) for j in (i + 1, i + 2, i + 3) if j < 60]
    lead = {}
    for v in range(n + 60):
        lead[v] = not any(lead[a] for a, b in path if b == v)
    df = spark.range(n + 60)
    got = {r["id"]: r["leads"] for r in lifecycle.leaders(df, spark.createDataFrame(path, "src long, dst long"), most=most).collect()}
    assert got == lead


def test_a_node_leaves_a_community_it_has_no_part_in(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    held = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "node long, community long")
    got, changed, _ = graph._settled(graph._Level(graph._whole_weights(e), held.select("node")), held, 1.0, 50, 0)
    assert changed and sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 3), (4, 3)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_of_a_path(spark, most):
    e = spark.createDataFrame([(i, i + 1) for i in range(130)] + [(500, 501)], "u long, v long")
    got = {r["node"]: r["label"] for r in components(e, most=most).collect()}
    assert got == {i: 0 for i in range(131)} | {500: 500, 501: 500}


def test_neighbours_and_expansion(spark):
    rel = spark.createDataFrame([(1, 2, "similar", 0.9), (1, 3, "similar", 0.8), (1, 4, "fixes", 0.7), (2, 5, "similar", 0.6), (5, 1, "similar", 0.5), (1, 9, "similar", 1.0)], "from_id long, to_id long, kind string, weight double")
    facts = spark.createDataFrame([(i, None, [1.0, float(i)]) for i in range(1, 6)], "id long, valid_to timestamp, embedding array<float>")
    seeds = spark.createDataFrame([(1,)], "id long")
    one = [(r["id"], r["weight"]) for r in graph.neighbours(rel, facts, seeds, "similar").orderBy(F.desc("weight")).collect()]
    assert one == [(2, 0.9), (3, 0.8)]
    assert {(r["hop"], r["id"]) for r in graph.neighbours(rel, facts, seeds, None, hops=3).collect()} == {(1, 2), (1, 3), (1, 4), (2, 5)}
    hits = facts.filter("id in (1, 4)").withColumn("similarity", F.lit(0.9))
    assert {r["id"] for r in graph.expand(hits, rel, facts, [1.0, 2.0], "similar").collect()} == {2, 3}
    assert graph.expand(hits.limit(1), rel, facts, [1.0, 2.0]).collect() == []


def test_orphans(spark):
    nodes = spark.createDataFrame([("f1", "fact", "a", []), ("f2", "fact", "zz", ["b"]), ("f3", "fact", "gone", []), ("c1", "category", "x", []), ("c2", "category", "y", [])], "node string, type string, content string, aliases array<string>")
    edges = spark.createDataFrame([("f1", "c1"), ("f3", "c2")], "src string, dst string")
    kept, links, gone = graph.without_orphans(nodes, edges, spark.createDataFrame([("a",), ("b",)], "key string"))
    assert {r["node"] for r in kept.collect()} == {"f1", "f2", "c1"} and links.count() == 1 and [r["node"] for r in gone.collect()] == ["f3"]


def loop_rrf(graph_rows, text_rows, rate=0.0):
    scores, order = {}, {}
    for r, c in enumerate(graph_rows):
        if c not in scores:
            scores[c], order[c] = 1.5 / (60 + r + 1), (0, r)
    for r, (c, age) in enumerate(text_rows):
        fade = np.exp(-rate * age)
        scores[c] = scores.get(c, 0) + (0.5 if c in scores else 1.0) * fade / (60 + r + 1)
        order.setdefault(c, (1, r))
    return sorted(scores.items(), key=lambda x: (-round(x[1], 12), order[x[0]]))


@pytest.mark.parametrize("seed", range(4))
def test_fusion(spark, seed):
    rng = random.Random(seed)
    g = [rng.choice("abcdef") for _ in range(6)]
    t = [(rng.choice("abcdefgh"), rng.randrange(200)) for _ in range(7)]
    left = spark.createDataFrame([(0, c, i + 1) for i, c in enumerate(g)], "query_id long, content string, rank int")
    right = spark.createDataFrame([(0, c, i + 1, age) for i, (c, age) in enumerate(t)], "query_id long, content string, rank int, age int")
    as_of = F.lit("2024-06-30").cast("timestamp")
    right = right.withColumn("ts", F.timestamp_seconds(F.unix_seconds(as_of) - F.col("age") * 86400))
    got = [(r["content"], r["rrf_score"]) for r in rank.rrf(left, right, ts="ts", as_of=as_of, rate=0.01).orderBy("rank").collect()]
    want = loop_rrf(g, t, 0.01)
    assert [c for c, _ in got] == [c for c, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_decay_echo_and_agents(spark):
    as_of = F.lit("2024-06-30").cast("timestamp")
    day = lambda d: F.timestamp_seconds(F.unix_seconds(as_of) - F.lit(int(d * 86400)))
    row = spark.range(1).select(*(rank.decay(day(d), as_of).alias(f"d{i}") for i, d in enumerate((0, 69.3, 30, 180))), rank.decay(F.lit(None).cast("timestamp"), as_of).alias("n")).first()
    assert np.allclose(list(row), [1, 0.5, 0.741, 0.165, 1], atol=2e-3)
    echo = spark.createDataFrame([("a b c d e", "A b c d"), ("a b", "a b c d"), ("a b c", "a b c")], "t string, q string").select(rank.is_echo(F.col("t"), F.col("q"))).collect()
    assert [r[0] for r in echo] == [True, False, False]
    rows = spark.createDataFrame([("x",), ("y",)], "agent_id string")
    assert [rank.of_agent(rows, a).count() for a in (None, "all", "*", "x")] == [2, 2, 2, 1]


def test_bm25_against_a_loop(spark):
    rng = random.Random(1)
    docs = [" ".join(rng.choice(["alpha", "alphabet", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    got = {r["doc_id"]: r["score"] for r in fulltext.bm25(df, spark.createDataFrame([(0, "alph beta x")], "query_id long, query string"), 99).collect()}
    toks = [d.split() for d in docs]
    mean = sum(map(len, toks)) / 40
    want = {}
    for term in ("alph", "beta"):
        f = [sum(w.startswith(term) for w in t) for t in toks]
        df_ = sum(x > 0 for x in f)
        idf = np.log((40 - df_ + 0.5) / (df_ + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, x in enumerate(f):
            if x:
                want[i] = want.get(i, 0) + idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_tiers_and_snippets(spark):
    notes = spark.createDataFrame([(1, "the memory leak"), (2, "memorize it"), (3, "50% done")], "id long, t string")
    ids = lambda q: [(r["id"], r["tier"]) for r in fulltext.tiered_search(notes, q, ("t",), lambda c: F.lower(c), [F.col("id")]).collect()]
    assert [ids("memory"), ids("emor"), ids("0%"), ids("zzz")] == [[(1, 1)], [(1, 2), (2, 2)], [(3, 3)], []]
    text = " ".join(f"w{i}" for i in range(100))
    got = spark.range(1).select(fulltext.snippet(F.lit(text), F.array(F.lit("w50")), 10)).first()[0]
    assert "<b>w50</b>" in got and len(got.split()) == 10


def test_store_folds(spark):
    at = lambda i: F.timestamp_seconds(F.col(i))
    log = spark.createDataFrame(
        [("upsert", "Key A", "x", 1, None, 1), ("upsert", " Key  A", "y", 4, None, 2), ("upsert", "b", "x", 2, None, 3), ("invalidate", "Key A", None, None, 7, 4), ("upsert", "Key A", "z", 1, None, 5), ("invalidate", "never", None, None, None, 6)],
        "op string, full_key string, category string, importance int, superseded_by long, seq long",
    ).withColumn("ts", at("seq")).withColumn("session_id", F.lit("s")).withColumn("source", F.lit("t"))
    got = sorted((r["full_key"], r["epoch"], r["category"], r["importance"], r["seen_count"], r["valid_to"] is None, r["superseded_by"]) for r in store.fold_facts(log).collect())
    assert got == [("Key A", 0, "x", 4, 2, False, 7), ("Key A", 1, "z", 1, 1, True, None), ("b", 0, "x", 2, 1, True, None)]
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k long, v string")
    assert sorted(map(tuple, store.insert_or_ignore(old, new, ["k"], [F.col("v")]).collect())) == [(1, "a"), (2, "c")]
    rel = spark.createDataFrame([(1, 2, "x", 0.5, 1, False), (1, 2, "x", 0.7, 2, False), (3, 4, "x", 0.1, 1, False), (3, 4, "x", 0.1, 2, True)], "from_id long, to_id long, kind string, weight double, ts long, deleted boolean")
    assert [(r["from_id"], r["weight"]) for r in store.relations(rel).collect()] == [(1, 0.7)]


def test_mistakes(spark):
    log = spark.createDataFrame([("d1", "s1", "config", "high", ["a"], False, 1), ("d1", "s1", "syntax", "low", ["b"], False, 2), ("d1", "s2", "odd", "odd", [], False, 3)], "description string, session_id string, category string, severity string, tags array<string>, fix_verified boolean, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    notes = store.fold_mistakes(log).withColumn("id", F.xxhash64("description", "session_id"))
    got = sorted((r["session_id"], r["category"], r["severity"], r["recurrence_count"], r["tags"]) for r in notes.collect())
    assert got == [("s1", "config", "high", 2, ["a"]), ("s2", "other", "medium", 1, [])]
    assert [r["session_id"] for r in store.recurring(notes).collect()] == ["s1"]
    assert store.filtered(notes, category="config", session_id="s1").count() == 1
    assert store.verified(notes, notes.filter("session_id = 's1'").select("id")).filter("fix_verified").count() == 1


def test_enrichment(spark):
    facts = spark.createDataFrame([("k1", "general"), ("k2", "general")], "full_key string, category string")
    stored = spark.createDataFrame([(7, "k1", 0.9, "decision")], "fact_id long, content string, trust_score double, category string")
    ents = spark.createDataFrame([(1, "Telegram", "platform")], "entity_id long, name string, entity_type string")
    out = {r["full_key"]: r for r in store.enriched(facts, stored, spark.createDataFrame([(7, 1)], "fact_id long, entity_id long"), ents).collect()}
    assert out["k1"]["category"] == "decision" and out["k1"]["entities"][0]["name"] == "Telegram" and out["k2"]["trust_score"] is None
    nodes = spark.createDataFrame([("k1", 2, 0.3)], "content string, importance int, trust double")
    assert tuple(store.with_trust(nodes, stored).select("importance", "trust").first()) == (4, 0.9)


def test_sessions(spark):
    m = spark.createDataFrame([(1, "s1", "user", "مرحبا بك"), (2, "s1", "assistant", "hello there security"), (3, "s2", "user", "ok thanks"), (4, "s3", "user", "plain words only")], "id long, session_id string, role string, content string")
    assert {r["session_id"]: round(r["ratio"], 2) for r in sessions.user_ratio(m).collect()} == {"s1": 1.0, "s2": 0.0, "s3": 0.0}
    assert {r["session_id"]: r["ratio"] > 0.2 for r in sessions.opening_ratio(m).collect()} == {"s1": True, "s2": False, "s3": False}
    got = {r["session_id"]: r["importance"] for r in sessions.session_importance(m, F.lit(3), F.lit(False)).collect()}
    assert got == {"s1": 5, "s2": 1, "s3": 3}
    facts = spark.createDataFrame([("s3", "plain words"), ("s3", "nothing heard"), ("s9", "x")], "session_id string, key string")
    assert [r["key"] for r in sessions.grounded(facts, m).collect()] == ["plain words"]


def test_helper_columns_clash_with_nothing(spark):
    names = ["_n", "_t", "_h", "_on", "_first", "row", "place", "k", "e", "s", "t", "d"]
    df = spark.createDataFrame([(1, 1, "a", 1, "upsert", *range(12)), (1, 2, "a", 2, "invalidate", *range(12)), (2, 1, "b", 3, "upsert", *range(12))], "id long, ts long, content string, seq long, op string, " + ", ".join(f"{n} int" for n in names))
    same = lambda out, n: out.columns[: len(df.columns)] == df.columns and all([r[c] for c in names] == list(range(12)) for r in out.collect()) and out.count() == n
    assert same(store.latest(df, ["id"]), 2)
    assert same(rank.keep_first(df, "content", [F.col("seq")]), 2)
    assert same(store.insert_or_ignore(df.limit(0), df, ["id"], [F.col("seq")]), 2)
    assert same(sessions.head(df, 1, "id", "seq"), 2)
    assert same(store.epochs(df.withColumn("ts", F.timestamp_seconds("ts")), key="content"), 3)
    trusted = store.with_trust(df.withColumn("importance", F.lit(1)).withColumn("trust", F.lit(0.5)), spark.createDataFrame([("a", 0.9)], "content string, trust_score double"))
    assert same(trusted, 3) and {r["trust"] for r in trusted.collect()} == {0.9, 0.5}
    checked = store.verified(df.withColumn("fix_verified", F.lit(False)), df.filter("id = 1").select("id"))
    assert same(checked, 3) and [r["fix_verified"] for r in checked.orderBy("seq").collect()] == [True, True, False]


@pytest.mark.parametrize("block", [4096, 13])
def test_new_pairs_complete_the_old_ones(spark, block):
    x = unit(120, 8, 9)
    df = frame(spark, x)
    old, new = df.filter("id % 4 <> 1"), df.filter("id % 4 = 1")
    pairs = lambda d: sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in d.collect())
    both = similarity.similar_pairs(old, 0.4, block=block).unionByName(similarity.new_pairs(new, old, 0.4, block=block))
    assert pairs(both) == pairs(similarity.similar_pairs(df, 0.4)) and len(pairs(both)) > 50
    assert pairs(similarity.new_pairs(new.limit(0), old, 0.4)) == [] and pairs(similarity.new_pairs(new, old.limit(0), 0.4)) == pairs(similarity.similar_pairs(new, 0.4))


@pytest.mark.parametrize("block", [4096, 20])
def test_pairs_of_balls_are_all_pairs_and_most_are_skipped(spark, block):
    x = unit(400, 24, 11, groups=25, spread=0.12)
    x[5] = 0  # a vector without length
    df = frame(spark, x).cache()
    pairs = lambda d: sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in d.collect())
    found, told = pruned_pairs.similar_pairs(df, 0.8, index=vector_index.fit(df, cells=60), block=block)
    assert pairs(found) == pairs(similarity.similar_pairs(df, 0.8)) and len(pairs(found)) > 500
    assert told["of_pairs"] == 400 * 399 // 2 and told["pairs"] < 0.25 * told["of_pairs"]
    with pytest.raises(ValueError, match="above 0"):
        pruned_pairs.similar_pairs(df, 0.0)


def test_balls_are_sent_in_packs(spark):
    """Without clusters all balls are close: their rows are sent for each pair of packs, of which there are far fewer."""
    df = frame(spark, unit(400, 24, 3)).cache()
    pairs = lambda d: sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in d.collect())
    found, told = pruned_pairs.similar_pairs(df, 0.3, index=vector_index.fit(df, cells=60), block=50)
    assert pairs(found) == pairs(similarity.similar_pairs(df, 0.3)) and len(pairs(found)) > 500
    assert told["packs"] <= 4 * 5 // 2 and told["products"] > 500


def test_stored_cells_are_pruned_and_appended_to(spark, tmp_path):
    """Rows come in two writes; a search equals that by the index in memory, and reads the files of the cells that it visits alone."""
    x = unit(600, 16, 5, groups=20, spread=0.3)
    df, path = frame(spark, x).cache(), str(tmp_path / "cells")
    index = vector_index.fit(df, cells=40)
    vector_index.store(df.filter("id < 400"), index, path)
    vector_index.append(df.filter("id >= 400"), path)
    again = vector_index.load(spark, path)
    assert (again.probes, again.recall) == (index.probes, index.recall) and (again.centroids == index.centroids).all() and index.probes < 20
    asked = df.filter("id % 50 = 0")
    by_id = lambda rows: sorted(map(tuple, rows.collect()))
    assert by_id(vector_index.stored_nearest(asked, path, 5)) == by_id(vector_index.nearest(asked, df, index, 5))
    best = vector_index.stored_top_k(spark, path, x[7].tolist(), 6, -1.0)
    exact = np.argsort(-cosines(x)[7], kind="stable")[:6]
    assert len(set(exact.tolist()) & {r["id"] for r in best.collect()}) >= 5
    files = int(_metric(best._jdf.queryExecution().executedPlan(), "numFiles"))  # of the run just now
    assert 0 < files <= 4 * index.probes < len(list((tmp_path / "cells").rglob("*.parquet")))


def _metric(plan, name):
    """A metric of the first scan of an executed plan."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    if plan.metrics().contains(name):
        return plan.metrics().apply(name).value()
    children = plan.children()
    return next((m for i in range(children.size()) if (m := _metric(children.apply(i), name)) is not None), None)


def test_equal_questions_are_scored_once_and_only_the_best_leave_a_task(spark):
    """Many queries of few texts over many rows: neither times the other. A table of texts and rows would have 100,000 rows here."""
    docs = spark.range(2_000).select("id", F.concat(F.lit("common word "), F.col("id") % 7).alias("text"))
    q = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("common "), F.col("id") % 2 + 1, F.lit(" word")).alias("query"))
    df = fulltext.bm25(docs, q, 3)
    got = df.collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [0, 1, 2] * 50
    scored = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in scored and sorted(got) == sorted(fulltext.bm25(docs, q.unionByName(q), 3).collect())


@pytest.mark.parametrize("cells", [fulltext.CELLS, 64])
def test_scores_by_blocks_are_those_by_joins(spark, monkeypatch, cells):
    rng = random.Random(5)
    words = ["al", "alpha", "alphabet", "beta", "betas", "gamma", "x", "delta", "deltas", "de"]
    docs = spark.createDataFrame([(i % 90, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(100)] + [(200, None)], "id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 4))) for i in range(20)] + [(77, "zzz"), (78, ""), (79, None)], "query_id long, query string")
    monkeypatch.setattr(fulltext, "CELLS", cells)
    got = sorted(map(tuple, fulltext.bm25(docs, q, 6).collect()))
    monkeypatch.setattr(fulltext, "MOST_TERMS", 3)
    assert got == sorted(map(tuple, fulltext.bm25(docs, q, 6).collect())) and len(got) == 120
    assert fulltext.bm25(docs, q.filter("query_id > 77"), 6).collect() == []


@pytest.mark.parametrize("find", [graph.louvain, graph.leiden])
def test_passes_over_links_find_what_joins_find(spark, monkeypatch, find):
    """A round is one pass over the links of a level, and its communities are those of joins and of one task."""
    rng = random.Random(11)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(60)) if a < b})
    e = spark.createDataFrame([(a, b, 1.0 + (a * b) % 3) for a, b in pairs], "src long, dst long, weight double")
    looks = []
    look = graph._Dealt.look
    monkeypatch.setattr(graph._Dealt, "look", lambda *a: (looks.append(1), look(*a))[1])
    told = lambda most: sorted(map(tuple, find(spark.range(15), e, most=most).collect()))
    by_passes = told(0)
    assert looks and by_passes == told(1000)
    looks.clear()
    monkeypatch.setattr(graph, "MOST_NODES", 0)
    assert by_passes == told(0) and not looks


def test_a_look_sorts_nothing_where_parts_are_few(monkeypatch):
    """Links are put in order once; a look at few communities adds up a table of nodes and communities."""
    e = planted(300, 15, 0.6, 4)
    net, part = whole_net(300, e), np.arange(300) // 15 % 4
    want = {}
    for a, b, w in zip(net.a.tolist(), net.b.tolist(), net.w.tolist()):
        want[a, int(part[b])] = want.get((a, int(part[b])), 0.0) + w
    alone = net.near(np.arange(300))
    monkeypatch.setattr(local.np, "lexsort", None)
    monkeypatch.setattr(local.np, "argsort", None)
    assert {(v, to): w for v, to, w in zip(*(x.tolist() for x in net.near(part)))} == want
    assert len(net.look(part, 1.0)[1]) > 0 and [x.tolist() for x in alone] == [net.a.tolist(), net.b.tolist(), net.w.tolist()]


@pytest.mark.parametrize("find", [graph.louvain, graph.leiden])
def test_levels_of_few_nodes_are_numbers(spark, monkeypatch, find):
    """Links are packed by a few to a row; levels are contracted from them, without joins by names, and finished in one task when they are small."""
    e = spark.createDataFrame([(f"n{a}", f"n{b}", w) for a, b, w in planted(40, 8, 0.7)], "src string, dst string, weight double").cache()
    nodes = spark.range(42).select(F.concat(F.lit("n"), "id").alias("id"))
    one = sorted(map(tuple, find(nodes, e).collect()))
    monkeypatch.setattr(graph, "_Level", None)
    monkeypatch.setattr(graph, "PACKED", 7)
    assert sorted(map(tuple, find(nodes, e, most=30).collect())) == one and len({c for _, c in one}) > 4


def test_blocks_grow_with_the_rows_and_their_pairs_come_in_parts(monkeypatch):
    """A row is sent once for each block: to ten, not to one for every 4,096 rows; and what a block finds is given out some rows' at a time."""
    for n, dims, most in ((10_256, 64, 3), (102_564, 64, 11), (615_384, 64, 19), (615_384, 1024, 151)):
        assert -(-n // similarity.block_of(n, dims)) <= most and similarity.block_of(n, dims) * dims <= max(similarity.WIDE, 4096 * dims)
    x, ids = unit(60, 6, 4).astype(float), np.arange(60) // 2 * 2  # ids repeat
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(similarity, "HELD", 60 * 7)
    parts = list(similarity.found_pairs(ids, x, ids, x, -1.1, 2.0, True))
    assert len(parts) == 9 and max(p.num_rows for p in parts) <= 60 * 7
    got = sorted(zip(*(sum((p.column(c).to_pylist() for p in parts), []) for c in (0, 1))))
    assert got == sorted((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(60) for j in range(i + 1, 60) if ids[i] != ids[j])
