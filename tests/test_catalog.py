"""Every registered query of the core runs on the smallest tables and equals its DuckDB SQL."""

import hashlib
import math
import os

import column_split
import duckdb
import pytest
from pyspark.sql import functions as F

from memloom import catalog
from memloom import fixtures as fx
from memloom.operators import similarity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()))
    answer = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in cols)) for r in answer.fetchall())
    assert got == want


def test_what_has_no_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) <= {"louvain_communities", "leiden_communities", "split_chunks"}


@pytest.mark.parametrize("name", ["louvain_communities", "leiden_communities"])
def test_communities_beat_a_greedy_run(spark, name):
    """Every node has one community, and modularity is not below that of merging the best pair again and again."""
    v = fx.vectors(spark, SF)
    edges = [tuple(r) for r in similarity.similar_pairs(v, 0.3).collect()]
    found = {r["node"]: r["community"] for r in catalog.QUERIES[name](spark, SF).collect()}
    assert len(found) == v.count()

    def modularity(member):
        m, inner, total = sum(w for *_, w in edges), 0.0, {}
        for a, b, w in edges:
            inner += w * (member[a] == member[b])
            for x in (a, b):
                total[member[x]] = total.get(member[x], 0.0) + w
        return inner / m - sum(t * t for t in total.values()) / (4 * m * m)

    member, m = {x: x for x in found}, sum(w for *_, w in edges)
    between, strength = {}, {}
    for a, b, w in edges:
        between[a, b] = between.get((a, b), 0.0) + w
        for x in (a, b):
            strength[x] = strength.get(x, 0.0) + w
    while between:
        (a, b), gain = max(((p, w / m - strength[p[0]] * strength[p[1]] / (2 * m * m)) for p, w in between.items()), key=lambda x: (x[1], x[0]))
        if gain <= 0:
            break
        member = {x: a if c == b else c for x, c in member.items()}
        strength[a] += strength.pop(b)
        merged = {}
        for (x, y), w in between.items():
            x, y = sorted((a if x == b else x, a if y == b else y))
            if x != y:
                merged[x, y] = merged.get((x, y), 0.0) + w
        between = merged
    assert modularity(found) >= modularity(member) - 1e-9


def test_chunks_equal_those_of_column_expressions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.posexplode(column_split.split_column(F.col("text"))).alias("n", "c"))
    want = {(r["doc_id"], r["n"], len(r["c"]), hashlib.md5(r["c"].encode()).hexdigest()) for r in docs.collect()}
    assert {tuple(r) for r in catalog.QUERIES["split_chunks"](spark, SF).collect()} == want


def test_pushdown(spark):
    """Scans read only the columns that a query needs, and filters reach them."""
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan("category_index") and "text" not in plan("category_index")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in plan("facts_by_category")
    assert "TakeOrderedAndProject" in plan("facts_by_category")


def test_a_large_category_is_one_list(spark, tmp_path):
    """More documents of a language than a part of the operator holds."""
    spark.range(250_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r["category"]: (r["part"], r["nodes"]) for r in catalog.QUERIES["category_index"](spark, str(tmp_path)).collect()}
    assert got == {c: (part, nodes) for c, part, nodes in con.execute(catalog.ORACLES["category_index"]).fetchall()} and len(got["en"][1]) == 200_000


@pytest.mark.parametrize("name", ["graph_store", "sql_project_search"])
def test_edges_of_several_saves_are_found_once(spark, monkeypatch, name):
    from memloom import catalog_files

    save, found = catalog_files.files.save_graph, []
    monkeypatch.setattr(catalog_files.files, "save_graph", lambda path, project, nodes, edges, member: (found.append("FlatMapGroupsInArrow" in edges._jdf.queryExecution().optimizedPlan().toString()), save(path, project, nodes, edges, member))[1])
    catalog.QUERIES[name](spark, SF)
    # A store's second project is saved again with edges of its own.
    assert found == ([False] * 3 + [True] if name == "graph_store" else [False] * 3)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_no_more_copies_of_the_edges_than_the_store_holds(spark, monkeypatch):
    """When a project is saved again, the one to delete is gone, and so are the edges that all were saved from."""
    from memloom import catalog_files
    from memloom.shared import _paths, cut, names

    save, there, made = catalog_files.files.save_graph, [], []
    monkeypatch.setattr(catalog_files, "cut", lambda df, name: made.append(df := cut(df, name)) or df)
    monkeypatch.setattr(catalog_files.files, "save_graph", lambda path, *a: (there.append((names(spark, path), [x for x in made if id(x) in _paths])), save(path, *a)))
    catalog.QUERIES["graph_store"](spark, SF)
    assert [x[0] for x in there] == [[], ["one"], ["one"], ["one", "two"]] and [len(x[1]) for x in there] == [1, 1, 1, 0]
