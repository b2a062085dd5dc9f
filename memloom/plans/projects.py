"""Search in stored project graphs: each question in the project that it names, as it was saved last.

A table of questions is one plan: the nodes of the projects that are asked for, and of no others, are
read by the paths of their versions, and a question meets the vectors of its own project alone.
``Graphs`` keeps loaded projects for single questions, and SQL has ``project_search`` as a table function.

Defined results: a question for a project that was never saved, or deleted, has one row with ``error``
and nothing else; nodes without a vector are not found; equal similarities go by node; null questions
and null projects have no rows.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import graph, similarity
from memloom.shared import read_text
from memloom.sources.files import CURRENT, list_projects, load_graph

MOST_GRAPHS = 50
_NODE = "node string, content string, type string, embedding array<float>"


def version(spark: SparkSession, store: str, project: str) -> str | None:
    """The name of the version that holds, or None."""
    return read_text(spark, f"{store}/{project}/{CURRENT}")


def _plain(nodes: DataFrame, project: str) -> DataFrame:
    """``project, node, content, type, embedding``, whatever columns a project's nodes were saved with."""
    kinds = [c.split(" ", 1) for c in _NODE.split(", ")]
    return nodes.select(F.lit(project).alias("project"), *((F.col(c) if c in nodes.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds))


def nodes_of(spark: SparkSession, store: str, projects: list[str]) -> tuple[DataFrame, list[str]]:
    """The nodes of those ``projects`` that are there, and the names of these."""
    out, there = spark.createDataFrame([], f"project string, {_NODE}"), []
    for name in projects:
        if (held := version(spark, store, name)) is not None:
            out = out.unionByName(_plain(spark.read.parquet(f"{store}/{name}/{held}/nodes"), name))
            there.append(name)
    return out, there


def search(spark: SparkSession, store: str, queries: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """``query_id, project, rank, node, content, type, similarity, total, error`` of ``query_id, project, embedding``: the k closest nodes; ``total`` counts all that are close enough."""
    asked = queries.filter("project IS NOT NULL AND embedding IS NOT NULL").select("query_id", "project", "embedding")
    names = sorted(r["project"] for r in asked.select("project").distinct().collect())  # as many as projects are asked for
    nodes, there = nodes_of(spark, store, names)
    nodes = nodes.filter("embedding IS NOT NULL").withColumn("id", F.xxhash64("project", "node"))
    # A question may ask several projects: each is a question of its own, met by the nodes of that project.
    asked = asked.withColumn("id", F.xxhash64("project", F.lit("?"), "query_id"))
    known = asked.filter(F.col("project").isin(there))
    near = similarity.nearest(known, nodes, k, least, own_too=True, by="project", count=True).withColumnRenamed("query_id", "of")
    found = near.join(nodes.select("id", "node", "content", "type"), "id").join(known.select(F.col("id").alias("of"), "query_id", "project"), "of")
    rows = found.select("query_id", "project", "rank", "node", "content", "type", "similarity", F.col("close").alias("total"), F.lit(None).cast("string").alias("error"))
    none = asked.filter(~F.col("project").isin(there))
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("query_id", "project", "total", "error")}
    told = none.select("query_id", "project", *empty.values(), F.lit(0).cast("long").alias("total"), F.concat(F.lit("No project: "), "project").alias("error"))
    return rows.unionByName(told.select(*rows.columns))


def stats(spark: SparkSession, store: str, project: str) -> dict:
    """What is known of a stored project: nodes, edges, density, communities and modularity; or an error."""
    try:
        nodes, edges, member = load_graph(spark, store, project)
    except FileNotFoundError as e:
        return {"error": str(e)}
    one = graph.stats(nodes, edges).crossJoin(member.agg(F.countDistinct("community").alias("communities"))).crossJoin(graph.modularity(edges, member))  # one row each
    return {"project": project, **one.first().asDict()}


@dataclass
class Loaded:
    version: str
    nodes: DataFrame
    edges: DataFrame


class Graphs:
    """Loaded projects, the least lately used of which goes beyond ``most``. Each look reads the small file that names the version, so a save is seen at once."""

    def __init__(self, spark: SparkSession, store: str, most: int = MOST_GRAPHS):
        self.spark, self.store, self.most = spark, store, most
        self._held: OrderedDict[str, Loaded] = OrderedDict()
        self._lock = threading.Lock()

    def get(self, project: str) -> Loaded | None:
        """The project as it was saved last, its nodes kept in the executors; None if there is none."""
        now = version(self.spark, self.store, project)
        with self._lock:
            held = self._held.get(project)
            if held is not None and held.version == now:
                self._held.move_to_end(project)
                return held
            if held is not None:
                self._let_go(project)
            if now is None:
                return None
            nodes, edges, _ = load_graph(self.spark, self.store, project)
            self._held[project] = Loaded(now, _plain(nodes, project).filter("embedding IS NOT NULL").cache(), edges)
            while len(self._held) > self.most:
                self._let_go(next(iter(self._held)))
            return self._held[project]

    def _let_go(self, project: str) -> None:
        self._held.pop(project).nodes.unpersist()

    def clear(self) -> None:
        with self._lock:
            for project in list(self._held):
                self._let_go(project)

    def __contains__(self, project: str) -> bool:
        return project in self._held

    def __len__(self) -> int:
        return len(self._held)


def answer(held: Loaded, vector: list[float], k: int, least: float, kind: str | None = None) -> tuple[list[dict], int]:
    """The k nodes of a loaded project closest to one vector, and how many are close enough; with a ``kind``, of those that an edge of that type touches."""
    nodes = held.nodes
    if kind is not None:
        typed = held.edges.filter(F.col("type") == kind) if "type" in held.edges.columns else held.edges.limit(0)
        ends = typed.select(F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("node")).distinct()
        nodes = nodes.join(ends, "node", "left_semi")
    close = similarity.close_to(nodes, vector, least)
    total = close.agg(F.count(F.lit(1)).alias("total"))
    best = close.orderBy(F.desc("similarity"), "node").limit(k).crossJoin(F.broadcast(total))  # one row
    found = [r.asDict() for r in best.collect()]
    return [{"id": r["node"], "similarity": r["similarity"], "content": r["content"], "type": r["type"]} for r in found], found[0]["total"] if found else 0


def sql_functions(spark: SparkSession, store: str, name: str = "project_search") -> str:
    """Register a table function of a project's name, a vector and a number of rows, over all projects saved now. Returns its name.

    ``SELECT * FROM project_search('demo', array(0.1, 0.2), 5)`` gives ``rank, node, content, type, similarity``.
    """
    nodes, _ = nodes_of(spark, store, [r["project"] for r in list_projects(spark, store).collect()])  # as many as projects
    nodes.filter("embedding IS NOT NULL").createOrReplaceTempView(f"{name}_nodes")
    length = "sqrt(aggregate({0}, 0D, (s, x) -> s + cast(x AS DOUBLE) * cast(x AS DOUBLE)))".format
    dot = "aggregate(zip_with(embedding, asked, (x, y) -> cast(x AS DOUBLE) * y), 0D, (s, x) -> s + x)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(of STRING, asked ARRAY<DOUBLE>, most INT)
RETURNS TABLE (rank INT, node STRING, content STRING, type STRING, similarity DOUBLE)
RETURN SELECT rank, node, content, type, similarity FROM (
  SELECT *, row_number() OVER (ORDER BY similarity DESC, node) AS rank FROM (
    SELECT node, content, type, round(coalesce(try_divide({dot}, {length('embedding')} * {length('asked')}), 0D), 12) AS similarity FROM {name}_nodes WHERE project = of))
WHERE rank <= most""")
    return name
