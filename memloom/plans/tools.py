"""The memory as tools: a name and JSON arguments in, JSON out, for one question at a time.

Whole tables of questions go through ``memloom.plans.search``; this is the surface for an
agent that asks singly. Answers are bounded by their limits, so they may come to the driver.
They are kept for a while by what was asked, until the tables change.
"""

from __future__ import annotations

import hashlib
import json
import logging
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import ARABIC_SIGNS, expand_query, norm_fts
from memloom.operators import fulltext, rank
from memloom.plans import projects, search, single
from memloom.schema import RELATION_KINDS

TTL, ENTRIES = 300.0, 500


class Results:
    """Answers by what was asked: none older than ``ttl`` seconds, the least lately used go first beyond ``most``."""

    def __init__(self, ttl: float = TTL, most: int = ENTRIES, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self._held: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self._lock = threading.Lock()

    @staticmethod
    def key(*asked: Any) -> str:
        return hashlib.md5(json.dumps(asked, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str) -> Any | None:
        with self._lock:
            until, answer = self._held.get(key, (0.0, None))
            if answer is None:
                return None
            if self.clock() >= until:
                del self._held[key]
                return None
            self._held.move_to_end(key)
            return answer

    def put(self, key: str, answer: Any) -> None:
        with self._lock:
            now = self.clock()
            self._held[key] = now + self.ttl, answer
            self._held.move_to_end(key)
            if len(self._held) > self.most:
                for old in [k for k, (until, _) in self._held.items() if now >= until]:
                    del self._held[old]
            while len(self._held) > self.most:
                self._held.popitem(last=False)

    def clear(self) -> None:
        with self._lock:
            self._held.clear()

    def __len__(self) -> int:
        return len(self._held)


class Tools:
    """The tools over a memory. ``open`` and ``close`` bound its life; ``refresh`` puts other tables in place."""

    def __init__(self, memory: search.Memory | None, as_of: Column, store: str | None = None, agent: str | None = None, synonyms: dict[str, list[str]] | None = None, least: float = 0.5, results: Results | None = None, main: str = "memory"):
        self.main, self.graphs, self.warm = main, None, None
        self.memory, self.as_of, self.store, self.agent, self.least = memory, as_of, store, agent, least
        self.synonyms, self.results = synonyms or {}, Results() if results is None else results

    def open(self, memory: search.Memory) -> Tools:
        return self.refresh(memory)

    def refresh(self, memory: search.Memory) -> Tools:
        self._cool()
        self.memory = memory
        self.results.clear()
        if self.store:
            self._graphs().clear()
        return self

    def _warm(self) -> single.Warm:
        """The memory, made ready by the first question."""
        if self.warm is None:
            self.warm = single.Warm(self.memory)
        return self.warm

    def _cool(self) -> None:
        if self.warm is not None:
            self.warm.close()
            self.warm = None

    def _graphs(self) -> projects.Graphs:
        if self.graphs is None:
            self.graphs = projects.Graphs(self.memory.facts.sparkSession, self.store)
        return self.graphs

    def close(self) -> None:
        self._cool()
        if self.graphs is not None:
            self.graphs.clear()
        self.memory = self.graphs = None
        self.results.clear()

    @property
    def available(self) -> bool:
        return self.memory is not None

    def __enter__(self) -> Tools:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def sync_turn(self, user: str, assistant: str, session: str = "") -> None:
        """A turn needs nothing: sessions are read when they rest."""

    @staticmethod
    def prompt_block() -> str:
        return "A memory of facts and former conversations can be searched with " + ", ".join(t["name"] for t in Tools.schemas()) + "."

    @staticmethod
    def schemas() -> list[dict]:
        """The tools' names, what they do and their arguments."""
        text, number = {"type": "string"}, {"type": "integer", "default": 10}
        tool = lambda name, says, need, **args: {"name": name, "description": says, "parameters": {"type": "object", "properties": args, "required": need}}
        return [
            tool("unified_search", "Search facts and conversations.", ["query"], query=text, limit=number, agent_id=text),
            tool("graph_index", "Index a folder of texts.", ["path"], path=text, project_name=text, reindex={"type": "boolean", "default": False}),
            tool("graph_search", "Search facts and what they are related to.", ["query", "project"], query=text, project=text, top_k=number, relation_type={"type": "string", "enum": RELATION_KINDS}),
        ]

    def call(self, name: str, args: dict | str) -> str:
        """A tool's answer as JSON. What goes wrong inside is logged; the answer says no more than that it did."""
        tool = {"unified_search": self.unified_search, "graph_index": self.graph_index, "graph_search": self.graph_search}.get(name)
        if tool is None:
            return json.dumps({"error": f"Unknown tool: {name}"})
        if not self.available:
            return json.dumps({"error": "Memory not initialized"})
        try:
            return json.dumps(tool(json.loads(args) if isinstance(args, str) else args), ensure_ascii=False, default=str)
        except Exception:
            logging.getLogger(__name__).exception("tool %s failed", name)
            return json.dumps({"error": "Internal error occurred"})

    def _question(self, query: str) -> DataFrame:
        spark = self.memory.facts.sparkSession
        q = spark.createDataFrame([(0, query)], "query_id long, query string")
        return q.withColumn("query", expand_query("query", self.synonyms)) if self.synonyms else q

    def _kept(self, key: str, make: Callable[[], Any]) -> Any:
        if (found := self.results.get(key)) is None:
            found = make()
            self.results.put(key, found)
        return found

    @staticmethod
    def _empty(query: str) -> bool:
        words = query.strip()
        return len(words) < 2 or not any(c.isascii() and c.isalnum() or "ء" <= c <= "ي" for c in words)

    def unified_search(self, args: dict) -> dict:
        """Facts by vector and messages by text; where no message has the words of an Arabic question, by their letters."""
        query, limit, agent = args.get("query") or "", int(args.get("limit", 10)), args.get("agent_id")
        if self._empty(query):
            return {"query": query, "results": [], "total": 0}

        def make() -> list[dict]:
            rows = self._warm().ask(self._question(query), limit, self.least)
            if any(c in ARABIC_SIGNS[4:] for c in query) and not any(r["type"] == "session" for r in rows):
                said = self.memory.messages.filter(F.col("role").isin("user", "assistant"))
                found = fulltext.phrase_search(said, query, "content", norm_fts, [F.desc("timestamp"), F.desc("id")], limit)
                known = {r["content"] for r in rows}
                for i, r in enumerate(found.collect()):
                    if r["content"] not in known:
                        rows.append({"content": r["content"], "similarity": 0.70 - 0.03 * i, "type": "session"})
                rows = sorted(rows, key=lambda r: -r["similarity"])[:limit]
            return [{"similarity": r["similarity"], "content": r["content"], "type": r["type"]} for r in rows]

        found = self._kept(Results.key("unified", query, limit), make)
        found = [{**r, "agent_id": self.agent} for r in found if agent in (None, "all", "*") or agent == self.agent]
        return {"query": query, "results": found, "total": len(found)}

    def graph_search(self, args: dict) -> dict:
        """Facts and what they are related to in the memory itself, or the closest nodes of a stored project, as it was saved last."""
        query, project, top, kind = args.get("query") or "", args.get("project") or self.main, int(args.get("top_k", 10)), args.get("relation_type")
        if self._empty(query):
            return {"query": query, "project": project, "results": [], "total": 0}
        if project != self.main:
            return {"query": query, "project": project, **self._in_project(query, project, top, kind)}

        def make() -> list[dict]:
            memory = self.memory if kind is None else search.Memory(self.memory.facts, self.memory.relations.filter(F.col("kind") == kind), self.memory.messages)
            return [r.asDict() for r in search.graph_search(memory, self._question(query), top, self.least).drop("query_id").orderBy("rank").collect()]

        rows = self._kept(Results.key("graph", query, project, top, kind), make)
        found = [{"id": r["id"], "similarity": r["similarity"], "content": r["content"], "type": "fact"} for r in rows]
        return {"query": query, "project": project, "results": found, "total": rows[0]["total"] if rows else 0}

    def _in_project(self, query: str, project: str, top: int, kind: str | None) -> dict:
        held = self._graphs().get(project) if self.store else None
        if held is None:
            return {"error": f"No project: {project}", "results": [], "total": 0}

        def make() -> tuple[list[dict], int]:
            vector = search.asked(self._question(query), 2).first()["embedding"]
            return projects.answer(held, vector, top, self.least, kind)

        rows, total = self._kept(Results.key("project", query, project, held.version, top, kind), make)
        return {"results": rows, "total": total}

    def graph_index(self, args: dict) -> dict:
        """Index a folder below a project's name; what was asked before is forgotten."""
        spark, path = self.memory.facts.sparkSession, args["path"]
        name = args.get("project_name") or path.rstrip("/").rsplit("/", 1)[-1]
        row = search.graph_index(spark, path, self.store, name).first().asDict()
        self.results.clear()  # the project itself is seen by its version
        return {"project": name, **row}

    def context(self, query: str) -> str:
        """What is worth knowing before an answer, as text; nothing for a question too short to tell."""
        if len(query.strip()) < 3 or not self.available:
            return ""

        def make() -> str:
            found = search.context(self.memory, self._question(query), self.as_of, least=self.least).collect()
            return found[0]["context"] if found else ""

        return self._kept(Results.key("context", query), make)


def of_agent(rows: DataFrame, agent: str | None) -> DataFrame:
    """Rows with their agent's name, and only those that ``agent`` asks for."""
    return rank.of_agent(rows, agent)


def agent_stats(rows: DataFrame, column: str = "agent_id") -> DataFrame:
    """``agent_id, rows`` of all agents that a table names."""
    return rows.groupBy(F.coalesce(column, F.lit("")).alias("agent_id")).agg(F.count(F.lit(1)).alias("rows"))
