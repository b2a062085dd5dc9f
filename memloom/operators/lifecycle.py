"""Near-duplicate grouping and merging, decisions and consolidation.

The reference order of both greedy scans is fixed to ascending ids. A scan's
leaders are then the lexicographically first maximal independent set of the
similarity graph: a node leads iff no smaller neighbour does. That set is found
in rounds of joins and needs no sequential pass; each round settles every node
whose smaller neighbours are settled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memloom.functions.gates import relation
from memloom.functions.models import Embedder, embed
from memloom.functions.text import norm_query
from memloom.operators import local
from memloom.operators.components import components
from memloom.operators.similarity import nearest, similar_pairs
from memloom.shared import cut, drop

#: Edges of a component that one task may scan.
MOST_LOCAL = 500_000


def leaders(nodes: DataFrame, edges: DataFrame, id_col: str = "id", fixed: str | None = None, rounds: int = 3, most: int = MOST_LOCAL) -> DataFrame:
    """``id, leads`` over edges ``src < dst``. Nodes with ``fixed`` lead from the start and before all others.

    A graph of ``most`` edges or fewer is scanned in one task. In a larger one, a
    round settles all nodes whose smaller neighbours are settled, and the
    neighbours of those that lead. After every ``rounds`` of them the parts that are
    still open fall into components; those of ``most`` edges or fewer are scanned in
    order, one task each, so long chains cost no rounds. Each round settles a node at
    least, so the end is always reached.
    """
    first = F.coalesce(F.col(fixed), F.lit(False)) if fixed else F.lit(False)
    state = nodes.select(F.col(id_col).alias("id"), first.alias("first"), F.when(first, F.lit(True)).alias("leads"))
    state = cut(state, "leaders")
    if fixed:  # edges go from what comes earlier; those between fixed nodes decide nothing
        is_fixed = lambda side: state.select(F.col("id").alias(side), F.col("first").alias(f"{side}_f"))
        e = edges.join(is_fixed("src"), "src").join(is_fixed("dst"), "dst").filter("NOT (src_f AND dst_f)")
        edges = e.select(F.when(F.col("dst_f"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("dst_f"), F.col("src")).otherwise(F.col("dst")).alias("dst"))
    edges = cut(edges.select("src", "dst"), "leader-edges")
    if edges.count() <= most:
        found = _scanned(edges, state)
        return state.join(found, "id", "left").select("id", F.coalesce("leads", "now", F.lit(True)).alias("leads"))

    def told(state: DataFrame) -> DataFrame:
        before = edges.join(state.select(F.col("id").alias("src"), F.col("leads").alias("l")), "src")
        return before.groupBy(F.col("dst").alias("id")).agg(F.max(F.coalesce("l", F.lit(False))).alias("led"), F.count_if(F.col("l").isNull()).alias("open"))

    def replaced(state: DataFrame, seen: DataFrame, leads: Column) -> DataFrame:
        after = cut(state.join(seen, "id", "left").select("id", "first", F.coalesce("leads", leads).alias("leads")), "leaders")
        drop(state)
        return after

    led, free = F.coalesce("led", F.lit(False)), F.coalesce("open", F.lit(0)) == 0
    while True:
        for _ in range(rounds):
            state = replaced(state, told(state), F.when(~led & free, F.lit(True)).when(led, F.lit(False)))
            state = replaced(state, told(state), F.when(led, F.lit(False)))
            if state.filter(F.col("leads").isNull()).isEmpty():
                drop(edges)
                return state.select("id", "leads")
        # Leaders' neighbours are settled, so only open nodes decide about open nodes.
        still = state.filter(F.col("leads").isNull()).select("id")
        live = edges.join(still.select(F.col("id").alias("src")), "src", "left_semi").join(still.select(F.col("id").alias("dst")), "dst", "left_semi")
        live = cut(live, "leader-open")
        part = components(live, "src", "dst").select(F.col("node").alias("src"), "label")
        held = live.join(part, "src")
        small = held.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("label")

        def scan(group: pa.Table) -> pa.Table:
            src, dst = group.column("src").to_numpy(), group.column("dst").to_numpy()
            ids = np.unique(np.concatenate([src, dst]))
            return pa.table({"id": ids, "now": local.greedy_leaders(ids, src, dst)})

        found = held.join(small, "label", "left_semi").groupBy("label").applyInArrow(scan, f"id {dict(state.dtypes)['id']}, now boolean")
        state = replaced(state, found, F.col("now"))
        drop(live)


def _scanned(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``id, now``: which ends of the edges lead, from one scan in one task."""
    marked = edges.join(state.filter("first").select(F.col("id").alias("src"), F.lit(True).alias("fixed")), "src", "left")
    kind, arrow = dict(state.dtypes)["id"], to_arrow_type(state.schema["id"].dataType)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=pa.schema([("src", arrow), ("dst", arrow), ("fixed", pa.bool_())]))
        src, dst, fixed = held.column("src").to_numpy(), held.column("dst").to_numpy(), held.column("fixed").is_valid().to_numpy(zero_copy_only=False)
        ids, below = np.unique(np.concatenate([src, dst])), np.unique(dst[fixed])
        led = np.isin(ids, below)
        free = ~np.isin(src, np.concatenate([below, src[fixed]])) & ~np.isin(dst, below)
        rest = ids[~led]
        leads = np.zeros(len(ids), bool)
        leads[~led] = local.greedy_leaders(rest, src[free], dst[free])
        yield pa.record_batch([pa.array(ids, arrow), pa.array(leads)], names=["id", "now"])

    return cut(marked.select(F.col("src").cast(kind), F.col("dst").cast(kind), "fixed").coalesce(1).mapInArrow(scan, f"id {kind}, now boolean"), "scanned")


def leader_groups(vectors: DataFrame, least: float = 0.85, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``leader, id`` of groups of two or more: each member with the smallest leader that it is close to."""
    edges = cut(similar_pairs(vectors, least, id_col=id_col, vector_col=vector_col).select("src", "dst"), "pairs")
    lead = leaders(vectors, edges, id_col)
    heads, rest = lead.filter("leads").select(F.col("id").alias("src")), lead.filter("NOT leads").select(F.col("id").alias("dst"))
    members = edges.join(heads, "src").join(rest, "dst").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("leader"))
    own = members.select("leader").distinct().select("leader", F.col("leader").alias("id"))
    return members.select("leader", "id").unionByName(own)


def merge_targets(vectors: DataFrame, least: float = 0.88, id_col: str = "id", vector_col: str = "embedding", existing: str = "existing") -> DataFrame:
    """``id, target``: where each row goes. Existing rows stay; a new one goes to the closest leader before it, or becomes one."""
    pairs = cut(similar_pairs(vectors, least, id_col=id_col, vector_col=vector_col), "pairs")
    lead = leaders(vectors, pairs, id_col, fixed=existing)
    mark = vectors.select(F.col(id_col).alias("id"), F.coalesce(F.col(existing), F.lit(False)).alias("old"))
    lead = cut(lead.join(mark, "id"), "leaders")
    ways = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    heads = lead.filter("leads").select(F.col("id").alias("src"), F.col("old").alias("head_old"))
    rest = lead.filter("NOT leads").select(F.col("id").alias("dst"))
    options = ways.join(heads, "src").join(rest, "dst").filter("head_old OR src < dst")
    best = options.groupBy(F.col("dst").alias("id")).agg(F.max_by("src", F.struct(F.round("weight", 9).alias("w"), (-F.col("src")).alias("s"))).alias("target"))
    return lead.select("id").join(best, "id", "left").select("id", F.coalesce("target", "id").alias("target"))


def merged(facts: DataFrame, targets: DataFrame, most_aliases: int = 10) -> DataFrame:
    """Facts after the merge: the target's own fields, the largest importance (5 at most) and trust, all sightings and up to ten other wordings."""
    rows = facts.join(targets, "id")
    own = F.col("id") == F.col("target")
    offered = F.greatest(F.col("importance"), F.bround(F.col("trust") * 5, 0).cast("int"))
    whole = rows.groupBy("target").agg(
        F.max(F.when(own, F.col("full_key"))).alias("full_key"),
        F.max(F.when(own, F.col("category"))).alias("category"),
        F.least(F.lit(5), F.max(F.when(own, F.col("importance")).otherwise(offered))).alias("importance"),
        F.max("trust").alias("trust"),
        F.count(F.lit(1)).alias("seen_count"),
    )
    # Only the first wordings are kept: each task ranks its own before they meet, however many a target has.
    place = F.row_number().over(Window.partitionBy("target").orderBy("id"))
    first = rows.filter(~own).select("target", "id", "full_key").withColumn("place", place).filter(F.col("place") <= most_aliases)
    aliases = first.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "full_key"))), lambda x: x["full_key"]).alias("aliases"))
    none = F.array().cast("array<string>")
    return whole.join(aliases, "target", "left").select(F.col("target").alias("id"), "full_key", "category", "importance", "trust", "seen_count", F.coalesce("aliases", none).alias("aliases"))


def decisions(candidates: DataFrame, facts: DataFrame, label: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.5, same: float = 0.95, k: int = 3, **how) -> DataFrame:
    """``id, best, similarity, decision`` of each candidate. ``label`` adds a model's ``label`` to pairs; without it there is no answer."""
    from memloom.functions.gates import decision

    near = nearest(candidates, facts, k, least, **how).filter("rank = 1").select(F.col("query_id").alias("id"), F.col("id").alias("best"), "similarity")
    rows = candidates.select(F.col(how.get("id_col", "id")).alias("id")).join(near, "id", "left")
    rows = label(rows) if label else rows.withColumn("label", F.lit(None).cast("string"))
    return rows.select("id", "best", "similarity", decision(F.col("similarity"), F.col("label"), same).alias("decision"))


def decision_events(decided: DataFrame, candidates: DataFrame, ts: Column) -> DataFrame:
    """Store events of decisions. A contradiction ends the old fact and adds the new one; an added fact keeps its vector."""
    rows = decided.join(candidates, "id")
    up = rows.filter(F.col("decision").isin("add", "update", "contradict")).select(F.lit("upsert").alias("op"), F.when(F.col("decision") == "update", F.col("best")).otherwise(F.col("id")).alias("fact_id"), "full_key", "importance", "embedding", ts.alias("ts"), F.lit(None).cast("long").alias("superseded_by"))
    end = rows.filter("decision = 'contradict'").select(F.lit("invalidate").alias("op"), F.col("best").alias("fact_id"), F.lit(None).cast("string").alias("full_key"), F.lit(None).cast("int").alias("importance"), F.lit(None).cast("array<float>").alias("embedding"), ts.alias("ts"), F.col("id").alias("superseded_by"))
    return up.unionByName(end)


def longest(group: Column) -> Column:
    """The default summary of a group: its longest text, the first of equals."""
    return F.element_at(F.array_sort(group, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1)


def candidates(facts: DataFrame, max_facts: int = 10_000, protected: tuple[str, ...] = ("preference", "identity"), most: int | None = None) -> DataFrame:
    """Facts that may be consolidated, none while there are ``max_facts`` or fewer; with ``most``, the oldest of them in order."""
    plenty = facts.limit(max_facts + 1).count() > max_facts
    rows = facts.filter(~F.col("category").isin(*protected)) if plenty else facts.limit(0)
    return rows if most is None else rows.orderBy("created_at", "id").limit(most)


def consolidation(facts: DataFrame, max_facts: int = 10_000, least: float = 0.85, protected: tuple[str, ...] = ("preference", "identity"), most: int = 200) -> DataFrame:
    """The plan ``leader, source_ids, summary, category``; empty while there are few facts. Nothing is changed: see ``apply_consolidation``.

    A group's summary is the longest of its texts, cut to ``most`` characters; to
    let a model write it, judge the plan's column ``texts`` instead.
    """
    rows = candidates(facts, max_facts, protected)
    groups = leader_groups(rows, least)
    own = groups.join(rows.select("id", "full_key", "category"), "id")
    best = F.max_by("full_key", F.struct(F.length("full_key"), (-F.col("id")).alias("i")))
    lead = F.max(F.when(F.col("id") == F.col("leader"), F.col("category")))
    return own.groupBy("leader").agg(F.sort_array(F.collect_list("id")).alias("source_ids"), F.substring(best, 1, most).alias("summary"), lead.alias("category"))


def apply_consolidation(facts: DataFrame, plan: DataFrame, at: Column, make: Callable[[], Embedder] | None = None) -> tuple[DataFrame, DataFrame]:
    """The facts afterwards, with each summary in place of its sources, and the archive of the originals.

    A summary is embedded by the model that ``make`` builds; without one it keeps its leader's vector.
    """
    sources = plan.select("leader", "summary", F.explode("source_ids").alias("id"))
    archive = sources.join(facts, "id").select(F.concat_ws("_", F.lit("archive"), "leader", "id").alias("id"), F.to_json(F.struct("id", "full_key", "category")).alias("original_content"), F.col("summary").alias("compressed_content"), at.alias("compression_timestamp"), F.array(F.col("id")).alias("source_ids"), "category")
    rest = facts.join(sources.select("id"), "id", "left_anti")
    new = plan.join(facts.withColumnRenamed("id", "leader").drop("category"), "leader").withColumn("full_key", F.col("summary")).withColumnRenamed("leader", "id")
    if make is not None:
        new = embed(new, norm_query("full_key"), make=make)
    return rest.unionByName(new.select(*facts.columns)), archive


def typed_relations(pairs: DataFrame, least: float = 0.7, classify: Callable[[Column, Column], Column] = relation) -> DataFrame:
    """``from_id, to_id, kind, weight`` of pairs ``from_id, to_id, a, b`` that are classified surely enough."""
    got = pairs.withColumn("_r", classify(F.col("a"), F.col("b"))).filter(F.col("_r.confidence") >= least)
    return got.select("from_id", "to_id", F.col("_r.kind").alias("kind"), F.col("_r.confidence").alias("weight"))
