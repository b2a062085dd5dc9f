"""The fact store as an append-only log of events, and the folds that read it.

Stock Spark has no MERGE over Parquet, so nothing is updated in place: facts,
invalidations, relations and state are appended, and the present is a fold. Folds
are plain aggregates: a key with any number of events costs one partial row a task.
Only where a log has invalidations are events put in order, and a key's events are
divided by days for that.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import fact_hash
from memloom.operators.snapshot import keys
from memloom.schema import MISTAKE_CATEGORIES, SEVERITIES
from memloom.shared import first_rows


def epochs(log: DataFrame, key: str = "fact_hash", ts: str = "ts", op: str = "op") -> DataFrame:
    """The log with ``epoch``: how many invalidations of the key came before. An upsert after one starts a new fact.

    Those of earlier days are counted once a day, those of the same day in order, so
    no task orders more than a key's events of one day.
    """
    ends = F.col(op) == "invalidate"
    day = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 86_400_000_000)
    kept = F.struct(*(F.col(f"`{c}`") for c in log.columns))
    rows = log.select(kept.alias("row"), F.col(key).alias("k"), day.alias("d"), F.col(ts).alias("t"), F.col("seq").alias("s"), ends.cast("long").alias("e"))
    by_day = rows.filter("e = 1").groupBy("k", "d").agg(F.count(F.lit(1)).alias("n"))
    # From the day of its invalidations on, a key has an epoch more for each.
    later = Window.partitionBy("k").orderBy("d")
    spans = by_day.select("k", F.col("d").alias("since"), F.sum("n").over(later).alias("before"), F.lead("d").over(later).alias("until"))
    before = Window.partitionBy("k", "d").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.coalesce(F.sum("e").over(before), F.lit(0)))
    spans = spans.withColumnRenamed("k", "of")
    held = rows.join(spans, (F.col("k") == F.col("of")) & (F.col("d") > F.col("since")) & (F.col("until").isNull() | (F.col("d") <= F.col("until"))), "left")
    return held.select("row.*", (F.col("here") + F.coalesce("before", F.lit(0))).alias("epoch"))


def fold_facts(log: DataFrame) -> DataFrame:
    """Facts from upserts ``full_key, category, importance, embedding, aliases, session_id, source, ts, seq`` and invalidations (``op``).

    The first upsert of an epoch gives category, session and source; importance is
    the largest, vector and aliases the latest that are not null.
    """
    log = log.withColumn("fact_hash", fact_hash("full_key"))
    log = epochs(log) if "op" in log.columns else log.withColumn("op", F.lit("upsert")).withColumn("epoch", F.lit(0).cast("long"))
    up = F.col("op") == "upsert"
    at = F.struct("ts", "seq")
    first = lambda c: F.min_by(c, F.when(up, at)).alias(c)
    last = lambda c: F.max_by(c, F.when(up & F.col(c).isNotNull(), at)).alias(c)
    here = lambda f: [f(c) for c in ("category", "session_id", "source") if c in log.columns]
    new = [last(c) for c in ("embedding", "aliases") if c in log.columns]
    more = [F.max(F.when(~up, F.col("superseded_by"))).alias("superseded_by")] if "superseded_by" in log.columns else []
    out = log.groupBy("fact_hash", "epoch").agg(
        first("full_key"), *here(first), *new, *more,
        F.max(F.when(up, F.col("importance"))).alias("importance"),
        F.count_if(up).alias("seen_count"),
        F.min(F.when(up, F.col("ts"))).alias("created_at"),
        F.max(F.when(up, F.col("ts"))).alias("last_seen_at"),
        F.max(F.when(~up, F.col("ts"))).alias("valid_to"),
    )
    return out.filter("seen_count > 0").withColumn("valid_from", F.col("created_at"))


def sightings(log: DataFrame) -> DataFrame:
    """Upserts as facts of one sighting each, that ``merged`` brings together: of a part of a log, or of a part and what was merged before."""
    at = F.struct("ts", "seq")
    return log.select(fact_hash("full_key").alias("fact_hash"), "full_key", "category", "source", F.col("importance").cast("int").alias("importance"), F.lit(1).cast("long").alias("seen_count"), at.alias("first"), at.alias("last"))


def merged(facts: DataFrame) -> DataFrame:
    """One fact a hash, from parts in any order: what the first sighting said, the largest importance, all sightings.

    Merging parts and merging what comes of it gives what merging all at once gives, so a store
    without invalidations can be kept as a snapshot (``memloom.operators.snapshot``).
    """
    first = [F.min_by(c, F.struct("first", *(x for x in ("full_key", "category", "source")))).alias(c) for c in ("full_key", "category", "source")]
    return facts.groupBy(*keys(facts, "fact_hash")).agg(*first, F.max("importance").alias("importance"), F.sum("seen_count").alias("seen_count"), F.min("first").alias("first"), F.max("last").alias("last"))


def live(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("valid_to").isNull())


def by_id(facts: DataFrame, *ids: int) -> DataFrame:
    """Live facts by their ids."""
    return live(facts).filter(F.col("id").isin(*ids))


def by_session(facts: DataFrame, session: str) -> DataFrame:
    return live(facts).filter(F.col("session_id") == session)


def latest(rows: DataFrame, keys: list[str], ts: str = "ts", gone: Column | None = None) -> DataFrame:
    """The last row of each key; keys whose last row is ``gone`` (a delete) are left out."""
    out = first_rows(rows, [F.col(k) for k in keys], [F.desc(ts), F.desc("seq") if "seq" in rows.columns else F.lit(1)])
    return out if gone is None else out.filter(~gone)


def relations(log: DataFrame) -> DataFrame:
    """Relations by ``from_id, to_id, kind``; the last row wins, ``deleted`` rows take them away."""
    return latest(log, ["from_id", "to_id", "kind"], gone=F.coalesce(F.col("deleted"), F.lit(False)))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``old`` and, of the rows of ``new``, the first of each key that ``old`` lacks."""
    fresh = first_rows(new, [F.col(k) for k in keys], order).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def not_yet_known(new: DataFrame, known: DataFrame, key: str = "full_key", hashes: str = "fact_hash") -> DataFrame:
    """Rows whose normalised key was not indexed before, the first of each."""
    rows = new.withColumn(hashes, fact_hash(key)).join(known.select(hashes), hashes, "left_anti")
    return first_rows(rows, [F.col(hashes)], [F.col(c) for c in ("ts", "seq", "id", key) if c in new.columns])


def forgotten(known: DataFrame, gone: DataFrame, hashes: str = "fact_hash") -> DataFrame:
    """What is left of the known hashes after those of removed facts are taken out, so these may come again."""
    return known.join(gone.select(hashes), hashes, "left_anti")


def audit(log: DataFrame) -> DataFrame:
    """Audit rows ``event_type, details, created_at`` of a fact log: one for every invalidation."""
    end = log.filter(F.col("op") == "invalidate")
    details = F.to_json(F.struct(fact_hash("full_key").alias("fact_hash"), F.col("superseded_by")))
    return end.select(F.lit("fact_invalidated").alias("event_type"), details.alias("details"), F.col("ts").alias("created_at"))


def append_audit(rows: DataFrame, path: str) -> bool:
    """Append audit rows. An audit never stops what it tells of: a failure is logged, and False is returned."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:
        logging.getLogger(__name__).exception("audit rows were not written")
        return False
    return True


def by_category(facts: DataFrame, category: str, most: int = 100) -> DataFrame:
    return live(facts).filter(F.col("category") == category).orderBy(F.desc("importance"), "id").limit(most)


def store_stats(facts: DataFrame, relations: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: ``total, live, archived, relations, sessions``."""
    f = facts.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("valid_to").isNull()).alias("live"))
    one = f.crossJoin(relations.agg(F.count(F.lit(1)).alias("relations"))).crossJoin(sessions.agg(F.count(F.lit(1)).alias("sessions")))  # one row each
    return one.select("total", "live", (F.col("total") - F.col("live")).alias("archived"), "relations", "sessions")


def enriched(facts: DataFrame, stored: DataFrame, fact_entities: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with trust, category and entities of the stored row with the same content."""
    named = fact_entities.join(entities, "entity_id").groupBy("fact_id").agg(F.sort_array(F.collect_set(F.struct("name", "entity_type"))).alias("entities"))
    found = stored.select(F.col("content").alias("full_key"), "fact_id", "trust_score", F.col("category").alias("stored_category")).join(named, "fact_id", "left").drop("fact_id")
    out = facts.join(found, "full_key", "left")
    return out.withColumn("category", F.coalesce("stored_category", "category")).drop("stored_category")


def with_trust(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes take over the stored trust where it differs, and the larger importance."""
    known = stored.groupBy(F.col("content").alias("known_content")).agg(F.max("trust_score").alias("known_trust"))
    out = nodes.alias("n").join(known.alias("k"), F.col("n.content") == F.col("k.known_content"), "left")
    trust = F.col("k.known_trust")
    new = {"importance": F.greatest("n.importance", F.bround(trust * 5, 0).cast("int")), "trust": F.coalesce(trust, F.col("n.trust"))}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"n.`{c}`") for c in nodes.columns))


# Mistakes: another log with its own fold.


def fold_mistakes(log: DataFrame) -> DataFrame:
    """Mistakes by description and session: the first record's fields and how often it recurred; unknown categories and severities get the defaults."""
    at = F.struct("ts", "seq")
    first = [F.min_by(c, at).alias(c) for c in log.columns if c not in ("description", "session_id", "ts", "seq", "category", "severity")]
    category = F.when(F.col("category").isin(MISTAKE_CATEGORIES), F.col("category")).otherwise("other")
    severity = F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise("medium")
    return log.groupBy("description", "session_id").agg(
        *first, F.min_by(category, at).alias("category"), F.min_by(severity, at).alias("severity"), F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("recurrence_count")
    )


def filtered(notes: DataFrame, category: str | None = None, severity: str | None = None, session_id: str | None = None) -> DataFrame:
    for name, value in (("category", category), ("severity", severity), ("session_id", session_id)):
        if value is not None:
            notes = notes.filter(F.col(name) == value)
    return notes


def recurring(notes: DataFrame, least: int = 2) -> DataFrame:
    return notes.filter(F.col("recurrence_count") >= least).orderBy(F.desc("recurrence_count"), F.desc("created_at"), "description", "session_id")


def verified(notes: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Notes with ``fix_verified`` set where ``ids`` has them."""
    known = ids.select(F.col(id_col).alias("known")).distinct()
    out = notes.alias("n").join(known.alias("k"), F.col(f"n.{id_col}") == F.col("k.known"), "left")
    told = F.col("k.known").isNotNull() | F.coalesce(F.col("n.fix_verified"), F.lit(False))
    return out.select(*(told.alias(c) if c == "fix_verified" else F.col(f"n.`{c}`") for c in notes.columns))


def without(notes: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Notes without those that ``ids`` names."""
    return notes.join(ids.select(id_col), id_col, "left_anti")


def mistake_stats(notes: DataFrame) -> DataFrame:
    """``category, severity, level, notes, recurring, verified``: the whole, each category and each severity in one pass of grouping sets."""
    cube = notes.groupingSets([[], ["category"], ["severity"]], "category", "severity")
    told = F.coalesce(F.col("fix_verified"), F.lit(False)) if "fix_verified" in notes.columns else F.lit(False)
    return cube.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("notes"), F.count_if(F.col("recurrence_count") > 1).alias("recurring"), F.count_if(told).alias("verified"))
