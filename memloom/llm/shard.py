"""Sharding by jump consistent hashing. DataFrame functions only.

The law is ``key``: the document id and the shard count decide, and one more
shard takes rows only into itself. There is no ring table: a 64-bit linear
congruential generator seeded with the id makes the jumps (Lamping and Veach,
2014), and one run up to ``shards + 1`` gives both the shard and the shard that
the row would have with one more.

Spark's ANSI arithmetic refuses to wrap around, so the generator's state is held
as three limbs of 24, 24 and 16 bits, whose products fit in a long.

Slots number the rows of a shard from 0 without gaps. Each shard is cut into
``BUCKETS`` buckets by the generator's state and the text's checksum; rows are
numbered inside a bucket, by id, checksum and size, and start at the sum of the
buckets before it. That table of counts has ``shards * BUCKETS`` rows at most, so
it may be broadcast.

Rows are counted by id, checksum and size first, so an id with more than 1/256 of
all rows in a bucket is known (there are 256 of them at most, whatever the input).
Its rows are numbered apart, in ``PARTS`` ranges of the checksum, and equal rows
beyond that share in chunks, by their places in a written table: no task numbers
more than a bucket, a part or a chunk.

Defined results: a null id counts as 0, a null text as empty (size 8, checksum
0); rows that repeat an id share its shard and get slots of their own, ordered
by checksum and size; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.shared import cut

BUCKETS = 1024
PARTS = 256
HOT_SHARE = 256
#: Fixed value: the multiplier of the jump hash's generator, 2862933555777941757, as limbs from low to high.
MULTIPLIER = 2862933555777941757
_A = [MULTIPLIER & 0xFFFFFF, MULTIPLIER >> 24 & 0xFFFFFF, MULTIPLIER >> 48]
_LOW = 0xFFFFFF


def _limbs(key: Column) -> Column:
    """A long, read as unsigned, as three limbs."""
    return F.struct(key.bitwiseAND(F.lit(_LOW)).alias("k0"), F.shiftrightunsigned(key, 24).bitwiseAND(F.lit(_LOW)).alias("k1"), F.shiftrightunsigned(key, 48).alias("k2"))


def _next(k: Column) -> Column:
    """The generator's next state, MULTIPLIER * k + 1 modulo 2**64."""
    r0 = k["k0"] * _A[0] + 1
    r1 = k["k0"] * _A[1] + k["k1"] * _A[0] + F.shiftright(r0, 24)
    r2 = k["k0"] * _A[2] + k["k1"] * _A[1] + k["k2"] * _A[0] + F.shiftright(r1, 24)
    return F.struct(r0.bitwiseAND(F.lit(_LOW)).alias("k0"), r1.bitwiseAND(F.lit(_LOW)).alias("k1"), r2.bitwiseAND(F.lit(0xFFFF)).alias("k2"))


def jump(key: Column, shards: int) -> Column:
    """Struct ``(shard, grown)``: the shard of ``key`` among ``shards`` and among one more."""
    zero = F.lit(0).cast("long")
    start = F.struct(_limbs(key).alias("k"), zero.alias("j"), zero.alias("shard"), zero.alias("grown"))

    def step(s: Column, _: Column) -> Column:
        k = _next(s["k"])
        top = F.shiftleft(k["k2"], 15).bitwiseOR(F.shiftright(k["k1"], 9))  # the upper 31 bits
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (top + 1).cast("double"))).cast("long")
        small, large = s["j"] < shards, s["j"] <= shards
        moved = F.struct(k.alias("k"), j.alias("j"), F.when(small, s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown"))
        return F.when(large, moved).otherwise(s)

    # j grows with each jump, so shards + 1 steps reach the end from anywhere.
    last = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(last["shard"].cast("int").alias("shard"), last["grown"].cast("int").alias("grown"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col), F.lit(0)).cast("long")
    first = _next(_limbs(key))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("_key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), jump(key, shards).alias("_j"), first["k0"].alias("_k0"))
    bucket = (F.pmod("_k0", F.lit(buckets // 8)) * 8 + F.pmod("text_crc32", F.lit(8))).cast("int")
    rows = rows.select("doc_id", "_key", "size", "text_crc32", F.col("_j.shard").alias("shard"), F.col("_j.grown").alias("grown_shard"), bucket.alias("_b"))
    group = ["shard", "_b", "_key", "text_crc32", "size"]
    groups = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "shard-groups")
    counts = groups.groupBy("shard", "_b").agg(F.sum("_n").alias("_n"))
    # shards * buckets rows at most, whatever the input.
    starts = F.broadcast(_before(counts, ["shard"], ["_b"]).select("shard", "_b", F.col("_before").alias("_start")))
    floor = max(2, (groups.agg(F.sum("_n")).first()[0] or 0) // HOT_SHARE)
    hot = cut(groups.groupBy("shard", "_b", "_key").agg(F.sum("_n").alias("_n")).filter(F.col("_n") > floor), "shard-hot")
    if hot.isEmpty():
        out = rows.withColumn("_place", _numbered("shard", "_b")).join(starts, ["shard", "_b"])
    else:
        out = _with_hot(rows, groups, hot, starts, floor)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_place")).cast("long").alias("slot"), "grown_shard")


def _numbered(*by: str) -> Column:
    """Numbers from 0 in the order of a bucket's rows."""
    return F.row_number().over(Window.partitionBy(*by).orderBy("_key", "text_crc32", "size")) - 1


def _before(counts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``counts`` with ``_before``, the sum of ``_n`` before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def _with_hot(rows: DataFrame, groups: DataFrame, hot: DataFrame, starts: DataFrame, floor: int) -> DataFrame:
    """Rows with ``_start`` and ``_place``, where the keys in ``hot`` (256 at most) are numbered apart."""
    key, equal = ["shard", "_b", "_key"], ["shard", "_b", "_key", "text_crc32", "size"]
    part = F.shiftright(F.col("text_crc32"), 32 - PARTS.bit_length() + 1).alias("_part")
    keys = F.broadcast(hot.select(*key))
    # Other rows: those of smaller hot keys in the bucket come before them.
    lower = F.broadcast(hot.groupBy("shard", "_b").agg(F.collect_list(F.struct("_key", "_n")).alias("_hots")))
    cold = rows.join(keys, key, "left_anti").withColumn("_own", _numbered("shard", "_b")).join(lower, ["shard", "_b"], "left")
    skipped = F.aggregate(F.coalesce("_hots", F.array()), F.lit(0).cast("long"), lambda s, h: s + F.when(h["_key"] < F.col("_key"), h["_n"]).otherwise(0))
    cold = cold.join(starts, ["shard", "_b"]).withColumn("_place", F.col("_own") + skipped)
    # Hot keys: what is smaller in the bucket, then the parts before.
    near = groups.join(F.broadcast(hot.select("shard", "_b", F.col("_key").alias("_hot"))), ["shard", "_b"])
    smaller = near.groupBy("shard", "_b", F.col("_hot").alias("_key")).agg(F.sum(F.when(F.col("_key") < F.col("_hot"), F.col("_n")).otherwise(0)).alias("_less"))
    parts = groups.join(keys, key).groupBy(*key, part).agg(F.sum("_n").alias("_n"))
    # 256 keys of PARTS parts at most.
    firsts = F.broadcast(_before(parts, key, ["_part"]).join(smaller, key).select(*key, "_part", (F.col("_before") + F.col("_less")).alias("_first")))
    large = cut(groups.filter(F.col("_n") > floor), "shard-large")
    marks = F.broadcast(large.select(*equal))
    held = rows.join(keys, key).select("*", part)
    above = F.broadcast(large.groupBy(*key, part).agg(F.collect_list(F.struct(F.struct("text_crc32", "size").alias("at"), "_n")).alias("_larges")))
    single = held.join(marks, equal, "left_anti").withColumn("_own", _numbered(*key, "_part")).join(above, [*key, "_part"], "left")
    own = F.struct("text_crc32", "size")
    skipped = F.aggregate(F.coalesce("_larges", F.array()), F.lit(0).cast("long"), lambda s, x: s + F.when(x["at"] < own, x["_n"]).otherwise(0))
    single = single.join(firsts, [*key, "_part"]).withColumn("_at", F.col("_own") + skipped)
    # Equal rows: any order will do, so they are dealt by their places in a written table, which stay the same.
    within = groups.join(F.broadcast(large.select(*key, part, F.struct("text_crc32", "size").alias("_large"))), key).filter(part == F.col("_part"))
    within = within.groupBy(*key, "_part", "_large").agg(F.sum(F.when(F.struct("text_crc32", "size") < F.col("_large"), F.col("_n")).otherwise(0)).alias("_within"))
    within = F.broadcast(within.select(*key, "_part", "_large.text_crc32", "_large.size", "_within"))
    same = cut(held.join(F.broadcast(large.select(*equal, F.ceil(F.col("_n") / floor).alias("_chunks"))), equal), "shard-equal")
    same = same.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    same = same.withColumn("_chunk", F.pmod(F.xxhash64("_file", "_row"), F.col("_chunks")))
    # 256 groups of at most 256 chunks, and a few.
    chunks = F.broadcast(_before(same.groupBy(*equal, "_chunk").agg(F.count(F.lit(1)).alias("_n")), equal, ["_chunk"]).select(*equal, "_chunk", "_before"))
    number = F.row_number().over(Window.partitionBy(*equal, "_chunk").orderBy("_file", "_row")) - 1
    same = same.withColumn("_own", number).join(chunks, [*equal, "_chunk"]).join(within, [*key, "_part", "text_crc32", "size"]).join(firsts, [*key, "_part"])
    same = same.withColumn("_at", F.col("_own") + F.col("_before") + F.col("_within"))
    columns = ["doc_id", "size", "text_crc32", "shard", "grown_shard", "_start", "_place"]
    placed = lambda df: df.join(starts, ["shard", "_b"]).withColumn("_place", F.col("_first") + F.col("_at")).select(*columns)
    return cold.select(*columns).unionByName(placed(single)).unionByName(placed(same))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 0) AS key, strlen(coalesce(text, '')) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS hx, strlen(coalesce(text, '')) AS n FROM documents),
tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
crc AS (
  SELECT rid, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, n + 1),
    lambda i: (ascii(hx[2 * i - 1]) - CASE WHEN hx[2 * i - 1] > '9' THEN 55 ELSE 48 END)::BIGINT * 16 + ascii(hx[2 * i]) - CASE WHEN hx[2 * i] > '9' THEN 55 ELSE 48 END),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc FROM d, tab),
jumps AS (
  SELECT rid, 0 AS n, (CASE WHEN key < 0 THEN key::HUGEINT + 18446744073709551616 ELSE key END)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT rid, n + 1, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT rid, n, j, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS k2 FROM jumps WHERE j <= 24)),
placed AS (
  SELECT d.doc_id, d.key, d.size, crc.crc AS text_crc32,
    (SELECT max(j) FROM jumps x WHERE x.rid = d.rid AND x.j < 24) AS shard,
    (SELECT max(j) FROM jumps x WHERE x.rid = d.rid AND x.j <= 24) AS grown_shard,
    ((SELECT k FROM jumps x WHERE x.rid = d.rid AND x.n = 1) % 16777216 % {BUCKETS // 8}) * 8 + crc.crc % 8 AS bucket
  FROM d JOIN crc USING (rid))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, key, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""
