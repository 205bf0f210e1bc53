"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a hash for a record's key; the record goes to the shard with the best
draw. A draw depends on the key and on that shard alone, so one more shard takes records
only into itself, a removed shard gives away only its own, and a shard whose weight
changes trades only with the others. With equal weights the largest MD5 wins. With
weights, a draw u in (0, 1) counts as -ln(u) / weight and the least wins, which gives
each shard its weight's share.

A record's slot is its place in its shard, in order of its key's hash. Equal records
(key, size, digest) are counted first, so a key that holds a third of all rows is one
row until the end, and long runs of slots are written in pieces by many tasks. Buckets of
the hash are summed per shard, so no task sees a shard.

Edge cases: a null key is a key of its own; null text has size 1 and the checksum of the
empty text; repeated rows go to one shard and get slots of their own; equal texts under
different keys are placed apart, as only keys decide; an empty table gives an empty
result; a shard without rows has no slots; other columns are kept by assign() and not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import materialize

SHARDS = 16
SEED = "shard-1"
#: Hex digits of the key's hash that make a bucket: 4096 buckets a shard.
BUCKET = 3
#: Equal records that one task writes at most.
PIECE = 100_000


def _key(key: Column, seed: str) -> Column:
    return F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"))


def _draw(key: Column, shard: int, weight: float | None) -> Column:
    """A struct whose largest wins: the hash, or the weighted score; then the shard."""
    h = F.md5(F.concat(key, F.lit(str(shard))))
    if weight is not None:
        u = (F.conv(F.left(h, F.lit(13)), 16, 10).cast("double") + 0.5) / float(1 << 52)
        h = F.lit(float(weight)) / -F.log(u)  # the least -ln(u) / weight; u is below 1
    return F.struct(h.alias("draw"), F.lit(shard).alias("shard"))


def best_draw(key: Column, weights: list[float], seed: str = SEED) -> Column:
    """The winning draw of a key. Shards of weight 0 take nothing."""
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    peak = max(weights)
    even = all(w == peak for w in weights)
    draws = [_draw(_key(key, seed), s, None if even else w / peak) for s, w in enumerate(weights) if w > 0]
    return F.greatest(*draws) if len(draws) > 1 else draws[0]


def assign(rows: DataFrame, key: str, weights: list[float] | int = SHARDS, seed: str = SEED, name: str = "shard") -> DataFrame:
    """rows plus their shard, 0 to n - 1. weights: one per shard, or the number of equal shards."""
    weights = [1.0] * weights if isinstance(weights, int) else list(weights)
    return rows.withColumn(name, best_draw(F.col(key), weights, seed)["shard"])


def write_shards(rows: DataFrame, path: str, key: str, weights: list[float] | int = SHARDS, seed: str = SEED, files: int = 8) -> None:
    """Parquet under path/shard=N, each shard as `files` files at least, dealt by a hash of the row's
    key and, against hot keys, of the row's place in its input partition."""
    part = F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(files))
    placed = assign(rows, key, weights, seed).withColumn("_file", part)
    n = len(weights) if not isinstance(weights, int) else weights
    placed.repartition(n * files, "shard", "_file").drop("_file").write.mode("overwrite").partitionBy("shard").parquet(path)


def slots(assigned: DataFrame, key: str, seed: str = SEED) -> DataFrame:
    """assigned (key, shard, other columns) plus slot: gapless from 0 in each shard, in order of
    the key's hash, the key and the other columns. Equal rows differ by their slots alone."""
    cols = assigned.columns
    counted = assigned.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_h", F.md5(_key(F.col(key), seed))).withColumn("_bucket", F.left("_h", F.lit(BUCKET)))
    counted = materialize(counted)
    up = Window.unboundedPreceding
    sums = counted.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(up, -1))
    sums = sums.select("shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.sum("_n").over(Window.partitionBy("shard", "_bucket").orderBy("_h", key, *(c for c in cols if c not in (key, "shard"))).rowsBetween(up, -1))
    at = counted.withColumn("_at", F.coalesce(within, F.lit(0))).join(sums, ["shard", "_bucket"])
    at = at.select(*cols, (F.col("_base") + F.col("_at")).alias("slot"), "_n")
    # long runs in pieces, so that many tasks write them
    run = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    one, many = at.where("_n = 1").drop("_n"), at.where("_n > 1")
    pieces = many.withColumn("_k", F.explode(run(F.ceil(F.col("_n") / PIECE)))).repartition("shard", key, "_k")
    length = F.least(F.lit(PIECE).cast("long"), F.col("_n") - F.col("_k") * PIECE)
    pieces = pieces.withColumn("_i", F.explode(run(length)))
    return one.unionByName(pieces.select(*cols, (F.col("slot") + F.col("_k") * PIECE + F.col("_i")).alias("slot")))


def moves(rows: DataFrame, key: str, old: list[float] | int, new: list[float] | int, seed: str = SEED) -> DataFrame:
    """Rows per (shard under old, shard under new): what a change of shards or weights moves."""
    both = assign(assign(rows, key, old, seed, "old_shard"), key, new, seed, "new_shard")
    return both.groupBy("old_shard", "new_shard").agg(F.count(F.lit(1)).alias("n"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard."""
    key = F.col("doc_id")
    best = best_draw(key, [1.0] * shards, seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), best.alias("_best"))
    grown = F.greatest(F.col("_best"), _draw(_key(key, seed), shards, None))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("_best")["shard"].alias("shard"), grown["shard"].alias("grown_shard"))
    return slots(rows, "doc_id", seed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
