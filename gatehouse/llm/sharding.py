"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the largest score -weight / ln(u), where u in (0, 1) comes from XXH64 of the record's
key and the shard's name.  The winner depends on the key and the set of shards alone: another shard takes records
only into itself, about its share of the weight, and a shard that goes gives away only its own.

Winners are a map over single rows, in JVM expressions; ties go to the earlier shard.  Slots number a shard's records
from 0 without gaps, in an order (bucket, key) that no single task has to sort: rows are written once, as numbers; each
shard is cut into buckets by a hash of the row's place in that table, so a key with a third of all rows spreads like
any other; the buckets' counts give each its first slot by broadcast, and a window numbers the rows in each bucket.
There are ``BUCKETS`` of them a shard or more, so that one holds about ``BUCKET_ROWS`` rows; their counts have one row
for a million rows of the table (1.6 MB for 10**11).  A slot hangs on how the table was read, a shard on the key alone.

Repeated rows share a shard and take one slot each; a null key is hashed as a value of its own.  Null texts count as
empty.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

BUCKETS, BUCKET_ROWS = 64, 1_000_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number (from 0) of the shard that wins ``key``; a shard of weight 0 wins nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights are not negative, and one is positive")
    named = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            unit = (F.shiftrightunsigned(F.xxhash64(named, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)
            scores.append(F.struct((F.lit(-float(weight)) / F.log(unit)).alias("score"), F.lit(-shard).alias("shard")))
    return (-(F.array_max(F.array(*scores))["shard"])).cast("int") if len(scores) > 1 else F.lit(next(i for i, w in enumerate(weights) if w > 0))


def shard(df: DataFrame, weights: list[float], key_col: str = "doc_id", text_col: str = "text", grown: list[float] | None = None) -> DataFrame:
    """``key_col``, size (UTF-8 bytes and 8), text_crc32, shard, slot, and grown_shard: the shard under ``grown``."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(key_col)
    rows = df.select(
        key.alias("key"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = materialize(rows, "sharded")
    buckets = max(BUCKETS, rows.count() // (BUCKET_ROWS * len(weights)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    pieces = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "place")
    counted = rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(pieces), ["shard", "bucket"])
    return counted.select(F.col("key").alias(key_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), "grown_shard")
