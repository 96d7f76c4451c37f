"""Operator 9: sharding by jump consistent hashing, with DataFrame expressions only.

A row's shard depends on its id and the shard count alone. The id seeds a 64-bit linear
congruential generator; each draw says at which shard count the row would next move, so going from
n to n+1 shards moves only the rows whose next jump is n, and these go to shard n. There is no ring
table and nothing to broadcast.

Every row also gets a dense slot inside its shard. A shard is cut into hash buckets of bounded
size: rows are numbered inside (shard, bucket), and per-bucket counts give the offsets, so no task
ever holds a whole shard.

Defined results: a null id hashes as 0; null text has size 1 (no bytes plus one) and crc32 0;
negative ids wrap to unsigned 64-bit; repeated rows each keep their own slot; ties in the id are
ordered by size and checksum; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, text_or_empty

#: fixed values of the published jump hash: multiplier of the generator, and the word sizes
MULTIPLIER = 2862933555777941757
TWO64 = 2**64
TWO33 = 2**33
TWO31 = 2**31


def jump_shard(key: Column, n_shards: int) -> Column:
    """Shard of a 64-bit key among ``n_shards``. Decimal arithmetic keeps the wrap-around exact."""
    wide = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    start = key.cast("decimal(20,0)")
    start = F.when(start < 0, start + wide(TWO64)).otherwise(start).cast("decimal(20,0)")
    zero = F.struct(start.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s, _):
        drawn = ((s["k"] * wide(MULTIPLIER) + 1) % wide(TWO64)).cast("decimal(20,0)")
        high = F.floor(drawn / wide(TWO33)).cast("long")
        jump = F.floor((s["j"] + 1) * TWO31 / (high + 1)).cast("long")
        moved = F.struct(drawn.alias("k"), s["j"].alias("b"), jump.alias("j"))
        return F.when(s["j"] < n_shards, moved).otherwise(s)

    # every step moves j up by at least one, so n_shards steps always suffice
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), zero, step, lambda s: s["b"]).cast("int")


def shard_rows(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
               per_block: int = 50_000) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (the shard among ``n_shards + 1``)."""
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    blocks = blocks_for(rows.count(), per_block * n_shards)
    rows = rows.select(
        "*", jump_shard(key, n_shards).alias("shard"), jump_shard(key, n_shards + 1).alias("grown_shard"),
        # the shard follows the id; the bucket only spreads a shard, also under one id
        F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(blocks)).cast("int").alias("bucket"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(inside))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
               .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    return (numbered.join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"))
