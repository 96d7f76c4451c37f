"""Deterministic sampling and checksums (SMP-1…SMP-5, FLT-10, SET-2, SRT-1, AGG-24, VAL-4).

Samples rank rows by ``md5(seed | row_id)``: the same input and seed give the same
rows on any cluster and partitioning (``DataFrame.sample`` cannot promise that).

The top-n is exact and distributed: rows fall into 65 536 hash buckets (first four
hex digits of the key); a per-bucket histogram (bounded, broadcast) says which
buckets are wholly inside the sample and which one straddles the cut, and rank is
``rows in earlier buckets + row_number() within the bucket``.  The window is
partitioned by (group, bucket), so no task ever holds a whole class or the whole
sample, and a hot class is spread over all of its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelops.functions.frames import attach_scalars
from labelops.operators.labels import select_classes

# Default seeds and sizes.
SEED = 42
BUCKET_HEX_DIGITS = 4  # 16 bits -> 65 536 buckets per group
# Checksum tree: 65 536 rows a chunk and level (four levels reach any bigint position), or digest prefixes.
BROADCAST_CLASSES = 16  # classes whose histogram, 65 536 rows each, is still sent to every executor
CHUNK_BITS, ORDER_LEVELS = 16, 4
CHUNK_PREFIXES = (8, 4)


def rank_key(row_id: str, seed: int | str = SEED) -> Column:
    """Sort key of a row for a seed: ``md5('<seed>|<row_id>')``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))


def ranked_sample(df: DataFrame, n: int, row_id: str = "row_id", by: Sequence[str] = (),
                  seed: int | str = SEED, ord_col: str = "ord", bounded_groups: bool | None = None) -> DataFrame:
    """Up to ``n`` rows per ``by`` group with the smallest keys, with ``ord`` 1..n per group.

    The bucket histogram is broadcast only when the groups are known to be few (no ``by``, or
    ``bounded_groups=True``, which a short list of classes sets); otherwise the join is left to AQE.
    """
    by = list(by)
    key = rank_key(row_id, seed)
    keyed = (df.withColumn("_k", key)
             .withColumn("_b", F.conv(F.substring("_k", 1, BUCKET_HEX_DIGITS), 16, 10).cast("int")))
    hist = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("_cum", F.sum("_cnt").over(w))
            .withColumn("_before", F.col("_cum") - F.col("_cnt"))
            .filter(F.col("_before") < F.lit(n))
            .select(*by, "_b", "_before"))
    bounded = (not by) if bounded_groups is None else bounded_groups
    # bounded: at most BROADCAST_CLASSES x 65 536 rows
    picked = keyed.join(F.broadcast(hist) if bounded else hist, [*by, "_b"], "inner")
    wr = Window.partitionBy(*by, "_b").orderBy("_k", row_id)
    ranked = picked.withColumn(ord_col, (F.col("_before") + F.row_number().over(wr)).cast("long"))
    return ranked.filter(F.col(ord_col) <= n).drop("_k", "_b", "_before")


def sample_simple(df: DataFrame, n: int, row_id: str = "row_id", seed: int | str = SEED,
                  strict: bool = True) -> DataFrame:
    """SMP-1: simple random sample of ``n`` rows without replacement.

    ``strict`` mirrors the error on a too-small input; it costs one count.
    """
    if strict:
        have = df.count()
        if have < n:
            raise ValueError(f"cannot take a sample of {n} from {have} rows")
    return ranked_sample(df, n, row_id, (), seed)


def sample_cap(df: DataFrame, n: int, row_id: str = "row_id", seed: int | str = SEED) -> DataFrame:
    """SMP-4: at most ``n`` rows (all rows when fewer)."""
    return ranked_sample(df, n, row_id, (), seed)


def sample_balanced(df: DataFrame, label: str, classes: Sequence[str], n: int,
                    row_id: str = "row_id", seed: int | str = SEED) -> DataFrame:
    """SMP-2 (+FLT-10): ``n`` rows per listed class; a short class gives all its rows."""
    return ranked_sample(select_classes(df, label, classes), n, row_id, [label], seed,
                         bounded_groups=len(set(classes)) <= BROADCAST_CLASSES)


def sample_shortfall(df: DataFrame, label: str, classes: Sequence[str], n: int) -> DataFrame:
    """Shortfall report for SMP-2: available, requested, taken, shortfall per listed class."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(c,) for c in classes], f"`{label}` string")
    counts = select_classes(df, label, classes).groupBy(label).agg(F.count(F.lit(1)).alias("available"))
    out = grid.join(counts, label, "left").fillna(0, subset=["available"])
    return out.select(F.col(label).alias("label"), "available",
                      F.lit(n).cast("bigint").alias("requested"),
                      F.least(F.col("available"), F.lit(n)).cast("bigint").alias("taken"),
                      F.greatest(F.lit(n) - F.col("available"), F.lit(0)).cast("bigint").alias("shortfall"))


def shuffle_order(df: DataFrame, row_id: str = "row_id", seed: int | str = SEED,
                  ord_col: str = "ord") -> DataFrame:
    """SMP-3: deterministic shuffle as a stored 1..n ``ord`` column (distributed ranking)."""
    return ranked_sample(df, 2**62, row_id, (), seed, ord_col)


def checksum(df: DataFrame, text: str = "text", order_by: str | None = None,
             keys: Sequence[str] = ()) -> DataFrame:
    """AGG-24: ``keys..., checksum, n_rows`` of any number of rows, as a tree of MD5 digests.

    ``order_by`` names a stored 1..n position: the digests of 65 536 rows in order give the digest of
    a chunk, and so on for ``ORDER_LEVELS`` levels. Without it the texts count as sorted by digest
    (equal texts collapse to one digest and a count) and chunks are digest prefixes.
    """
    keys = list(keys)
    digest = F.coalesce(F.md5(F.col(text)), F.lit(""))

    def fold(level: DataFrame, chunk: Column | None) -> DataFrame:
        by = [*keys] + ([chunk.alias("_c")] if chunk is not None else [])
        item = F.struct("_c", "_d")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_d"]), "")
        return level.groupBy(*by).agg(F.md5(joined).alias("_d"), F.sum("_n").cast("bigint").alias("_n"))

    one = F.lit(1).cast("bigint")
    if order_by:
        level = df.select(*keys, (F.col(order_by).cast("bigint") - 1).alias("_c"), digest.alias("_d"), one.alias("_n"))
        chunks = [F.shiftright("_c", CHUNK_BITS)] * (ORDER_LEVELS - 1)
    else:
        level = df.groupBy(*keys, digest.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        level = level.withColumn("_d", F.concat_ws(":", "_c", F.col("_n").cast("string")))
        chunks = [F.substring("_c", 1, n) for n in CHUNK_PREFIXES]
    for c in [*chunks, None]:
        level = fold(level, c)
    return level.select(*keys, F.col("_d").alias("checksum"), F.coalesce("_n", F.lit(0)).alias("n_rows"))


def fingerprint(df: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """AGG-24 scalable form: order-free ``count`` and ``sum(h32(row_id | text))``."""
    from labelops.functions.text import h32

    h = h32(F.concat_ws("|", F.col(row_id).cast("string"), F.col(text)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("bigint").alias("hash_sum"))


def checksum_check(results: DataFrame, expected: DataFrame) -> DataFrame:
    """VAL-4: compare checksum rows with the one-row stored checksum ``expected``: PASS / FAIL."""
    out = attach_scalars(results.drop("n_rows"), expected.select(F.col("checksum").alias("expected")))
    return out.withColumn("status", F.when(F.col("checksum") == F.col("expected"), F.lit("PASS"))
                          .otherwise(F.lit("FAIL")))
