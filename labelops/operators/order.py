"""Total order by any columns (SRT-1): dense positions without one task that sees all rows.

Rows are dealt to ranges by sampled splitters of the composite key, sorted inside their range, and take
their place in it from the order in which a task passes them. A range's first position is the sum of
the sizes of those before it (one row per range). The ranges are written once to the shared scratch
folder: sampled splitters may differ between two runs of a plan, a written place does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import scratch_dir

IN_PARTITION = 2**33 - 1  # bits of monotonically_increasing_id that count inside a task


def number_sorted(df: DataFrame, by: Sequence[str], out: str = "position", ranges: int | None = None) -> DataFrame:
    """Dense 1..n positions in ascending order of ``by`` (nulls first; strings in code-point order).

    End ``by`` with a unique column: rows with equal keys cannot be split between ranges, and their
    order among each other is open. ``ranges`` (default: the session's shuffle partitions) is the
    number of tasks.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_dir(spark, "order")
    (df.repartitionByRange(n, *by).sortWithinPartitions(*by)
     .withColumn("_range", F.spark_partition_id())
     .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION))).write.parquet(path))
    placed = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    first = (placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
             .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_first")))
    return (placed.join(first, "_range").withColumn(out, F.col("_first") + F.col("_place") + 1)
            .drop("_range", "_place", "_first"))

