"""Label profiles: distributions, before/after change, dataset card (AGG-1, 2, 6, 28, JN-4).

All of them aggregate first (partial aggregation, K groups) and only then apply
windows or joins, which therefore run over K rows rather than the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pct(n, total):
    return F.round(F.coalesce(F.try_divide(n * F.lit(100.0), total), F.lit(0.0)), 4)


def label_distribution(df: DataFrame, label: str, classes: Sequence[str] | None = None,
                       out_label: str = "label") -> DataFrame:
    """AGG-1: ``label, n, pct`` where pct is over *all* rows (null labels count in the total).

    With ``classes`` the output is exactly that list in that order, zero-filled, plus an
    ``ord`` column.
    """
    per = df.groupBy(F.col(label).alias(out_label)).agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("_total", F.sum("n").over(Window.partitionBy()))
    per = per.filter(F.col(out_label).isNotNull())
    if classes is None:
        return per.select(out_label, "n", _pct(F.col("n"), F.col("_total")).alias("pct"))
    grid = _class_frame(df.sparkSession, classes, out_label)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    joined = grid.join(per.drop("_total"), out_label, "left").fillna(0, subset=["n"])
    # one-row total attached through a window over the K-row frame
    joined = joined.unionByName(total.select(F.lit(None).cast("string").alias(out_label),
                                             F.lit(None).cast("int").alias("ord"),
                                             F.lit(None).cast("bigint").alias("n"),
                                             "_total"), allowMissingColumns=True)
    joined = joined.withColumn("_total", F.max("_total").over(Window.partitionBy()))
    return (joined.filter(F.col("ord").isNotNull())
            .select("ord", out_label, "n", _pct(F.col("n"), F.col("_total")).alias("pct")))


def _class_frame(spark, classes: Sequence[str], out_label: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(classes)],
                                 f"ord int, {out_label} string")


def distribution_change(before: DataFrame, after: DataFrame, label: str,
                        out_label: str = "label") -> DataFrame:
    """AGG-2 / JN-4: per label ``n_before, pct_before, n_after, pct_after, change_pp``.

    One pass over the union of both inputs; labels missing on one side get 0.
    """
    both = (before.select(F.col(label).alias(out_label), F.lit(True).alias("_b"))
            .unionByName(after.select(F.col(label).alias(out_label), F.lit(False).alias("_b"))))
    per = both.groupBy(out_label).agg(F.count_if("_b").alias("n_before"),
                                      F.count_if(~F.col("_b")).alias("n_after"))
    w = Window.partitionBy()
    per = (per.withColumn("_tb", F.sum("n_before").over(w))
              .withColumn("_ta", F.sum("n_after").over(w))
              .filter(F.col(out_label).isNotNull()))
    pb, pa = _pct(F.col("n_before"), F.col("_tb")), _pct(F.col("n_after"), F.col("_ta"))
    return per.select(out_label, "n_before", pb.alias("pct_before"), "n_after", pa.alias("pct_after"),
                      F.round(pa - pb, 4).alias("change_pp"))


def dataset_card(df: DataFrame, label: str) -> DataFrame:
    """AGG-6: total rows, distinct labels, most common label (ties: alphabetical) and its count."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").cast("bigint").alias("n_total"),
        F.count(label).alias("n_labels"),
        F.expr(f"min_by(`{label}`, struct(-n, `{label}`)) FILTER (WHERE `{label}` IS NOT NULL)")
        .alias("top_label"),
        F.max(F.when(F.col(label).isNotNull(), F.col("n"))).alias("top_count"),
    )
