"""Confusion cells and every metric derived from them (AGG-7…AGG-15, FLT-11, TOP-1).

``cells(df, truth, pred, keys)`` = ``groupBy(*keys, truth, pred).count()``: one
partially-aggregated shuffle turns any number of rows into at most K² rows per key
group.  Accuracy, precision/recall/F1, reports, confusion matrices, confused pairs,
per-class accuracy and kappa are small aggregates over that frame, so models,
datasets and rater pairs are just more ``keys`` in the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N = "n"


def _div0(a: Column, b: Column) -> Column:
    """a / b as double, 0 when b is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def cells(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys…, truth, pred, n`` — the confusion cells."""
    return (df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias(N)))


def accuracy(c: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """AGG-7: ``n_valid, n_correct, accuracy`` per key group (truth = pred, nulls never match)."""
    hit = F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))
    return (c.groupBy(*keys)
            .agg(F.sum(N).cast("bigint").alias("n_valid"),
                 F.sum(F.when(hit, F.col(N)).otherwise(0)).cast("bigint").alias("n_correct"))
            .withColumn("accuracy", F.round(_div0(F.col("n_correct"), F.col("n_valid")), digits)))


def per_label(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per label: ``tp, support, predicted, precision, recall, f1`` (unrounded).

    Labels are the union of labels seen as truth or prediction in the group.
    """
    hit = F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))
    two = F.array(
        F.struct(F.col("truth").alias("label"), F.col(N).alias("support"),
                 F.when(hit, F.col(N)).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), F.col(N).alias("predicted")),
    )
    pl = (c.select(*keys, F.inline(two))
          .filter(F.col("label").isNotNull())
          .groupBy(*keys, "label")
          .agg(F.sum("tp").cast("bigint").alias("tp"), F.sum("support").cast("bigint").alias("support"),
               F.sum("predicted").cast("bigint").alias("predicted")))
    return (pl.withColumn("precision", _div0(F.col("tp"), F.col("predicted")))
            .withColumn("recall", _div0(F.col("tp"), F.col("support")))
            .withColumn("f1", _div0(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def f1_scores(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``f1_macro`` (mean over labels) and ``f1_weighted`` (support-weighted) per group, unrounded."""
    pl = per_label(c, keys)
    return pl.groupBy(*keys).agg(
        F.avg("f1").alias("f1_macro"),
        _div0(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))


def model_metrics(c: DataFrame, keys: Sequence[str] = ("model",), digits: int = 6) -> DataFrame:
    """AGG-13: ``accuracy, f1_macro, f1_weighted, valid_samples`` per group."""
    if not keys:  # one group: give it a constant key so the two aggregates join on a key
        return model_metrics(c.withColumn("_g", F.lit(0)), ["_g"], digits).drop("_g")
    acc = accuracy(c, keys, digits=18)
    f1 = f1_scores(c, keys)
    out = acc.join(f1, list(keys), "left")
    return out.select(*keys,
                      F.round("accuracy", digits).alias("accuracy"),
                      F.round("f1_macro", digits).alias("f1_macro"),
                      F.round("f1_weighted", digits).alias("f1_weighted"),
                      F.col("n_valid").alias("valid_samples"))


def class_report(c: DataFrame, keys: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """AGG-9: classification report rows per group.

    One row per label plus ``accuracy``, ``macro avg`` and ``weighted avg``; label rows
    and averages rounded to ``digits``; the accuracy row carries the unrounded accuracy
    in all four columns.  ``support`` is a double, as in the report table.
    """
    pl = per_label(c, keys)
    lab = pl.select(*keys, F.col("label").alias("row"), F.lit(0).alias("row_kind"),
                    F.round("precision", digits).alias("precision"), F.round("recall", digits).alias("recall"),
                    F.round("f1", digits).alias("f1_score"), F.col("support").cast("double").alias("support"))
    tot = pl.groupBy(*keys).agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("_n"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        F.sum(F.col("precision") * F.col("support")).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).alias("_wr"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"))
    acc = _div0(F.col("_tp"), F.col("_n"))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(1).alias("row_kind"), acc.alias("precision"),
                 acc.alias("recall"), acc.alias("f1_score"), acc.alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.lit(2).alias("row_kind"),
                 F.round("_mp", digits).alias("precision"), F.round("_mr", digits).alias("recall"),
                 F.round("_mf", digits).alias("f1_score"), F.col("_n").cast("double").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.lit(3).alias("row_kind"),
                 F.round(_div0(F.col("_wp"), F.col("_n")), digits).alias("precision"),
                 F.round(_div0(F.col("_wr"), F.col("_n")), digits).alias("recall"),
                 F.round(_div0(F.col("_wf"), F.col("_n")), digits).alias("f1_score"),
                 F.col("_n").cast("double").alias("support")),
    )
    return lab.unionByName(tot.select(*keys, F.inline(rows)))


def confusion(c: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """AGG-8: K×K matrix in fixed label order, zero-filled; truth outside the list is left out.

    Long form ``keys…, truth, pred, n`` over the full grid (use ``confusion_wide`` for columns).
    """
    lab = F.array(*[F.lit(x) for x in labels])
    inside = c.filter(F.col("truth").isin(list(labels)) & F.col("pred").isin(list(labels)))
    observed = inside.groupBy(*keys, "truth", "pred").agg(F.sum(N).cast("bigint").alias(N))
    groups = c.select(*keys).distinct() if keys else c.sparkSession.range(1).select()
    grid = (groups.withColumn("truth", F.explode(lab)).withColumn("pred", F.explode(lab)))
    return (grid.join(observed, [*keys, "truth", "pred"], "left")
            .fillna(0, subset=[N]))


def confusion_wide(c: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """AGG-8 wide: ``keys…, truth, <label_1> … <label_K>`` counts."""
    long = confusion(c, labels, keys)
    return long.groupBy(*keys, "truth").pivot("pred", list(labels)).agg(F.sum(N).cast("bigint"))


def mistakes(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """FLT-11: rows where the prediction differs from the truth (null-safe)."""
    return df.filter(~F.col(truth).eqNullSafe(F.col(pred)))


def confused_pairs(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-10 / FLT-11: mistakes per (truth, pred), most frequent first (ties: truth, pred)."""
    wrong = c.filter(~F.coalesce(F.col("truth") == F.col("pred"), F.lit(False)))
    return (wrong.groupBy(*keys, "truth", "pred").agg(F.sum(N).cast("bigint").alias("count"))
            .orderBy(*keys, F.desc("count"), "truth", "pred"))


def top_confused(c: DataFrame, keys: Sequence[str] = (), k: int = 10) -> DataFrame:
    """TOP-1: the ``k`` most confused pairs per group, with ``rank``."""
    pairs = confused_pairs(c, keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), "truth", "pred")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def per_class_accuracy(c: DataFrame, keys: Sequence[str] = (), labels: Sequence[str] | None = None,
                       digits: int = 6) -> DataFrame:
    """AGG-11: accuracy (= recall) and row count per truth class; classes without rows omitted."""
    hit = F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))
    src = c if labels is None else c.filter(F.col("truth").isin(list(labels)))
    return (src.groupBy(*keys, F.col("truth").alias("label"))
            .agg(F.sum(F.when(hit, F.col(N)).otherwise(0)).cast("bigint").alias("n_correct"),
                 F.sum(N).cast("bigint").alias("sample_count"))
            .withColumn("accuracy", F.round(_div0(F.col("n_correct"), F.col("sample_count")), digits))
            .drop("n_correct"))


def kappa(c: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """AGG-14: Cohen's kappa per group, (po - pe) / (1 - pe); null when pe = 1."""
    pl = per_label(c, keys)
    agg = pl.groupBy(*keys).agg(F.sum("tp").cast("double").alias("_tp"),
                                F.sum("support").cast("double").alias("_n"),
                                F.sum(F.col("support").cast("double") * F.col("predicted").cast("double"))
                                .alias("_pp"))
    po = F.col("_tp") / F.col("_n")
    pe = F.col("_pp") / (F.col("_n") * F.col("_n"))
    k = F.when(pe < 1.0, (po - pe) / (1.0 - pe))
    return agg.select(*keys, F.col("_n").cast("bigint").alias("n"), F.round(po, digits).alias("po"),
                      F.round(pe, digits).alias("pe"), F.round(k, digits).alias("kappa"))


def agreement(c: DataFrame, keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """AGG-15: percent agreement per group."""
    hit = F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))
    return (c.groupBy(*keys)
            .agg(F.sum(N).cast("bigint").alias("n"),
                 F.sum(F.when(hit, F.col(N)).otherwise(0)).cast("bigint").alias("n_agree"))
            .withColumn("agree_pct", F.round(_div0(F.col("n_agree") * 100, F.col("n")), digits)))
