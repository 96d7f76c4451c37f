"""Tidy metric report (RPT-1): one long frame ``section, subject, metric, value``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.operators import cells as C
from labelops.operators.compare import valid_for_all


def metric_report(wide: DataFrame, models: Sequence[str], valid: Sequence[str], norm_cells: DataFrame,
                  exact: DataFrame, truth: str = "truth", digits: int = 4) -> DataFrame:
    """Dataset counts, per-model metrics (rounded) and McNemar lines, unioned."""
    ok = valid_for_all(wide, [truth], valid)  # valid rows: those whose truth is
    ds = wide.agg(F.count(F.lit(1)).cast("double").alias("rows_loaded"),
                  F.count_if(ok).cast("double").alias("rows_valid"))
    ds = ds.select(F.lit("dataset").alias("section"), F.lit("all").alias("subject"),
                   F.inline(F.array(F.struct(F.lit("rows_loaded").alias("metric"), F.col("rows_loaded").alias("value")),
                                    F.struct(F.lit("rows_valid").alias("metric"), F.col("rows_valid").alias("value")))))
    mm = C.model_metrics(norm_cells, ["model"], digits=18)
    met = mm.select(F.lit("metrics").alias("section"), F.col("model").alias("subject"), F.inline(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.round(m, digits).alias("value"))
          for m in ("accuracy", "f1_macro", "f1_weighted")],
        F.struct(F.lit("valid_samples").alias("metric"), F.col("valid_samples").cast("double").alias("value")))))
    mc = exact.select(F.lit("mcnemar").alias("section"),
                      F.concat_ws(" vs ", "model1", "model2").alias("subject"), F.inline(F.array(
                          F.struct(F.lit("statistic").alias("metric"), F.col("statistic").alias("value")),
                          F.struct(F.lit("p_value").alias("metric"), F.col("p_value").alias("value")))))
    return ds.unionByName(met).unionByName(mc)


# Names of metrics in report lines.
LINE_NAMES = {"accuracy": "Accuracy", "f1_macro": "F1-Macro"}


def bootstrap_lines(intervals: DataFrame, subject: str = "model") -> DataFrame:
    """RPT-1, bootstrap section: ``section, subject, metric, value, text`` of ``bootstrap`` rows; the value is the
    mean, the text the whole line (mean, spread, interval, valid samples)."""
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in LINE_NAMES.items() for x in kv])[F.col("metric")], F.col("metric"))
    text = F.format_string("%s: %.4f ± %.4f [%.4f, %.4f] (Valid samples: %d)", name, "mean", "std", "ci_lower", "ci_upper", "valid_samples")
    return intervals.select(F.lit("bootstrap").alias("section"), F.col(subject).alias("subject"), "metric",
                            F.round("mean", 4).alias("value"), text.alias("text"))
