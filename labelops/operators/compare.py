"""Model comparison: alignment, McNemar, p-value matrix (JN-1, JN-5, SRC-4, AGG-12,
AGG-18…AGG-20, AGG-22, RPT-1).

Predictions live in long form ``(row_id, truth, model, predicted)``; the wide form is
one ``groupBy(row_id).pivot(model, models)`` (one shuffle on the row id).  All model
pairs are counted in a single pass over the wide rows: each pair contributes four
conditional sums, so there is no self-join of rows and no explode per pair.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.functions.text import norm_label

# Result-file stems and the model each one belongs to.
RESULT_FILE_MODELS = {
    "Claude_sentiment_results": "Claude",
    "DeepSeek_sentiment_results": "DeepSeek",
    "Gemini_sentiment_results": "Gemini",
    "GPT4o_sentiment_results": "GPT4o",
}
MODELS = ["Claude", "DeepSeek", "Gemini", "GPT4o"]
ALPHA = 0.05


def file_stem(name: Column) -> Column:
    """Strip ``.csv`` and a trailing `` (n)`` copy suffix from a file name."""
    return F.regexp_replace(F.regexp_replace(name, r"\.csv", ""), r"\s*\(\d+\)$", "")


def model_from_file(name: Column, mapping: Mapping[str, str] = RESULT_FILE_MODELS) -> Column:
    """SRC-4 loose form: model for a file name, null (skipped) when unknown."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, file_stem(name))


def strict_file_matches(names: DataFrame, expected: Sequence[str], name_col: str = "file_name") -> DataFrame:
    """SRC-4 strict form: matches per expected file (``<stem>[ (n)].csv``); status ok/missing/ambiguous."""
    rows = []
    for e in expected:
        stem = e[:-4] if e.endswith(".csv") else e
        pat = "^" + _re_escape(stem) + r"(\s*\(\d+\))?\.csv$"
        rows.append(F.struct(F.lit(e).alias("expected"), F.col(name_col).rlike(pat).alias("hit"),
                             F.col(name_col).alias("name")))
    m = names.select(F.inline(F.array(*rows))).groupBy("expected").agg(
        F.count_if("hit").alias("n_matches"), F.min(F.when(F.col("hit"), F.col("name"))).alias("matched"))
    return m.withColumn("status", F.when(F.col("n_matches") == 1, "ok")
                        .when(F.col("n_matches") == 0, "missing").otherwise("ambiguous"))


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in s)


ERFC_SPLIT = 2.5
ERFC_TERMS = 80


def require_inputs(models: Sequence[str], n_valid: int | None = None, min_rows: int = 10) -> None:
    """VAL-5: at least two models to compare and, when given, enough valid rows."""
    if len(models) < 2:
        raise ValueError(f"need at least 2 models for a comparison, got {list(models)}")
    if n_valid is not None and n_valid < min_rows:
        raise ValueError(f"only {n_valid} valid rows; at least {min_rows} needed")


def to_wide(long: DataFrame, models: Sequence[str], row_id: str = "row_id", truth: str = "truth",
            model: str = "model", pred: str = "predicted") -> DataFrame:
    """JN-1: one row per row id with one column per model (shuffle on the row id).

    The truth is that of the first model's rows, else the largest any other gives; ``truth_ok`` is
    false where the models' rows disagree on it.
    """
    of = lambda c, m: F.max(F.when(F.col(model) == m, F.col(c)))
    return long.groupBy(row_id).agg(
        F.coalesce(of(truth, models[0]), F.max(truth)).alias(truth), *[of(pred, m).alias(m) for m in models],
        F.min(truth).eqNullSafe(F.max(truth)).alias("truth_ok"))


def to_long(wide: DataFrame, models: Sequence[str], row_id: str = "row_id", truth: str = "truth") -> DataFrame:
    """Wide -> long ``(row_id, truth, model, predicted)`` (narrow)."""
    return wide.unpivot([row_id, truth], list(models), "model", "predicted")


def valid_for_all(wide: DataFrame, cols: Sequence[str], valid: Sequence[str]) -> Column:
    """FLT-5 condition over several columns after normalisation."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.coalesce(norm_label(c).isin(list(valid)), F.lit(False))
    return cond


def mcnemar_counts(wide: DataFrame, models: Sequence[str], valid: Sequence[str],
                   truth: str = "truth", keys: Sequence[str] = ()) -> DataFrame:
    """AGG-18: per model pair, over rows valid for truth and both models:
    ``both_correct, model1_only, model2_only, both_wrong, n_valid``."""
    require_inputs(models)
    vals = list(valid)
    # normalise every label column once; the aggregate then only combines booleans
    flags = wide.select(*keys, norm_label(truth).alias("_t"), *[norm_label(m).alias(f"_m{i}")
                                                               for i, m in enumerate(models)])
    flags = flags.select(*keys, F.coalesce(F.col("_t").isin(vals), F.lit(False)).alias("_vt"), *[
        x for i in range(len(models)) for x in (
            F.coalesce(F.col(f"_m{i}").isin(vals), F.lit(False)).alias(f"_v{i}"),
            F.coalesce(F.col(f"_m{i}") == F.col("_t"), F.lit(False)).alias(f"_c{i}"))])
    idx = {m: i for i, m in enumerate(models)}
    exprs = []
    pairs = list(combinations(models, 2))
    for i, (m1, m2) in enumerate(pairs):
        x, y = idx[m1], idx[m2]
        ok = F.col("_vt") & F.col(f"_v{x}") & F.col(f"_v{y}")
        c1, c2 = F.col(f"_c{x}"), F.col(f"_c{y}")
        exprs += [F.count_if(ok).alias(f"n{i}"), F.count_if(ok & c1 & c2).alias(f"a{i}"),
                  F.count_if(ok & c1 & ~c2).alias(f"b{i}"), F.count_if(ok & ~c1 & c2).alias(f"c{i}"),
                  F.count_if(ok & ~c1 & ~c2).alias(f"d{i}")]
    agg = flags.groupBy(*keys).agg(*exprs)
    rows = F.array(*[F.struct(F.lit(m1).alias("model1"), F.lit(m2).alias("model2"),
                              F.col(f"a{i}").alias("both_correct"), F.col(f"b{i}").alias("model1_only"),
                              F.col(f"c{i}").alias("model2_only"), F.col(f"d{i}").alias("both_wrong"),
                              F.col(f"n{i}").alias("n_valid"))
                     for i, (m1, m2) in enumerate(pairs)])
    return agg.select(*keys, F.inline(rows))


def _log_factorial(x: Column) -> Column:
    """ln(x!) for a bigint column: exact sum below 30, Stirling series from 30 (error < 1e-16)."""
    xd = x.cast("double")
    small = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(x, F.lit(1).cast("bigint"))),
                        F.lit(0.0), lambda acc, j: acc + F.log(j.cast("double")))
    stirling = (xd * F.log(xd) - xd + 0.5 * F.log(2 * math.pi * xd) + 1 / (12 * xd)
                - 1 / (360 * xd * xd * xd) + 1 / (1260 * F.pow(xd, 5)))
    return F.when(x < 30, small).otherwise(stirling)


def binom_cdf_half(k: Column, n: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, 1/2), k <= n/2, as one SQL expression.

    Sums the terms from ``lo = max(0, k - 12*sqrt(n) - 50)`` to ``k`` by the ratio
    t(i+1) = t(i)(n-i)/(i+1) in log space; terms left of ``lo`` are below 1e-30 of
    the sum, so the array stays ~12*sqrt(n) long even for n in the billions.
    """
    k, n = k.cast("bigint"), n.cast("bigint")
    lo = F.greatest(F.lit(0).cast("bigint"), k - F.ceil(12 * F.sqrt(n.cast("double"))).cast("bigint") - 50)
    log_t0 = _log_factorial(n) - _log_factorial(lo) - _log_factorial(n - lo) - n.cast("double") * math.log(2)
    init = F.struct(log_t0.alias("lt"), F.lit(0.0).alias("s"))
    acc = F.aggregate(
        F.sequence(lo, k), init,
        lambda a, i: F.struct((a["lt"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("lt"),
                              (a["s"] + F.exp(a["lt"])).alias("s")),
        lambda a: a["s"])
    return acc


def mcnemar_exact(counts: DataFrame, digits: int = 9, alpha: float = ALPHA) -> DataFrame:
    """AGG-19: exact McNemar: statistic = min(b, c), p = min(1, 2 * BinomCDF(min; b + c, 1/2)).

    b + c = 0 gives statistic 0 and p 1.0; no valid rows gives nulls.
    """
    b, c = F.col("model1_only"), F.col("model2_only")
    k, n = F.least(b, c), b + c
    p = F.when(F.col("n_valid") == 0, F.lit(None).cast("double")) \
        .when(n == 0, F.lit(1.0)) \
        .otherwise(F.least(F.lit(1.0), 2 * binom_cdf_half(k, n)))
    stat = F.when(F.col("n_valid") == 0, F.lit(None).cast("double")).otherwise(k.cast("double"))
    # significance is judged on the unrounded p; rounding is for display
    out = counts.withColumn("statistic", stat).withColumn("_p", p)
    return out.withColumn("p_value", F.round("_p", digits)).withColumn("significant", F.col("_p") < alpha).withColumn(
        "verdict", F.when(F.col("_p").isNull(), F.lit("not applicable"))
        .when(F.col("_p") < alpha, F.lit("significant difference"))
        .otherwise(F.lit("no significant difference"))).drop("_p")


def mcnemar_chi2(counts: DataFrame, digits: int = 9, with_p: bool = False) -> DataFrame:
    """AGG-20: continuity-corrected chi-square (|b - c| - 1)^2 / (b + c), 1 degree of freedom.

    ``with_p`` adds the upper-tail p = erfc(sqrt(x / 2)), an SQL expression.
    """
    b, c = F.col("model1_only").cast("double"), F.col("model2_only").cast("double")
    stat = F.when(b + c > 0, F.pow(F.abs(b - c) - 1, 2) / (b + c))
    out = counts.withColumn("chi2_statistic", F.round(stat, digits)).withColumn("df", F.lit(1))
    if with_p:
        out = out.withColumn("chi2_p_value", F.round(erfc(F.sqrt(stat / 2)), digits))
    return out


def erfc(y: Column) -> Column:
    """Complementary error function of y >= 0.

    Below ``ERFC_SPLIT`` one minus the series e^(-y^2) * sum of 2^k y^(2k+1) / (1 * 3 * ... * (2k+1)), whose
    terms are all positive; from there the continued fraction y + (1/2) / (y + (2/2) / (y + ...)).
    """
    e = F.exp(-y * y) / math.sqrt(math.pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(ERFC_TERMS)), F.struct(y.alias("t"), y.alias("s")),
        lambda a, k: F.struct((a["t"] * (2 * y * y) / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * (2 * y * y) / (2 * k + 1)).alias("s")),
        lambda a: a["s"])
    fraction = F.aggregate(F.sequence(F.lit(ERFC_TERMS), F.lit(1), F.lit(-1)), y, lambda a, k: y + k / 2 / a)
    return F.when(y < ERFC_SPLIT, 1 - 2 * e * series).otherwise(e / fraction)


def pvalue_matrix(tests: DataFrame, models: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """AGG-22: symmetric model × model p-value matrix with a null diagonal (``model`` + one column per model)."""
    fwd = tests.select(*keys, F.col("model1").alias("model"), F.col("model2").alias("other"), "p_value")
    rev = tests.select(*keys, F.col("model2").alias("model"), F.col("model1").alias("other"), "p_value")
    both = fwd.unionByName(rev)
    return both.groupBy(*keys, "model").pivot("other", list(models)).agg(F.first("p_value"))


def per_class_by_model(wide: DataFrame, models: Sequence[str], valid: Sequence[str],
                       truth: str = "truth", digits: int = 6) -> DataFrame:
    """AGG-12: per (class, model) accuracy on rows where truth and *all* models are valid;
    a class absent from those rows gets 0 for every model."""
    ok = wide.filter(valid_for_all(wide, [truth, *models], valid))
    t = norm_label(truth)
    stacked = ok.select(t.alias("label"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), (norm_label(m) == t).alias("hit")) for m in models])))
    per = stacked.groupBy("label", "model").agg(F.count_if("hit").alias("n_correct"),
                                                F.count(F.lit(1)).alias("n"))
    spark = wide.sparkSession
    grid = spark.createDataFrame([(lab, m) for lab in valid for m in models], "label string, model string")
    out = grid.join(per, ["label", "model"], "left").fillna(0, subset=["n_correct", "n"])
    return out.select("label", "model", F.col("n").alias("sample_count"),
                      F.round(F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n")),
                                         F.lit(0.0)), digits).alias("accuracy"))
