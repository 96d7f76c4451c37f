"""Bootstrap confidence intervals for any metric of the confusion cells (AGG-21).

Resampling n rows with replacement is exactly Multinomial(n, cells / n) on the confusion cells, so B
replicates cost O(B·cells) instead of O(B·n). The draw is SQL expressions only: cells in order, each
Binomial(rows left, its share of what is left) by the inverse of its distribution function at a
uniform number that an MD5 of seed, replicate and cell number gives. So every engine with MD5 draws
the same replicates, whatever the partitioning.

Binomials of a variance under ``EXACT_VARIANCE`` are inverted by summing their terms (at most some 130);
beyond, by the normal quantile with its skewness correction, which is within a small fraction of one row.

``paired_cells`` resamples joint cells (truth by all models' labels), so that models and metrics share
resamples and differences between models get intervals too. Replicates are cell frames with
``replicate`` as one more key: every function of ``cells`` applies to them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.operators import cells as C

# Replicates, seed, confidence level and the minimum number of valid rows.
N_BOOTSTRAP = 1000
SEED = 42
LEVEL = 0.95
MIN_ROWS = 10
EXACT_VARIANCE = 25.0

# Acklam's rational approximation of the normal quantile (relative error 1.2e-9).
NORMAL_CENTRE = ((-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
                  -3.066479806614716e+01, 2.506628277459239e+00),
                 (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
                  -1.328068155288572e+01, 1.0))
NORMAL_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
                4.374664141464968e+00, 2.938163982698783e+00),
               (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0))
NORMAL_BREAK = 0.02425


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts joined by ``|``."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(2**52)


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(u: Column) -> Column:
    """Quantile of the standard normal distribution."""
    tail = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    far = _horner(NORMAL_TAIL[0], tail) / _horner(NORMAL_TAIL[1], tail)
    mid = u - 0.5
    centre = _horner(NORMAL_CENTRE[0], mid * mid) * mid / _horner(NORMAL_CENTRE[1], mid * mid)
    return F.when(u < NORMAL_BREAK, far).when(u > 1 - NORMAL_BREAK, -far).otherwise(centre)


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct whose values are computed once (lambdas would compute them at every use)."""
    one = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.element_at(F.transform(F.array(one), body), 1)


def _binomial(v: Column) -> Column:
    """Of a struct (u, n, q, var): the smallest x with P(X <= x) >= u for X ~ Binomial(n, q), q at most one half."""
    u, n, q, mean = v["u"], v["n"], v["q"], v["n"] * v["q"]
    most = F.least(n, F.ceil(mean + 12 * F.sqrt(v["var"]) + 20))
    zero = F.struct(F.exp(n * F.log(1 - q)).alias("term"), F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("x"))
    exact = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), most), zero,
        lambda s, k: F.struct((s["term"] * (n - k) / (k + 1) * v["odds"]).alias("term"), (s["sum"] + s["term"]).alias("sum"),
                              (s["x"] + (s["sum"] + s["term"] < u).cast("bigint")).alias("x")),
        lambda s: F.least(s["x"], n))
    z = normal_quantile(u)
    wide = F.floor(mean + F.sqrt(v["var"]) * z + (1 - 2 * q) * (z * z - 1) / 6 + 0.5).cast("bigint")
    return F.when(v["var"] < EXACT_VARIANCE, exact).otherwise(F.least(F.greatest(wide, F.lit(0).cast("bigint")), n))


def binomial_quantile(u: Column, n: Column, p: Column) -> Column:
    """The smallest x with P(X <= x) >= u for X ~ Binomial(n, p); see the module's text for large variances.
    For p over one half it is n minus the quantile of the failures."""
    n = n.cast("bigint")
    return _let({"u": u, "n": n, "p": p, "q": F.least(p, 1 - p)}, lambda v: _let(
        {"u": v["u"], "n": v["n"], "p": v["p"], "q": v["q"], "var": v["n"] * v["q"] * (1 - v["q"]), "odds": v["q"] / (1 - v["q"])},
        lambda w: _let({"x": _binomial(w)}, lambda y: F.when(w["p"] > 0.5, w["n"] - y["x"]).otherwise(y["x"]))))


def replicate_cells(c: DataFrame, keys: Sequence[str] = ("model",), n_bootstrap: int = N_BOOTSTRAP, seed: int = SEED,
                    min_rows: int = MIN_ROWS, cell: Sequence[str] = ("truth", "pred")) -> DataFrame:
    """``keys…, replicate, cell…, n, valid_samples``: the drawn cells (n > 0) of every replicate.

    Groups with fewer than ``min_rows`` rows give nothing. The cells of a group (a power of a closed
    label set) meet in one row; replicates are rows of their own from there.
    """
    keys, cell = list(keys), list(cell)
    groups = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cell, F.col("n").cast("bigint").alias("n")))).alias("cells"),
                                  F.sum("n").cast("bigint").alias("valid_samples")).filter(F.col("valid_samples") >= min_rows)
    rows = groups.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1)).cast("array<bigint>")))
    rows = rows.repartition(*keys, "replicate")
    start = F.struct(F.col("valid_samples").alias("left"), F.col("valid_samples").alias("rest"), F.array().cast("array<bigint>").alias("x"))

    def step(s, one):
        u = uniform(F.lit(seed), F.col("replicate"), F.size(s["x"]))
        share = one["n"].cast("double") / s["rest"]
        x = F.when(one["n"] >= s["rest"], s["left"]).otherwise(binomial_quantile(u, s["left"], share))
        return _let({"x": x}, lambda d: F.struct((s["left"] - d["x"]).alias("left"), (s["rest"] - one["n"]).alias("rest"),
                                                 F.concat(s["x"], F.array(d["x"])).alias("x")))

    drawn = rows.withColumn("x", F.aggregate("cells", start, step, lambda s: s["x"]))
    out = drawn.select(*keys, "replicate", "valid_samples", F.inline(F.arrays_zip("cells", "x")))
    return (out.select(*keys, "replicate", *[F.col(f"cells.{k}").alias(k) for k in cell], F.col("x").alias("n"), "valid_samples")
            .filter("n > 0"))


def paired_cells(wide: DataFrame, models: Sequence[str], truth: str = "truth", keys: Sequence[str] = (),
                 n_bootstrap: int = N_BOOTSTRAP, seed: int = SEED, min_rows: int = MIN_ROWS) -> DataFrame:
    """``keys…, model, replicate, truth, pred, n``: cells of every model on the same resampled rows of a wide
    frame with one column per model."""
    names = [f"m{i}" for i in range(len(models))]
    joint = (wide.groupBy(*keys, F.col(truth).alias("truth"), *[F.col(f"`{m}`").alias(k) for m, k in zip(models, names)])
             .agg(F.count(F.lit(1)).alias("n")))
    drawn = replicate_cells(joint, keys, n_bootstrap, seed, min_rows, ["truth", *names])
    one = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(k).alias("pred")) for m, k in zip(models, names)]))
    return (drawn.select(*keys, "replicate", "truth", "n", one).groupBy(*keys, "model", "replicate", "truth", "pred")
            .agg(F.sum("n").cast("bigint").alias("n")))


def intervals(values: DataFrame, keys: Sequence[str], metrics: Sequence[str], level: float = LEVEL, digits: int = 6) -> DataFrame:
    """``keys…, metric, mean, std, ci_lower, ci_upper, replicates`` of one row per replicate with metric columns:
    population std, linear-interpolated percentiles."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    long = values.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    out = long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile(F.col("value"), F.array(F.lit(lo), F.lit(hi))).alias("ci"), F.count("value").alias("replicates"))
    return out.select(*keys, "metric", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"),
                      F.round(F.col("ci")[0], digits).alias("ci_lower"), F.round(F.col("ci")[1], digits).alias("ci_upper"), "replicates")


def bootstrap(c: DataFrame, keys: Sequence[str] = ("model",), n_bootstrap: int = N_BOOTSTRAP, seed: int = SEED,
              level: float = LEVEL, min_rows: int = MIN_ROWS, metrics: Sequence[str] = ("accuracy", "f1_macro"), digits: int = 6,
              measure: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None) -> DataFrame:
    """AGG-21: ``keys…, metric, valid_samples, mean, std, ci_lower, ci_upper, replicates``.

    ``measure(cells, keys)`` gives one row per group with the ``metrics`` columns (default
    ``cells.model_metrics``; ``cells.kappa`` for kappa). Groups with fewer than ``min_rows`` valid rows
    give no result, as in the reference.
    """
    keys = list(keys)
    measure = measure or (lambda x, k: C.model_metrics(x, k, digits=18))
    drawn = replicate_cells(c, keys, n_bootstrap, seed, min_rows)
    values = measure(drawn.drop("valid_samples"), [*keys, "replicate"])
    out = intervals(values, keys, metrics, level, digits)
    total = c.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("valid_samples"))
    out = out.join(total, keys) if keys else out.withColumn("_g", F.lit(0)).join(total.withColumn("_g", F.lit(0)), "_g")
    return out.select(*keys, "metric", "valid_samples", "mean", "std", "ci_lower", "ci_upper", "replicates")


def paired_differences(wide: DataFrame, models: Sequence[str], truth: str = "truth", metrics: Sequence[str] = ("accuracy", "f1_macro"),
                       n_bootstrap: int = N_BOOTSTRAP, seed: int = SEED, min_rows: int = MIN_ROWS, level: float = LEVEL,
                       digits: int = 6) -> DataFrame:
    """``model1, model2, metric, mean, std, ci_lower, ci_upper, replicates`` of the differences (first minus second)
    on shared resamples."""
    cells = paired_cells(wide, models, truth, (), n_bootstrap, seed, min_rows)
    per = C.model_metrics(cells, ["model", "replicate"], digits=18).select("model", "replicate", *metrics)
    rows = per.groupBy("replicate").agg(*[F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{i}{x}")
                                          for i, m in enumerate(models) for x in metrics])
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(models[i]).alias("model1"), F.lit(models[j]).alias("model2"), *[(F.col(f"{i}{x}") - F.col(f"{j}{x}")).alias(x) for x in metrics])
        for i, j in pairs])))
    return intervals(long, ["model1", "model2"], metrics, level, digits)
