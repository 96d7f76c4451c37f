"""Draws, pairing and metric arguments of the bootstrap."""

import math

import pytest
from pyspark.sql import functions as F

from labelops.operators import bootstrap as BS
from labelops.operators import cells as C


def exact_quantile(u, n, p):
    """By summing the terms; beyond a half the failures are counted."""
    flip, q = p > 0.5, min(p, 1 - p)
    total, x = 0.0, 0
    while x < n:
        choose = math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1)
        total += math.exp(choose + x * math.log(q) + (n - x) * math.log(1 - q))
        if total >= u:
            break
        x += 1
    return n - x if flip else x


def test_binomial_quantile_small_and_large(spark):
    rows = [(u, n, p) for u in (1e-6, 0.01, 0.3, 0.5, 0.77, 0.999) for n, p in ((1, 0.3), (10, 0.5), (37, 0.9), (400, 0.01), (90, 0.55), (0, 0.2))]
    df = spark.createDataFrame(rows, "u double, n long, p double")
    got = df.select("*", BS.binomial_quantile(F.col("u"), F.col("n"), F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == [exact_quantile(*r) for r in rows]
    big = spark.createDataFrame([(u, 10_000, p) for u in (1e-5, 0.02, 0.4, 0.9, 0.9999) for p in (0.01, 0.2, 0.5, 0.8)], "u double, n long, p double")
    for r in big.select("*", BS.binomial_quantile(F.col("u"), F.col("n"), F.col("p")).alias("x")).collect():
        assert abs(r.x - exact_quantile(r.u, r.n, r.p)) <= 1  # the corrected normal quantile, rounded
    far = spark.createDataFrame([(0.5, 10**12, 0.3)], "u double, n long, p double")
    x = far.select(BS.binomial_quantile(F.col("u"), F.col("n"), F.col("p"))).first()[0]
    assert abs(x - 3 * 10**11) < 10


def test_normal_quantile(spark):
    us = [1e-9, 0.001, 0.02, 0.1, 0.5, 0.8, 0.98, 1 - 1e-6]
    got = spark.createDataFrame([(u,) for u in us], "u double").select(BS.normal_quantile(F.col("u"))).collect()
    for u, r in zip(us, got):
        assert math.isclose(0.5 * math.erfc(-r[0] / math.sqrt(2)), u, rel_tol=1e-6)


def frame(spark):
    rows = []
    for k in range(240):
        t = "abc"[k % 3]
        rows.append((t, t if k % 5 else "a", t if k % 4 else "b", t if k % 5 else "a"))
    return spark.createDataFrame(rows, "truth string, one string, two string, same string")


def test_every_replicate_has_all_rows(spark):
    c = C.cells(frame(spark), "truth", "one")
    per = BS.replicate_cells(c, [], 50).groupBy("replicate").agg(F.sum("n").alias("n")).collect()
    assert len(per) == 50 and {r.n for r in per} == {240}


def test_models_share_resamples(spark):
    out = {(r.model1, r.model2, r.metric): r for r in BS.paired_differences(frame(spark), ["one", "two", "same"], n_bootstrap=200).collect()}
    same = out["one", "same", "accuracy"]
    assert (same["mean"], same["std"], same.ci_lower, same.ci_upper) == (0, 0, 0, 0)
    # 48 rows are wrong for "one" at most, 60 for "two": the difference is estimated with its own spread
    r = out["one", "two", "accuracy"]
    wide = frame(spark)
    p1, p2 = (wide.filter(F.col("truth") == F.col(m)).count() / 240 for m in ("one", "two"))
    assert r.ci_lower < p1 - p2 < r.ci_upper and r["std"] > 0
    apart = BS.bootstrap(C.cells(wide, "truth", "two"), [], n_bootstrap=200, metrics=["accuracy"]).first()
    assert abs(apart["mean"] - p2) < 0.01


def test_any_metric_of_cells(spark):
    c = C.cells(frame(spark), "truth", "two")
    got = BS.bootstrap(c, [], n_bootstrap=200, metrics=["kappa", "po"], measure=lambda x, k: C.kappa(x, k, digits=18)).collect()
    kappa = C.kappa(c).first()
    for r in got:
        assert r.replicates == 200 and r.valid_samples == 240 and r.ci_lower < kappa[r.metric] < r.ci_upper
    assert BS.bootstrap(c.filter("false"), [], n_bootstrap=5).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_same_draws_for_any_partitioning(spark, parts):
    c = C.cells(frame(spark).repartition(parts), "truth", "one")
    rows = BS.replicate_cells(c, [], 3).select("replicate", "truth", "pred", "n").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, BS.replicate_cells(C.cells(frame(spark), "truth", "one"), [], 3)
                                                  .select("replicate", "truth", "pred", "n").collect()))
