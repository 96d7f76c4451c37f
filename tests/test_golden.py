"""Golden values computed from the shipped annotation sheets (rebuilt from joint counts)."""

import pytest
from pyspark.sql import functions as F

from golden import D1, D2, MCNEMAR, METRICS
from labelops.operators import agree as AG
from labelops.operators import cells as C
from labelops.operators import compare as CP


def frame(spark, joint, ds):
    rows = [(ds, gt, a1, a2, n) for (gt, a1, a2), n in joint.items()]
    f = spark.createDataFrame(rows, "ds string, ground_truth string, annotator1 string, annotator2 string, n int")
    return f.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "i")


@pytest.fixture(scope="module")
def sheets(spark):
    return frame(spark, D1, "d1").unionByName(frame(spark, D2, "d2"))


def test_rows(sheets):
    assert sheets.groupBy("ds").count().orderBy("ds").collect()[0]["count"] == 150


def test_metrics_and_kappa(sheets):
    pairs = [("ground_truth", "annotator1"), ("ground_truth", "annotator2"), ("annotator1", "annotator2")]
    cells = AG.pair_cells(sheets, pairs, ["ds"])
    acc = {(r.ds, r.pair): r.n_correct for r in C.accuracy(cells, ["ds", "pair"]).collect()}
    f1 = {(r.ds, r.pair): (r.f1_macro, r.f1_weighted) for r in C.f1_scores(cells, ["ds", "pair"]).collect()}
    kap = {(r.ds, r.pair): r.kappa for r in C.kappa(cells, ["ds", "pair"]).collect()}
    for (ds, a, b), (correct, fm, fw, k) in METRICS.items():
        key = (ds, f"{a}-{b}")
        assert acc[key] == correct
        assert f1[key][0] == pytest.approx(fm, abs=1e-6)
        assert f1[key][1] == pytest.approx(fw, abs=1e-6)
        assert kap[key] == pytest.approx(k, abs=1e-6)


def test_kappa_symmetric(sheets):
    k1 = AG.kappa_pairs(sheets, [("annotator1", "annotator2")], ["ds"]).orderBy("ds").collect()
    k2 = AG.kappa_pairs(sheets, [("annotator2", "annotator1")], ["ds"]).orderBy("ds").collect()
    assert [r.kappa for r in k1] == [r.kappa for r in k2]


def test_mcnemar(sheets):
    w = sheets.withColumnRenamed("ground_truth", "truth")
    valid = sorted({x for k in list(D1) + list(D2) for x in k})
    counts = CP.mcnemar_counts(w, ["annotator1", "annotator2"], valid, keys=["ds"])
    out = {r.ds: r for r in CP.mcnemar_exact(counts).collect()}
    for ds, (a, b, c, d, stat, p) in MCNEMAR.items():
        r = out[ds]
        assert (r.both_correct, r.model1_only, r.model2_only, r.both_wrong) == (a, b, c, d)
        assert r.statistic == stat
        assert r.p_value == pytest.approx(p, rel=1e-6)
