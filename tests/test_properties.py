"""Properties: results do not depend on row order or partitioning; counts add up."""

import pytest
from pyspark.sql import functions as F

from labelops.operators import bootstrap as BS
from labelops.operators import cells as C
from labelops.operators import clean as CL
from labelops.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def long_preds(spark):
    from labelops.operators.compare import to_long
    return to_long(X.preds_wide(spark, SF).drop("text"), X.MODELS, "doc_id", "truth")


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_metrics_partition_invariant(spark, long_preds, parts):
    base = C.kappa(C.cells(long_preds, "truth", "predicted", ["model"]), ["model"])
    moved = C.kappa(C.cells(long_preds.repartition(parts), "truth", "predicted", ["model"]), ["model"])
    assert _rows(base) == _rows(moved)


def test_cells_sum_to_n(spark, long_preds):
    c = C.cells(long_preds, "truth", "predicted", ["model"])
    assert c.agg(F.sum("n")).collect()[0][0] == long_preds.count()


@pytest.mark.parametrize("parts", [1, 5])
def test_funnel_partition_invariant_and_sums(spark, parts):
    raw = X.docs_raw(spark, SF)
    f1 = CL.funnel(CL.classify(raw, "text", "doc_id"))
    f2 = CL.funnel(CL.classify(raw.repartition(parts), "text", "doc_id"))
    assert _rows(f1) == _rows(f2)
    kept = CL.clean(raw, "text", "doc_id").count()
    assert min(r.remaining for r in f1.collect()) == kept


def test_dedup_idempotent(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    once = CL.dedup_first(d, "text", "doc_id")
    assert _rows(CL.dedup_first(once, "text", "doc_id")) == _rows(once)


def test_bootstrap_deterministic_and_centered(spark, long_preds):
    from labelops.operators import labels as L
    v = L.valid_rows(long_preds, ["truth", "predicted"], X.LANGS)
    cells = C.cells(v, "truth", "predicted", ["model"])
    a = BS.bootstrap(cells, ["model"], n_bootstrap=200)
    b = BS.bootstrap(cells.repartition(3), ["model"], n_bootstrap=200)
    assert _rows(a) == _rows(b)
    acc = {r.model: r.accuracy for r in C.accuracy(cells, ["model"]).collect()}
    for r in a.filter("metric = 'accuracy'").collect():
        assert r.ci_lower <= acc[r.model] <= r.ci_upper
        assert abs(r.mean - acc[r.model]) < 4 * r.std / 200 ** 0.5 + 1e-9


def test_bootstrap_matches_row_resampling(spark):
    """Multinomial-on-cells draws have the distribution of row resampling (brute force)."""
    import numpy as np
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 300)
    pred = np.where(rng.random(300) < 0.7, truth, (truth + 1) % 3)
    df = spark.createDataFrame([(str(t), str(p)) for t, p in zip(truth, pred)], "truth string, pred string")
    out = BS.bootstrap(C.cells(df, "truth", "pred"), [], n_bootstrap=2000, metrics=["accuracy"]).collect()[0]
    brute = []
    r2 = np.random.default_rng(42)
    for _ in range(2000):
        idx = r2.integers(0, 300, 300)
        brute.append(np.mean(truth[idx] == pred[idx]))
    assert out.mean == pytest.approx(np.mean(brute), abs=0.003)
    assert out.std == pytest.approx(np.std(brute), rel=0.1)


def test_bootstrap_too_few_rows(spark):
    df = spark.createDataFrame([("a", "a")] * 9, "truth string, pred string")
    assert BS.bootstrap(C.cells(df, "truth", "pred"), [], n_bootstrap=50).count() == 0
