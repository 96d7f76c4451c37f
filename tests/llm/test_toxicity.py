from itertools import product

import numpy as np

from labelops.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        e, start, t = rng.normal(size=n) * 2, 0.3, rng.normal(size=(2, 2))
        weight, hit = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(e[i] * y[i] for i in range(n)) + start * y[0] + sum(t[y[i - 1], y[i]] for i in range(1, n)))
            weight += w
            hit += w * np.array(y)
        padded = np.full((n + 3, 2), np.nan)
        padded[:n, 0] = e
        padded[:, 1] = rng.normal(size=n + 3)
        p, _, _ = X.marginals(padded, start, t)
        assert np.allclose(p[:n, 0], hit / weight) and not p[n:, 0].any()


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = X.toxicity(docs, labels.filter(~X.held_out())).join(labels, "doc_id").filter(X.held_out())
    rows = out.select("score", "predicted", "spans", "toxic").collect()
    clean = [r for r in rows if r["toxic"] == 0]
    assert len(clean) > 20 and sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_spans_point_at_the_words(spark):
    """Enough copies of two insults among varied texts: both are found where they stand."""
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows, labels = [], []
    for d in range(400):
        words = list(rng.choice(vocab, 30))
        if d % 4 == 0:
            words[d % 30] = "Nasty!" if d % 8 else "vilest"
        rows.append((d, " ".join(words)))
        labels.append((d, int(d % 4 == 0)))
    rows += [(1000, "  fine\n Nasty! words are told here of the vilest"), (1001, ""), (1002, None), (None, "vilest"), (1003, "nothing bad")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(0, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    out = X.toxicity(df, marks).collect()
    assert len(out) == len(rows)
    want = {d: y for d, y in labels}
    assert all(r["predicted"] == want[r["doc_id"]] for r in out if r["doc_id"] is not None and r["doc_id"] < 400)
    odd = [r for r in out if r["doc_id"] == 1000]
    assert len(odd) == 2 and [(s["start"], s["end"]) for s in odd[0]["spans"]] == [(8, 14), (42, 48)]
    assert not any(r["predicted"] for r in out if r["doc_id"] in (1001, 1002, 1003))


def test_no_labels_and_empty(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in X.toxicity(docs, none).collect()} == {0.0}
    assert X.toxicity(empty, none).collect() == []
