import re
from collections import Counter

from labelops.llm import quality as Q

SF = "/root/testdata/sf0.001"


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), failed


def test_base_counts_against_brute_force(spark, docs, rows):
    out = Q.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in cols) for r in out) == Counter((r["doc_id"], *brute_base(r["text"])) for r in rows)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= Q.THRESHOLD) for r in out)


def test_score_is_the_mean_log_ratio(spark):
    """With one word per document the ratio of each bucket can be worked out by hand."""
    import math

    docs = spark.createDataFrame([(1, "good"), (2, "good"), (3, "bad"), (4, None), (None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (3, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in Q.quality(docs, labels, buckets=4096).collect() if r["doc_id"]}
    scale = math.log((4 + 4096) / (2 + 4096))
    assert abs(out[1] - (math.log(3 / 3) + scale)) < 1e-6
    assert abs(out[3] - (math.log(1 / 3) + scale)) < 1e-6
    assert out[4] == 0.0


def test_no_good_label_and_empty(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in Q.quality(docs, labels).collect()} == {0.0}
    assert Q.quality(empty, labels).collect() == []


def test_registered_query_keeps_the_same_share_of_clean_documents_at_any_size(spark):
    from labelops.llm.queries import op3_quality

    shares = {}
    for sf in ("sf0.001", "sf0.01", "few labels"):
        d = f"/root/testdata/{'sf0.01' if sf == 'few labels' else sf}"
        labels = spark.read.parquet(f"{d}/labels.parquet")
        marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
        if sf == "few labels":
            out = Q.calibrated(spark.read.parquet(f"{d}/documents.parquet"), labels.orderBy("doc_id").limit(120))
        else:
            out = op3_quality(spark, d)
        rows = [r for r in out.collect() if not r["base_failed"]]
        clean = [r["kept"] for r in rows if r["doc_id"] not in marks and 50 * r["n_symbols"] <= r["n_words"]]
        good = [r["score"] for r in rows if marks.get(r["doc_id"]) == 1]
        bad = [r["kept"] for r in rows if marks.get(r["doc_id"]) == 0 and 5 * r["n_symbols"] > r["n_words"]]
        assert len(clean) > 50 and sum(good) / len(good) > -0.2
        shares[sf] = sum(clean) / len(clean)
    assert min(shares.values()) > 0.85 and max(shares.values()) - min(shares.values()) < 0.1, shares


def test_calibrated_scores_leave_own_counts_out(spark):
    """A text that stands nowhere else has no evidence for or against it, labelled or not."""
    docs = spark.createDataFrame([(k, f"only{k} here{k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert {r["score"] for r in Q.calibrated(docs, labels, buckets=1 << 20).collect()} == {0.0}


def test_calibrated_without_good_labels_or_documents(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.calibrated(docs, labels).collect()
    assert all(r["score"] == 0.0 and r["kept"] != r["base_failed"] for r in out) and any(r["kept"] for r in out)
    assert Q.calibrated(empty, labels).collect() == []
