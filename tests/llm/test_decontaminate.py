import hashlib
import re
from collections import Counter

import pytest

from labelops.llm.decontaminate import contamination

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    wins = []
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        wins += [(str(i), w[k:k + n]) for k in range(len(w) - n + 1)] if w else []
    out = Counter()
    for r in rows:
        w = words(r["text"])
        hit, names = set(), set()
        have = set(w)
        for i, win in wins:
            if not have.issuperset(win):
                continue
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    names.add(i)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[r["doc_id"], len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_against_brute_force(spark, docs, rows, limit):
    from pyspark.sql import functions as F

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(9001, "Two, WORDS!"), (9002, "x x x"), (9003, None), (9004, "?!"), (9005, "no such words here")]
    items += [(9006, "x " * 15), (9006, "x " * 15), (100, "ÀÉ K k")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = contamination(docs, bench, broadcast_rows=limit).select("row.doc_id", "*").collect()
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r[c] for c in cols) for r in out) == brute(rows, items)


def test_empty_sides(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    out = contamination(docs, none).collect()
    assert len(out) == len(rows) and not any(r["contaminated"] or r["n_hit"] for r in out)
    assert contamination(empty, none).collect() == []


def test_rows_without_an_id_or_under_one_id(spark):
    """A third of the rows without an id, a third under one id: each row meets only its own candidates."""
    item = " ".join(f"w{k}" for k in range(15))
    rows = []
    for k in range(120):
        words_ = item.split()[:13] if k % 4 == 0 else [f"w{j}" for j in range(k % 12)]
        rows.append({"doc_id": (None, 7, k)[k % 3], "text": " ".join([f"text{k}", *words_, "end"])})
    df = spark.createDataFrame([(r["doc_id"], r["text"], 1) for r in rows], "doc_id long, text string, key int")
    items = [(1, item), (2, "w3 w4")]
    got = contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute(rows, items)
    assert all(r["row"]["key"] == 1 for r in got)
