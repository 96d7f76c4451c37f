import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as C
from labelops.llm import decontaminate, langid, simhash
from test_decontaminate import brute as brute_contamination
from test_linededup import brute as brute_lines
from test_linededup import words as line_words
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """Every stage's result, each written and read again, from documents with odd rows and more columns."""
    place, out, now = tmp_path_factory.mktemp("stages"), [docs], docs
    for k, (_, f) in enumerate(C.STAGES):
        f(spark, now, SF).write.parquet(str(place / str(k)))
        now = spark.read.parquet(str(place / str(k)))
        out.append(now)
    return out


def test_columns_stay(stages):
    for s in stages[:-1]:
        assert set(s.columns) == set(stages[0].columns)


def test_language(stages):
    got = sorted(r["text"] for r in stages[1].collect())
    out = langid.identify(stages[0], stages[0].filter(~langid.held_out())).collect()
    assert got == sorted(r["row"]["text"] for r in out if r["lang_pred"] != "und" and r["score"] >= 0.5)
    assert len(got) >= 0.95 * stages[0].filter("trim(text) <> ''").count()


def test_lines_against_brute_force(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    kept = {(d, k) for d, k, keep in brute_lines(before) if keep}
    want = []
    for d, t in before:
        key = 2**63 - 1 if d is None else d
        lines = [x for k, x in enumerate(t.split("\n")) if not line_words(x) or (key, k) in kept]
        if line_words("\n".join(lines)):
            want.append((str(d), "\n".join(lines)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in stages[2].collect()) == sorted(want)


def test_one_of_each_group(stages):
    """Each group keeps one row: its smallest id, or one of its rows without an id if it has no other."""
    rows = [(r["doc_id"], brute_fp(r["text"])) for r in stages[2].collect()]
    number = {f: 2**62 + k for k, f in enumerate(sorted({f for _, f in rows}))}
    roots = {c for _, _, c in brute_components([(number[f] if i is None else i, f) for i, f in rows])}
    got = [r["doc_id"] for r in stages[3].collect()]
    assert sorted(i for i in got if i is not None) == sorted(c for c in roots if c < 2**62)
    assert got.count(None) == sum(c >= 2**62 for c in roots) > 0


def test_rows_under_one_id_stand_for_themselves(spark):
    t = [" ".join(f"{w}{k}" for w in "the quick brown fox jumps over a lazy dog".split()) for k in range(6)]
    rows = [(1, t[0]), (2, t[1]), (2, t[0]), (2, t[2]), (None, t[3]), (None, t[3]), (None, t[4]), (None, t[1]), (3, t[5]), (3, t[5])]
    df = spark.createDataFrame([(i, x, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, n int")
    want = [("1", t[0]), ("2", t[1]), ("2", t[2]), ("3", t[5])]
    want += [("None", t[3]), ("None", t[4])]
    for out in (C.simhash_dedup(spark, df, SF), simhash.without_near_dups(df.withColumn("row key", F.lit(1))).drop("row key")):
        assert out.columns == df.columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted(want)


def test_contaminated_go(spark, stages):
    before = [r.asDict() for r in stages[3].collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {k[0] for k in brute_contamination(before, items) if k[5]}
    assert {r["doc_id"] for r in stages[4].collect()} == {r["doc_id"] for r in before} - bad
    assert decontaminate.WINDOW == 13


def test_packed_once(stages):
    got = stages[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in stages[4].collect()}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)


def test_empty_tables(spark, empty):
    for _, f in C.STAGES:
        assert f(spark, empty, SF).collect() == []


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
