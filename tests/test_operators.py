"""Operator edge cases (hand-made fixtures)."""

import json
import math

import pytest
from pyspark.sql import functions as F

from labelops.functions.text import exceeds_words, strip, word_count
from labelops.operators import batches as B
from labelops.operators import cells as C
from labelops.operators import clean as CL
from labelops.operators import compare as CP
from labelops.operators import labels as L
from labelops.operators import sample as S

WORDS_100 = " ".join(["w"] * 100)
WORDS_101 = " ".join(["w"] * 101)
EDGE = [
    (1, None, "angry"), (2, None, "sad"), (3, "   ", "sad"), (4, "  ", "sad"),
    (5, "abcdefghij", " Happy "), (6, "abcdefghij", "hate"), (7, "abcdefghi", "fear"),
    (8, "abcdefgh  ", "fear"), (9, WORDS_100, "other"), (10, WORDS_101, "sad"),
    (11, "😀" * 10, "surprise"), (12, "aaa‌bbb‌ccc", "anger"), (13, "some long text", "joy"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "row_id bigint, text string, emotion string")


def _funnel(df, order):
    f = CL.funnel(CL.classify(df, "text", "row_id", order), order)
    return {r.step: r.removed for r in f.collect()}


def test_funnel_blank_first(edge):
    assert _funnel(edge, CL.BLANK_FIRST) == {"blank": 4, "duplicate": 1, "too_short": 1, "too_long": 1}


def test_funnel_duplicate_first(edge):
    assert _funnel(edge, CL.DUPLICATE_FIRST) == {"duplicate": 2, "blank": 3, "too_short": 1, "too_long": 1}


def test_clean_rows_and_labels(edge):
    kept = CL.clean(edge, "text", "row_id")
    assert sorted(r.row_id for r in kept.collect()) == [5, 8, 9, 11, 12, 13]
    std = kept.withColumn("label", L.replace_values("emotion", L.EMOTION_MAP))
    labels = {r.row_id: r.label for r in std.collect()}
    assert labels[5] == "happiness" and labels[12] == "anger" and labels[13] == "joy"
    after = CL.drop_category(std, "label", "other")
    assert 9 not in {r.row_id for r in after.collect()}
    closed = kept.withColumn("label", L.map_values(L.norm_label("emotion"), L.EMOTION_MAP))
    assert {r.row_id: r.label for r in closed.collect()}[13] is None


def test_remaining_form_sums(edge):
    f = CL.funnel_remaining(CL.classify(edge, "text", "row_id"))
    rows = {r.step: r.remaining for r in f.collect()}
    assert rows["original"] == 13 and rows["too_long"] == 6


def test_drop_category_keeps_null(spark):
    df = spark.createDataFrame([(1, None), (2, "other"), (3, "sad")], "row_id int, label string")
    assert sorted(r.row_id for r in CL.drop_category(df, "label", "other").collect()) == [1, 3]


def test_strip_and_words(spark):
    df = spark.createDataFrame([("  a b‌c　",), (" x\u0085",)], "s string")
    out = df.select(strip("s").alias("t"), word_count("s").alias("w"), exceeds_words("s", 1).alias("e")).collect()
    assert out[0].t == "a b‌c" and out[0].w == 2 and out[0].e
    assert out[1].t == "x" and out[1].w == 1 and not out[1].e


def test_value_map_numeric(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (2.0,), (0.5,), (None,)], "code double")
    got = [r.l for r in df.select(L.map_values("code", L.SENTIMENT_CODES).alias("l")).collect()]
    assert got == ["positive", "neutral", "negative", None, None, None]


def test_votes(spark):
    cols = ["anger", "fear", "happiness", "hatred", "sadness", "wonder"]
    df = spark.createDataFrame([(1, 5, 0, 0, 0, 0, 0), (2, 0, 0, 3, 2, 0, 0), (3, 2, 2, 1, 0, 0, 0),
                                (4, 3, 0, 3, 0, 0, 0)], "id int, " + ", ".join(f"{c} int" for c in cols))
    single = {r.id: r.label for r in L.single_label_rows(df, cols).collect()}
    assert single == {1: "anger", 2: "happiness"}
    hist = {r.labels_over: r.n for r in L.vote_histogram(df, cols).collect()}
    assert hist == {"0": 1, "1": 2, "2+": 1}
    dom = {r.id: r.d for r in df.select("id", L.dominant_label(cols).alias("d")).collect()}
    assert dom == {1: "anger", 2: "happiness", 3: None, 4: "anger"}


RESPONSES = [
    ('{"1":"Positive","2":"neutral","3":"negative"}', False, ["positive", "neutral", "negative"]),
    ('{"1":"positive","3":"mixed","9":"neutral"}', False, ["positive", None, None]),
    ('Sure: {"1":"positive"} done', True, ["positive", None, None]),
    ('Sure: {"1":"positive"} done', False, [None, None, None]),
    ('{"1":"positive"} {"2":"neutral"}', True, [None, None, None]),
    ('{"1":" positive"}', False, [None, None, None]),
    ('{"1":3,"2":"neutral"}', False, [None, None, None]),
    ('["positive"]', False, [None, None, None]),
    ("not json", False, [None, None, None]),
    ("", False, [None, None, None]),
    (None, False, [None, None, None]),
    ('{"1":"positive","1":"neutral"}', False, ["neutral", None, None]),
    ('{"1":"pos\\u0069tive"}', False, ["positive", None, None]),
]


@pytest.mark.parametrize("body,extract,expected", RESPONSES)
def test_parse_response(spark, body, extract, expected):
    valid = ["negative", "neutral", "positive"]
    df = spark.createDataFrame([(1, 1, body)], "batch_no int, attempt int, body string")
    got = {r.key: r.label for r in B.parse_responses(df, valid, extract).collect() if r.key is not None}
    assert [got.get(str(i)) for i in (1, 2, 3)] == expected


def test_parse_agrees_with_json_loads(spark):
    valid = ["negative", "neutral", "positive"]
    for body, extract, _ in RESPONSES:
        if extract or body is None:
            continue
        try:
            obj = json.loads(body)
            ok = isinstance(obj, dict) and all(isinstance(v, str) for v in obj.values())
        except ValueError:
            ok = False
        df = spark.createDataFrame([(1, 1, body)], "batch_no int, attempt int, body string")
        usable = B.parse_responses(df, valid).collect()[0].usable
        assert usable == ok, body


def test_resolve_and_write_back(spark):
    valid = ["negative", "neutral", "positive"]
    resp = spark.createDataFrame([(1, 1, "not json"), (1, 2, '{"1":"positive","2":"neutral","7":"negative"}'),
                                  (1, 3, '{"1":"negative"}'), (2, 1, "oops")],
                                 "batch_no int, attempt int, body string")
    r = {x.batch_no: x for x in B.resolve_attempts(resp, valid).collect()}
    assert r[1].attempt == 2 and r[2].attempt is None
    rows = spark.createDataFrame([(10, 1, 1, None), (11, 1, 2, "negative"), (12, 1, 3, None), (13, 2, 1, None)],
                                 "row_id int, batch_no int, pos int, predicted string")
    out = {x.row_id: x.predicted for x in B.write_back(rows, B.resolve_attempts(resp, valid)).collect()}
    assert out == {10: "positive", 11: "negative", 12: None, 13: None}


def test_number_rows_matches_global_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000, 7, numPartitions=9).withColumnRenamed("id", "k")
    a = B.number_rows(df, "k").select("k", "rn")
    b = df.withColumn("rn2", F.row_number().over(Window.orderBy("k")))
    assert a.join(b, "k").filter(F.col("rn") != F.col("rn2")).count() == 0
    assert a.count() == df.count()


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_number_rows_any_integer_key(spark, parts):
    keys = [-(2**63), -70_000, -1, 0, 1, 65_535, 65_536, 2**32, 2**32 + 1, 2**48 + 5, 2**63 - 1]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k bigint, v string").repartition(parts)
    got = {r.k: (r.rn, r.v) for r in B.number_rows(df, "k").collect()}
    assert got == {k: (i, str(k)) for i, k in enumerate(keys, 1)}
    assert B.number_rows(df.limit(0), "k").collect() == []


def test_checksum_tree(spark):
    df = spark.range(1, 140_001).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("text"))
    swapped = df.withColumn("ord", F.when(F.col("ord") == 1, 70_000).when(F.col("ord") == 70_000, 1).otherwise(F.col("ord")))
    one = lambda d, o=None: tuple(S.checksum(d, "text", o).collect()[0])
    assert one(df, "ord") == one(df.repartition(7), "ord") != one(swapped, "ord")
    assert one(df) == one(swapped) == one(df.repartition(7))
    assert one(df) != one(df.unionByName(df.limit(1)))
    assert one(df.limit(0))[1] == one(df.limit(0), "ord")[1] == 0


def test_batches_short_last(spark):
    df = spark.range(0, 45).withColumnRenamed("id", "row_id")
    out = B.batch_numbers(df, "row_id", 20)
    last = out.filter(F.col("batch_no") == 3).count()
    assert last == 5 and out.agg(F.max("pos")).collect()[0][0] == 20


def test_flags_out_of_range_ignored(spark):
    df = B.batch_numbers(spark.range(0, 150).withColumnRenamed("id", "row_id"), "row_id", 100)
    flags = spark.createDataFrame([(1, 1), (2, 50), (2, 60), (2, 60), (3, 1)], "batch_no int, pos int")
    f = B.apply_flags(df, flags)
    assert f.filter("flagged").count() == 2
    cov = B.batch_coverage(f).collect()[0]
    assert (cov.total_batches, cov.batches_with_flags, cov.total_flags) == (2, 2, 2)


def test_mcnemar_edges(spark):
    counts = spark.createDataFrame([("a", "b", 1, 0, 0, 1, 2), ("a", "c", 0, 7, 13, 0, 20),
                                    ("b", "c", 0, 5, 5, 0, 10), ("a", "d", 0, 0, 0, 0, 0)],
                                   "model1 string, model2 string, both_correct long, model1_only long, "
                                   "model2_only long, both_wrong long, n_valid long")
    out = {r.model2 if r.model1 == "a" else "bc": r for r in CP.mcnemar_exact(counts).collect()}
    assert out["b"].statistic == 0 and out["b"].p_value == 1.0
    assert out["c"].statistic == 7 and out["c"].p_value == pytest.approx(0.26317596, abs=1e-8)
    assert out["bc"].p_value == 1.0
    assert out["d"].p_value is None and out["d"].statistic is None


def test_binomial_tail_large_n(spark):
    df = spark.createDataFrame([(4_000_000, 10_000_000)], "k long, n long")
    p = df.select(CP.binom_cdf_half(F.col("k"), F.col("n")).alias("p")).collect()[0].p
    # normal approximation of a tail this far out is ~0
    assert p == 0.0 or p < 1e-300
    df2 = spark.createDataFrame([(499_000, 1_000_000)], "k long, n long")
    p2 = df2.select(CP.binom_cdf_half(F.col("k"), F.col("n")).alias("p")).collect()[0].p
    z = (499_000.5 - 500_000) / math.sqrt(250_000)
    assert p2 == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-3)


def test_chi2_pvalue(spark):
    counts = spark.createDataFrame([(0, 7, 13, 0, 20)], "both_correct long, model1_only long, model2_only long, "
                                   "both_wrong long, n_valid long")
    r = CP.mcnemar_chi2(counts, with_p=True).collect()[0]
    assert r.chi2_statistic == pytest.approx(25 / 20)
    assert r.chi2_p_value == pytest.approx(math.erfc(math.sqrt(1.25 / 2)), abs=1e-9)


def test_kappa_constant_raters_is_null(spark):
    df = spark.createDataFrame([("x", "x")] * 5, "truth string, pred string")
    assert C.kappa(C.cells(df, "truth", "pred")).collect()[0].kappa is None


def test_percentile_and_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    r = df.agg(F.percentile("v", F.lit(0.025)).alias("p"), F.stddev_pop("v").alias("s")).collect()[0]
    assert r.p == pytest.approx(1.075) and r.s == pytest.approx(3.0822070, abs=1e-7)


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(20)], "row_id long, label string")
    bal = S.sample_balanced(df, "label", ["a", "b"], 10)
    counts = {r.label: r["count"] for r in bal.groupBy("label").count().collect()}
    assert counts == {"a": 8, "b": 10}
    short = {r.label: r.shortfall for r in S.sample_shortfall(df, "label", ["a", "b"], 10).collect()}
    assert short == {"a": 2, "b": 0}
    with pytest.raises(ValueError):
        S.sample_simple(df, 50)
    s1 = {r.row_id for r in S.sample_simple(df, 5).collect()}
    s2 = {r.row_id for r in S.sample_simple(df.repartition(7), 5).collect()}
    assert s1 == s2 and len(s1) == 5


def test_file_names(spark):
    names = spark.createDataFrame([("GPT4o_sentiment_results (2).csv",), ("x.csv",)], "f string")
    got = [r.m for r in names.select(CP.model_from_file(F.col("f")).alias("m")).collect()]
    assert got == ["GPT4o", None]
    up = spark.createDataFrame([("d1_annotator1(1).csv",), ("d1_ground_truth.csv",), ("d1_ground_truth (1).csv",)],
                               "file_name string")
    st = {r.expected: r.status for r in CP.strict_file_matches(
        up, ["d1_annotator1.csv", "d1_ground_truth.csv", "d1_annotator2.csv"]).collect()}
    assert st == {"d1_annotator1.csv": "ok", "d1_ground_truth.csv": "ambiguous", "d1_annotator2.csv": "missing"}


def test_guards(spark):
    from labelops.operators import agree as AG
    with pytest.raises(ValueError):
        CP.require_inputs(["only"])
    with pytest.raises(ValueError):
        CP.require_inputs(["a", "b"], n_valid=3)
    df = spark.createDataFrame([(1, " "), (2, "good"), (3, "great")], "row_id int, a string")
    v = AG.label_violations(df, "row_id", ["a"], ["good", "poor"])
    assert {r.row_id: r.check for r in v.collect()} == {1: "blank", 3: "invalid"}
    with pytest.raises(ValueError):
        AG.assert_valid(v)
    m = C.mistakes(spark.createDataFrame([("a", "a"), ("a", "b"), (None, None)], "t string, p string"), "t", "p")
    assert m.count() == 1
