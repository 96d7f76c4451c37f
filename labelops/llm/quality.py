"""Operator 3: quality rules with a hashed n-gram log-likelihood ratio, DataFrame operations only.

Base rules (word count, repeated three-word windows) come with counts of symbols, word characters
and repeated lines. The verdict compares two multinomials over hashed uni- and bigrams: the trusted
target (documents labelled good) and the raw corpus (all documents). Both are counted over every
n-gram of every document, in one pass; the table of ``buckets`` log ratios has a fixed size whatever
the corpus, and is the only thing that reaches the driver. A document's score is the mean log ratio
of its n-grams, so length does not matter, and every document meets the same threshold.

``calibrated`` is the registered query. The scale of a log ratio follows the sizes of target and
corpus, so its score and its threshold follow the data:

* Documents fall into ``FOLDS`` folds by the hash of their text. A document is scored against counts
  of the other folds, so no document, labelled or not, and no copy of it meets its own n-grams.
* The target is smoothed towards the raw distribution: (t + PRIOR) / (e + PRIOR), e the count the raw
  corpus would give a target of this size. An n-gram of which little is expected scores near 0.
* The threshold is the score that the share ``KEEP_GOOD`` of all good documents that pass the base
  rules reach (``percentile_approx``, a sketch of bounded size).

``quality`` keeps the plain form: add-one smoothing, a document's own counts in the tables, and a
threshold given by the caller.

Repeated windows are found inside the row: hashes of all windows are sorted with their positions and
equal neighbours are marked, n log n in the document's length; windows are compared by a 64-bit hash.

Defined results: null text has no words, fails the base rules and scores 0; ids without a label are
raw corpus only; several labels of one id count as good if any is; no good label at all gives score
0 for everything; repeated rows are counted and returned each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.session import scratch_dir

from .common import space_words, text_or_empty

BUCKETS = 1 << 16
#: least mean log ratio of a kept document, unless ``calibrated`` derives one
THRESHOLD = -0.07
MIN_WORDS = 50
FOLDS = 2
PRIOR = 1.0
KEEP_GOOD = 0.98


def _pairs(w):
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def _triples(pairs, w):
    n = F.greatest(F.size(w) - 2, F.lit(0))
    return F.zip_with(F.slice(pairs, 1, n), F.slice(w, 3, n), lambda h, c: F.xxhash64(h, c))


def _buckets(w, pairs, buckets: int):
    small = lambda x: F.pmod(x, F.lit(buckets)).cast("int")
    return F.concat(F.transform(w, lambda x: small(F.xxhash64(x))), F.transform(pairs, small))


def with_repeat_words(rows: DataFrame, triples: str) -> DataFrame:
    """Adds n_repeat_words: words inside three-word windows that occur at least twice in ``triples``,
    the array of window hashes. Each step is a column of its own, so that nothing is sorted twice."""
    t = F.col(triples)
    placed = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select("*", F.when(F.size(F.array_distinct(t)) < F.size(t), placed).alias("placed"))
    twins = F.zip_with("placed", F.slice("placed", 2, F.size("placed")),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    twins = F.filter(twins, lambda x: x.isNotNull())
    rows = rows.select("*", F.sort_array(F.array_distinct(F.flatten(twins))).alias("at")).drop("placed", triples)
    steps = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("*", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")).drop("at")


def _fold(folds: int):
    return F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int")


def _counts(docs: DataFrame, good: DataFrame, buckets: int, folds: int) -> list:
    """Rows (fold, bucket, raw, target): counts of all documents and of the good ones."""
    # one join strategy at every size: labels grow with the corpus, so they are never broadcast
    marks = good.select("doc_id", F.lit(True).alias("good")).hint("merge")
    flagged = docs.join(marks, "doc_id", "left")
    words = flagged.select("good", _fold(folds).alias("fold"), space_words(F.col("text")).alias("w"))
    words = words.select("good", "fold", "w", _pairs(F.col("w")).alias("p"))
    return (words.select("good", "fold", F.explode(_buckets(F.col("w"), F.col("p"), buckets)).alias("bucket"))
            .groupBy("fold", "bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect())


def log_ratios(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS, alpha: float = 1.0) -> list[float]:
    """Log ratio target : raw of each bucket. docs (doc_id, text) whole; good (doc_id) the trusted ids."""
    counts = _counts(docs, good, buckets, 1)
    raw, target = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    out = [0.0] * buckets
    if target:
        scale = math.log((raw + alpha * buckets) / (target + alpha * buckets))
        for r in counts:
            out[r["bucket"]] = round(math.log((r["target"] + alpha) / (r["raw"] + alpha)) + scale, 9)
    return out


def fold_ratios(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS, folds: int = FOLDS,
                prior: float = PRIOR) -> list[float]:
    """Log ratio target : raw of each bucket for documents of fold 0, then of fold 1 and so on, each
    from the other folds."""
    import numpy as np

    raw, target = np.zeros((folds, buckets)), np.zeros((folds, buckets))
    for r in _counts(docs, good, buckets, folds):
        raw[r["fold"], r["bucket"]], target[r["fold"], r["bucket"]] = r["raw"], r["target"]
    raw, target = raw.sum(axis=0) - raw, target.sum(axis=0) - target
    expected = raw * target.sum(axis=1, keepdims=True) / np.maximum(raw.sum(axis=1, keepdims=True), 1)
    return np.log((target + prior) / (expected + prior)).round(6).ravel().tolist()


def _scored(base: DataFrame, ratios: list[float], buckets: int, folds: int) -> DataFrame:
    """doc_id, the base counts, base_failed, score."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.col("text")
    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = base.select("doc_id", "text", space_words(text).alias("w"))
    rows = rows.select("doc_id", "text", "w", _pairs(F.col("w")).alias("p"), with_word.alias("lines"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"),
                       F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
                       F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       _triples(F.col("p"), F.col("w")).alias("t"), _buckets(F.col("w"), F.col("p"), buckets).alias("b"),
                       (_fold(folds) * buckets + 1).alias("at"))
    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + F.element_at(table, x + F.col("at")))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "t",
                       F.when(F.size("b") > 0, total / F.size("b")).otherwise(0.0).alias("score"))
    rows = with_repeat_words(rows, "t")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), "score")


def _inputs(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, good_col: str):
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base, labels.filter(F.col(good_col) == 1).select(F.col(id_col).alias("doc_id")).distinct()


def _verdict(rows: DataFrame, threshold) -> DataFrame:
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return rows.select(*[c for c in rows.columns if c != "score"], kept.alias("kept"), "score")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            good_col: str = "quality", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    base, good = _inputs(docs, labels, id_col, text_col, good_col)
    return _verdict(_scored(base, log_ratios(base, good, buckets), buckets, 1), threshold)


def calibrated(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               good_col: str = "quality", buckets: int = BUCKETS, folds: int = FOLDS, prior: float = PRIOR,
               keep_good: float = KEEP_GOOD) -> DataFrame:
    """The columns of ``quality``, with out-of-fold scores and a threshold from the good documents' scores."""
    spark = docs.sparkSession
    base, good = _inputs(docs, labels, id_col, text_col, good_col)
    place = scratch_dir(spark, "quality")
    _scored(base, fold_ratios(base, good, buckets, folds, prior), buckets, folds).write.parquet(f"{place}/scored")
    rows = spark.read.parquet(f"{place}/scored")
    trusted = rows.filter("NOT base_failed").join(good.hint("merge"), "doc_id", "left_semi")
    threshold = trusted.agg(F.percentile_approx("score", 1 - keep_good, 10_000)).first()[0]
    return _verdict(rows, F.col("score") if threshold is None else F.lit(threshold))
