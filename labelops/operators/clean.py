"""Corpus cleaning: blank/duplicate/length filters with an auditable funnel.

FLT-1…FLT-4, DDP-1, SET-1, AGG-3, AGG-4, AGG-26.

Design: exact dedup is one ``groupBy(text)`` with ``min_by(struct, row_id)`` — a
partial (map-side) aggregate, so a text repeated across a third of the corpus
collapses before the shuffle instead of landing whole in one task.  The same
aggregate carries the copy count, so every funnel figure comes from that one
shuffle; no per-row window over a hot text is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelops.functions.text import exceeds_words, is_blank

# Cleaning thresholds (characters, words).
MIN_CHARS = 10
MAX_WORDS = 100

BLANK_FIRST = ("blank", "duplicate", "too_short", "too_long")
DUPLICATE_FIRST = ("duplicate", "blank", "too_short", "too_long")


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """FLT-1: drop null text and text that is blank after a Unicode strip."""
    return df.filter(~is_blank(text))


def min_chars(df: DataFrame, text: str = "text", n: int = MIN_CHARS) -> DataFrame:
    """FLT-2: keep text with at least ``n`` code points, counted untrimmed."""
    return df.filter(F.length(text) >= n)


def word_limit(df: DataFrame, text: str = "text", n: int = MAX_WORDS) -> DataFrame:
    """FLT-3: keep text with at most ``n`` whitespace-separated words (null text is dropped)."""
    return df.filter(F.col(text).isNotNull() & ~exceeds_words(text, n))


def drop_category(df: DataFrame, label: str, category: str) -> DataFrame:
    """FLT-4: remove one category; null labels are kept (pandas ``!=`` semantics)."""
    return df.filter(~F.col(label).eqNullSafe(F.lit(category)))


def first_rows(df: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """``row_id, _copies`` of the first row of every distinct text.

    Grouped on the SHA-256 digest of the text, so the shuffle carries 32-byte keys and
    fixed-width buffers (a hash aggregate with map-side combine) instead of whole texts.
    """
    return (df.groupBy(F.sha2(F.col(text), 256).alias("_h"))
            .agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("_copies"))
            .select(row_id, "_copies"))


def dedup_first(df: DataFrame, text: str = "text", row_id: str = "row_id",
                with_copies: bool = False) -> DataFrame:
    """DDP-1: one row per exact text, the one with the smallest ``row_id``.

    Null texts are equal to each other (one group).  ``with_copies`` adds ``_copies``,
    the number of input rows sharing that text.  The join back is on the unique row id
    (no hot key); AQE broadcasts the first-row ids when they are small.
    """
    firsts = first_rows(df, text, row_id)
    if with_copies:
        return df.join(firsts, row_id, "inner")
    return df.join(firsts.select(row_id), row_id, "left_semi")


def _text_rule(text: str, order: Sequence[str], min_n: int, max_words: int) -> Column:
    """The first rule a text fails, null when it passes all; duplicates are decided by copy count."""
    conds: dict[str, Column] = {
        "blank": is_blank(text),
        "too_short": F.length(text) < min_n,
        "too_long": exceeds_words(text, max_words),
    }
    rule = F.lit(None).cast("string")
    for name in reversed([r for r in order if r != "duplicate"]):
        rule = F.when(conds[name], F.lit(name)).otherwise(rule)
    return rule


def classify(df: DataFrame, text: str = "text", row_id: str = "row_id",
             order: Sequence[str] = BLANK_FIRST, min_n: int = MIN_CHARS,
             max_words: int = MAX_WORDS) -> DataFrame:
    """``row_id, rule, _copies``: one row per distinct text with the first rule it fails (null = kept).

    The rules look at the text alone, so all copies agree: one scan, one shuffle of digests, no join.
    ``_copies`` counts the rows behind a text; the extra copies are duplicates, except for blank
    text when the blank rule runs first (then all copies are blank).
    """
    ruled = df.select(row_id, F.sha2(F.col(text), 256).alias("_h"),
                      _text_rule(text, order, min_n, max_words).alias("rule"))
    return (ruled.groupBy("_h").agg(F.min(row_id).alias(row_id), F.max("rule").alias("rule"),
                                    F.count(F.lit(1)).alias("_copies"))
            .drop("_h"))


def clean(df: DataFrame, text: str = "text", row_id: str = "row_id",
          order: Sequence[str] = BLANK_FIRST, min_n: int = MIN_CHARS,
          max_words: int = MAX_WORDS) -> DataFrame:
    """Rows that pass every rule (first copy of each text). The rules are computed once per row, in the
    aggregate of ``classify``; the row ids that come out of it without a rule pick the raw rows."""
    passed = classify(df, text, row_id, order, min_n, max_words).filter(F.col("rule").isNull())
    return df.join(passed.select(row_id), row_id, "left_semi")


def funnel_counts(classified: DataFrame, order: Sequence[str] = BLANK_FIRST) -> DataFrame:
    """One row: ``n_total`` and ``n_<rule>`` removed per rule, in funnel order."""
    blank_before_dup = order.index("blank") < order.index("duplicate")
    copies = F.col("_copies")
    extra = copies - 1
    is_b = F.col("rule") == "blank"
    exprs = [F.sum(copies).alias("n_total")]
    for r in order:
        if r == "duplicate":
            e = F.sum(F.when(is_b, 0).otherwise(extra)) if blank_before_dup else F.sum(extra)
        elif r == "blank" and blank_before_dup:
            e = F.sum(F.when(is_b, copies).otherwise(0))
        else:
            e = F.count_if(F.col("rule") == r)
        exprs.append(F.coalesce(e.cast("bigint"), F.lit(0).cast("bigint")).alias(f"n_{r}"))
    return classified.agg(*exprs).withColumn("n_total", F.coalesce("n_total", F.lit(0)).cast("bigint"))


def funnel(classified: DataFrame, order: Sequence[str] = BLANK_FIRST) -> DataFrame:
    """AGG-3: removed-per-step form: ``step_no, step, removed, remaining``."""
    counts = funnel_counts(classified, order)
    rows, running = [], F.col("n_total")
    for i, r in enumerate(order, start=1):
        running = running - F.col(f"n_{r}")
        rows.append(F.struct(F.lit(i).alias("step_no"), F.lit(r).alias("step"),
                             F.col(f"n_{r}").alias("removed"), running.alias("remaining")))
    return counts.select(F.inline(F.array(*rows)))


def funnel_remaining(classified: DataFrame, order: Sequence[str] = BLANK_FIRST) -> DataFrame:
    """AGG-4: remaining-per-step form with share of the original, step 0 = original."""
    counts = funnel_counts(classified, order)
    total = F.col("n_total")

    def pct(x: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(x * F.lit(100.0), total), F.lit(0.0)), 4)

    rows, running = [F.struct(F.lit(0).alias("step_no"), F.lit("original").alias("step"),
                              total.alias("remaining"), pct(total).alias("pct_of_original"))], total
    for i, r in enumerate(order, start=1):
        running = running - F.col(f"n_{r}")
        rows.append(F.struct(F.lit(i).alias("step_no"), F.lit(r).alias("step"),
                             running.alias("remaining"), pct(running).alias("pct_of_original")))
    return counts.select(F.inline(F.array(*rows)))


def size_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-26: size before/after, removed n and percent (one row, one pass over both)."""
    both = (before.select(F.lit(True).alias("_before"))
            .unionByName(after.select(F.lit(False).alias("_before"))))
    return (both.agg(F.count_if(F.col("_before")).alias("n_before"),
                     F.count_if(~F.col("_before")).alias("n_after"))
            .withColumn("removed", F.col("n_before") - F.col("n_after"))
            .withColumn("removed_pct", F.round(F.coalesce(
                F.try_divide(F.col("removed") * F.lit(100.0), F.col("n_before")), F.lit(0.0)), 4)))


def union_sources(frames: dict[str, DataFrame], file_col: str = "source_file") -> DataFrame:
    """SET-1: bag union of named inputs, tagging each row with its input name."""
    out = None
    for name, f in frames.items():
        tagged = f.withColumn(file_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def source_shares(unioned: DataFrame, file_col: str = "source_file") -> DataFrame:
    """SET-1 summary: rows and share per input (the share window runs over one row per input)."""
    per = unioned.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())
    return per.withColumn("share_pct", F.round(F.col("n_rows") * F.lit(100.0) / total, 4))
