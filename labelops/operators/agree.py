"""Human annotation: sheets, validation, kappa, agreement, adjudication (JN-6, VAL-1…3,
SHT-1, SHT-3, SHT-4, AGG-14…17, PRJ-9).

Sheets are aligned on the explicit row id (never by position) and checked for text
equality.  Kappa/agreement for all rater pairs come from one cells aggregate: each
row is expanded into one (pair, a, b) triple per pair (narrow) and counted once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.functions.frames import attach_scalars
from labelops.functions.text import is_blank, norm_label
from labelops.operators import cells as C


def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = (),
               normalise: bool = True) -> DataFrame:
    """Cells for several rater pairs in one pass: ``keys…, pair, truth(=first), pred(=second), n``."""
    def v(c):
        return norm_label(c) if normalise else F.col(c)

    triples = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), v(a).alias("truth"), v(b).alias("pred"))
                        for a, b in pairs])
    # labels are few: count their raw combinations, then normalise and expand those
    raw = df.groupBy(*keys, *dict.fromkeys(c for pair in pairs for c in pair)).agg(F.count(F.lit(1)).alias("_rows"))
    return (raw.select(*keys, "_rows", F.inline(triples)).groupBy(*keys, "pair", "truth", "pred")
            .agg(F.sum("_rows").cast("bigint").alias(C.N)))


def kappa_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """AGG-14 for each pair."""
    return C.kappa(pair_cells(df, pairs, keys), [*keys, "pair"])


def agreement_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """AGG-15 for each pair."""
    return C.agreement(pair_cells(df, pairs, keys), [*keys, "pair"])


def final_accuracy(df: DataFrame, consensus: str = "consensus", truth: str = "ground_truth",
                   keys: Sequence[str] = ()) -> DataFrame:
    """AGG-16: consensus vs normalised truth (truth is not validated): n, matches, pct."""
    m = F.coalesce(norm_label(consensus) == norm_label(truth), F.lit(False))
    return (df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(m).alias("matches"))
            .withColumn("accuracy_pct", F.round(C._div0(F.col("matches") * 100, F.col("n")), 4)))


def adjudication(df: DataFrame, a1: str = "annotator1", a2: str = "annotator2",
                 consensus: str = "consensus", keys: Sequence[str] = ()) -> DataFrame:
    """AGG-17: disagreements and whom the consensus sided with (annotator 1 first)."""
    x1, x2, xc = norm_label(a1), norm_label(a2), norm_label(consensus)
    dis = ~x1.eqNullSafe(x2)
    to1 = dis & F.coalesce(xc == x1, F.lit(False))
    to2 = dis & ~F.coalesce(xc == x1, F.lit(False)) & F.coalesce(xc == x2, F.lit(False))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(dis).alias("disagreements"),
                                F.count_if(to1).alias("to_annotator1"), F.count_if(to2).alias("to_annotator2"))
    return (out.withColumn("neither", F.col("disagreements") - F.col("to_annotator1") - F.col("to_annotator2"))
            .withColumn("disagreement_pct", F.round(C._div0(F.col("disagreements") * 100, F.col("n")), 4)))


def match_flag(df: DataFrame, consensus: str = "consensus", truth: str = "ground_truth",
               out: str = "match") -> DataFrame:
    """PRJ-9 / SHT-4: stored flag consensus == ground truth (normalised, null-safe false)."""
    return df.withColumn(out, F.coalesce(norm_label(consensus) == norm_label(truth), F.lit(False)))


def blind_sheets(df: DataFrame, row_id: str, text: str, annotators: Sequence[str]) -> DataFrame:
    """SHT-1: one blind sheet per annotator (text + empty label), stacked with a ``sheet`` column."""
    out = None
    for a in annotators:
        s = df.select(F.lit(a).alias("sheet"), F.col(row_id), F.col(text), F.lit("").alias("label"))
        out = s if out is None else out.unionByName(s)
    return out


def combined_sheet(truth: DataFrame, sheets: Mapping[str, DataFrame], row_id: str = "row_id",
                   text: str = "text", truth_col: str = "ground_truth") -> DataFrame:
    """SHT-3 / JN-6: truth + every annotator column joined on the row id, empty consensus.

    ``text_ok`` is false where an annotator sheet's text differs from the truth text.
    """
    out = truth.select(row_id, text, norm_label(truth_col).alias(truth_col))
    checks = []
    for name, s in sheets.items():
        out = out.join(s.select(F.col(row_id), F.md5(F.col(text).cast("binary")).alias(f"_{name}_text"), F.col(name)), row_id, "left")
        checks.append(F.col(f"_{name}_text").eqNullSafe(F.md5(F.col(text).cast("binary"))))
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return (out.withColumn("consensus", F.lit("")).withColumn("text_ok", ok)
            .drop(*[f"_{n}_text" for n in sheets]))


def label_violations(df: DataFrame, row_id: str, label_cols: Sequence[str], valid: Sequence[str]) -> DataFrame:
    """VAL-1/VAL-2: ``check, column, row_id, value`` for blank labels and invalid labels."""
    checks = F.array(*[
        F.struct(F.when(is_blank(c), F.lit("blank")).when(~norm_label(c).isin(list(valid)), F.lit("invalid")).alias("check"),
                 F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in label_cols])
    return (df.select(F.col(row_id), F.inline(checks)).filter(F.col("check").isNotNull())
            .select("check", "column", row_id, "value"))


def assert_valid(violations: DataFrame, what: str = "labels", show: int = 20) -> None:
    """VAL-1/VAL-2 guard: raise with the first offenders and the count (one bounded action)."""
    first = violations.limit(show).collect()
    if first:
        n = violations.count()
        raise ValueError(f"{n} invalid {what}; first: {[tuple(r) for r in first]}")


def alignment_check(reference: DataFrame, other: DataFrame, row_id: str = "row_id", text: str = "text",
                    keys: Sequence[str] = ()) -> DataFrame:
    """VAL-3: rows of ``other`` (per ``keys`` group) aligned to ``reference`` on the row id.

    Counts rows on both sides, rows missing from ``other``, extra rows and text mismatches;
    ``aligned`` is true when every count matches and no text differs. Texts meet as 128-bit digests:
    no text is shuffled.
    """
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))  # noqa: E731  null stays null
    a = reference.select(row_id, digest(text).alias("_ta"), F.lit(True).alias("_in"))
    b = other.select(*keys, row_id, digest(text).alias("_tb"))
    known = F.col("_in").isNotNull()
    per = b.join(a, row_id, "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_other"),
        F.count_if(~known).alias("n_extra"),
        F.count_if(known).alias("_matched"),
        F.count_if(known & ~F.col("_ta").eqNullSafe(F.col("_tb"))).alias("n_text_mismatch"))
    per = attach_scalars(per, a.agg(F.count(F.lit(1)).alias("n_reference")))
    return (per.withColumn("n_missing", F.col("n_reference") - F.col("_matched")).drop("_matched")
            .withColumn("aligned", (F.col("n_missing") == 0) & (F.col("n_extra") == 0)
                        & (F.col("n_text_mismatch") == 0)))
