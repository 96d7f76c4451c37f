"""Column and label projections, label filters and vote folding.

PRJ-1…PRJ-5, PRJ-7, PRJ-8, PRJ-10; FLT-5, FLT-6, FLT-8, FLT-10; AGG-5, AGG-23.
Everything here is a projection or a filter: narrow, no shuffle, plan-time column logic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.functions.text import as_col, norm_label, strip

# Numeric sentiment codes and the emotion label standardisation map.
SENTIMENT_CODES = {1: "positive", 0: "neutral", -1: "negative"}
EMOTION_MAP = {"angry": "anger", "fear": "fear", "happy": "happiness", "hate": "hate",
               "sad": "sadness", "surprise": "surprise", "other": "other"}
# Vote threshold (votes out of five) for a present label.
VOTE_THRESHOLD = 3


def drop_unnamed(df: DataFrame, marker: str = "Unnamed") -> DataFrame:
    """PRJ-1: drop every column whose name contains ``marker``."""
    return df.drop(*[c for c in df.columns if marker in c])


def positional_project(df: DataFrame, idx: Sequence[int]) -> DataFrame:
    """PRJ-2: keep columns by position."""
    return df.select(*[F.col(f"`{df.columns[i]}`") for i in idx])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ-3: rename by name; unknown names are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def set_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """PRJ-3: set all names positionally."""
    return df.toDF(*names)


def normalise_names(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PRJ-7: strip + lower column names (plan-time)."""
    cols = list(cols) if cols is not None else df.columns
    return df.withColumnsRenamed({c: c.strip().lower() for c in cols if c != c.strip().lower()})


def map_values(c: str | Column, mapping: Mapping, numeric_keys: bool | None = None) -> Column:
    """PRJ-4 closed value map: unmapped values become null.

    Numeric keys match numerically, so 1, 1.0 and "1" all hit key 1 (2.5 hits nothing).
    """
    keys = list(mapping)
    numeric = numeric_keys if numeric_keys is not None else all(isinstance(k, (int, float)) for k in keys)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    if not numeric:
        return F.element_at(m, as_col(c))
    d = as_col(c).cast("string").try_cast("double")
    if all(float(k).is_integer() for k in keys):
        return F.element_at(m, F.when(d == F.floor(d), d.cast("bigint")))
    return F.element_at(m, d)


def replace_values(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """PRJ-5 open map: normalise (strip + lower), then map; unmapped values pass through."""
    n = norm_label(c)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, n), n)


def unmapped_count(df: DataFrame, mapped: str) -> DataFrame:
    """AGG-5: rows whose mapped label is null."""
    return df.agg(F.count_if(F.col(mapped).isNull()).alias("n_unmapped"),
                  F.count(F.lit(1)).alias("n_total"))


def add_missing(df: DataFrame, defaults: Mapping[str, object], types: Mapping[str, str] | None = None) -> DataFrame:
    """PRJ-8: add tracking/placeholder columns only if absent."""
    types = types or {}
    for c, v in defaults.items():
        if c not in df.columns:
            lit = F.lit(v)
            df = df.withColumn(c, lit.cast(types[c]) if c in types else lit)
    return df


def require_text(df: DataFrame, text: str = "text", label: str | None = None,
                 placeholder: str = "unknown") -> DataFrame:
    """SRC-5: error when the text column is missing; a missing label gets a placeholder."""
    if text not in df.columns:
        raise ValueError(f"required column {text!r} missing; found {df.columns}")
    if label is not None and label not in df.columns:
        df = df.withColumn(label, F.lit(placeholder))
    return df


def valid_rows(df: DataFrame, cols: Sequence[str], valid: Sequence[str], normalise: bool = True) -> DataFrame:
    """FLT-5: keep rows where every listed column (normalised) is a valid label.

    The listed columns are replaced by their normalised values.
    """
    out = df
    if normalise:
        out = out.withColumns({c: norm_label(c) for c in cols})
    cond = reduce(lambda a, b: a & b, [F.col(c).isin(list(valid)) for c in cols])
    return out.filter(cond)


def valid_predictions(df: DataFrame, pred: str, valid: Sequence[str]) -> DataFrame:
    """FLT-6: keep rows whose prediction is a valid label, as given (truth not checked)."""
    return df.filter(F.col(pred).isin(list(valid)))


def select_classes(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """FLT-10: only listed classes survive."""
    return df.filter(F.col(label).isin(list(classes)))


def votes_array(cols: Sequence[str]) -> Column:
    """Fold N vote columns into ``array<struct<label, votes>>`` in declared order."""
    return F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").cast("int").alias("votes"))
                     for c in cols])


def labels_over(cols: Sequence[str], threshold: int = VOTE_THRESHOLD) -> Column:
    """Number of vote columns at or over the threshold."""
    return F.size(F.filter(votes_array(cols), lambda x: x["votes"] >= threshold))


def dominant_label(cols: Sequence[str], threshold: int = VOTE_THRESHOLD) -> Column:
    """PRJ-10: first column in declared order with votes >= threshold, else null."""
    return F.get(F.filter(votes_array(cols), lambda x: x["votes"] >= threshold), 0)["label"]


def single_label_rows(df: DataFrame, cols: Sequence[str], threshold: int = VOTE_THRESHOLD,
                      out: str = "label") -> DataFrame:
    """FLT-8 + PRJ-10: rows with exactly one label over the threshold, with that label."""
    return (df.filter(labels_over(cols, threshold) == 1)
            .withColumn(out, dominant_label(cols, threshold)))


def vote_histogram(df: DataFrame, cols: Sequence[str], threshold: int = VOTE_THRESHOLD) -> DataFrame:
    """AGG-23: rows with 0, exactly 1, and 2+ labels over the threshold."""
    k = F.least(labels_over(cols, threshold), F.lit(2))
    bucket = F.when(k == 2, F.lit("2+")).otherwise(k.cast("string"))
    return df.groupBy(bucket.alias("labels_over")).agg(F.count(F.lit(1)).alias("n"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["strip"]
