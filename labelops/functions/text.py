"""Column expressions for text and labels (FN-1…FN-11, PRJ-6, PRJ-11).

All are JVM-side expressions so they stay inside whole-stage codegen; the same
patterns run unchanged in RE2 (DuckDB), which keeps the SQL oracle honest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set used by Python's str.strip() and str.split(),
# written as one regex character class (valid in Java regex and in RE2).
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = "[^" + WS[1:]


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Unicode strip with Python's whitespace set (Spark ``trim`` only removes U+0020)."""
    return F.regexp_replace(as_col(c), rf"^{WS}+|{WS}+\z", "")


def norm_label(c: str | Column) -> Column:
    """Label normalisation: strip + lower case (PRJ-6)."""
    return F.lower(strip(c))


def is_blank(c: str | Column) -> Column:
    """Null, empty or whitespace only (FLT-1). Stops at the first non-blank character."""
    c = as_col(c)
    return c.isNull() | ~c.rlike(NON_WS)


def word_count(c: str | Column) -> Column:
    """Number of whitespace-separated words, like ``len(s.split())`` (FN-4)."""
    return F.regexp_count(as_col(c), F.lit(NON_WS + "+"))


def exceeds_words(c: str | Column, n: int) -> Column:
    """True when the text has more than ``n`` words; stops scanning after word ``n + 1``.

    Possessive quantifiers over the two disjoint classes keep the match linear, and the
    scan is bounded by the position of word n + 1, not by the text length.
    """
    return as_col(c).rlike(rf"^{WS}*+(?:{NON_WS}++{WS}++){{{n}}}{NON_WS}")


def preview(c: str | Column, n: int) -> Column:
    """First ``n`` characters plus ``...`` when longer (PRJ-11)."""
    c = as_col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def h32(c: str | Column) -> Column:
    """Unsigned 32-bit hash: first 8 hex digits of MD5, as a bigint (portable to SQL engines)."""
    return F.conv(F.substring(F.md5(as_col(c).cast("string")), 1, 8), 16, 10).cast("bigint")


def hkey(*parts: str | Column) -> Column:
    """``h32`` of the parts joined with ``|`` (literals may be passed as plain strings via F.lit)."""
    return h32(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def unit_hash(*parts: str | Column) -> Column:
    """Uniform double in [0, 1) from ``hkey``."""
    return hkey(*parts) / F.lit(4294967296.0)
