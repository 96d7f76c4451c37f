"""Expressions and helpers the operators of this subpackage share."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class
SPACE = r"[\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII strings take the fast built-in."""
    slow = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(slow)


def space_words(c: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(c, SPACE, -1), "")


def crc_mod(c: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % m


def row_key(id_col: str = "doc_id", text_col: str | Column = "text") -> Column:
    """128 bits of id and text, equal for equal rows (a null is an empty string)."""
    of = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(of(id_col), F.lit(":"), of(text_col)).cast("binary")))


def blocks_for(n_rows: int, per_block: int) -> int:
    """Number of hash blocks that keeps a block near ``per_block`` rows at any table size."""
    return max(1, -(-n_rows // per_block))


def freeing(run):
    """A mapInArrow function that gives a worker's freed memory back to the system when a task ends, as
    workers are used again and would keep the peak of every stage."""
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner
