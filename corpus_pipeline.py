"""A training corpus from ``documents``: language ID, line dedup, SimHash near-dedup, benchmark
decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; each result is
written as Parquet and reread. All but the last return the columns of ``documents``.

Defined results: documents whose language cannot be told (null or blank texts, texts without a
letter, a posterior under one half) go at the first stage; documents without an id are documents like others
(as a SimHash group's representative they come after those with an id); rows with different texts under
one id are different documents, rows with equal id and text count as one from the SimHash stage on; an
empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelops.llm import decontaminate, langid, linededup, packing, simhash
from labelops.llm.common import table
from labelops.session import scratch_dir

MIN_POSTERIOR = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    out = langid.identify(docs, docs.filter(~langid.held_out()))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_POSTERIOR)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that repeat an earlier one; documents with no words left go."""
    out = linededup.without_duplicates(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of linked fingerprints."""
    return simhash.without_near_dups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.filter(~F.col("contaminated")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece."""
    return packing.pack(docs, added_tokens=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    place, docs = scratch_dir(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: tokenization, fingerprints and a learned language model are beyond SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None
