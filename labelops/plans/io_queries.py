"""Registered queries for file sources/sinks and the resumable labelling stream.

Each writes data Spark derives from the given tables into a scratch folder under the
session's checkpoint directory (shared storage on a cluster) and reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelops.operators import batches as B
from labelops.operators import cells as C
from labelops.operators import labels as L
from labelops.operators import order as O
from labelops.plans import fixtures as X
from labelops.plans.catalog import LANGS, MODELS, PL, PW, SQL_VCELLS, _preds_long, query
from labelops.plans.fixtures import s_in, s_list, sh, table
from labelops.session import scratch_dir
from labelops.sources import files as IO
from labelops.streaming import resume as R


@query("csv_roundtrip", "SELECT doc_id, text, lang FROM documents")
def q_csv_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = IO.write_csv(d, scratch_dir(spark, "csv") + "/documents.csv", bom=True)
    return IO.read_csv(spark, path, "doc_id bigint, text string, lang string", row_id=None)


@query("csv_first_in_file", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_order FROM documents")
def q_csv_first_in_file(spark, sf):
    """Row ids from file order, over many files: documents are written in ranges of doc_id, one file each."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    d = d.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    path = IO.write_csv(d, scratch_dir(spark, "csv1") + "/ordered.csv", bom=True)
    r = IO.read_csv(spark, path, "doc_id bigint, text string").select("doc_id", "row_id")
    return B.number_rows(r, "row_id", "row_order").select("doc_id", "row_order")


@query("sorted_by_text", "SELECT doc_id, lang, row_number() OVER (ORDER BY text NULLS FIRST, doc_id) AS position FROM documents")
def q_sorted_by_text(spark, sf):
    """SRT-1: position of every document in code-point order of the texts."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return O.number_sorted(d, ["text", "doc_id"]).select("doc_id", "lang", "position")


@query("tsv_scan", "SELECT text, lang FROM documents")
def q_tsv_scan(spark, sf):
    d = table(spark, sf, "documents").select("text", "lang")
    path = IO.write_csv(d, scratch_dir(spark, "tsv") + "/train.tsv", bom=False, sep="\t", header=False)
    return IO.read_tsv(spark, path, ["text", "lang"]).select("text", "lang")


@query("encoding_scan", "SELECT CASE WHEN lang IN ('de', 'fr') THEN 'utf-8' ELSE 'windows-1256' END AS encoding, "
       "count(*) AS n_rows, count(*) FILTER (WHERE lang NOT IN ('de', 'fr')) AS n_persian_prefix FROM documents "
       "GROUP BY 1")
def q_encoding_scan(spark, sf):
    """Two files of documents in two encodings, routed per file and unioned."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    base = scratch_dir(spark, "enc")
    d = d.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    u8 = d.filter(F.col("lang").isin("de", "fr")).drop("lang")
    cp = d.filter(~F.col("lang").isin("de", "fr")).drop("lang").withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))
    cp = cp.withColumn("text", F.concat(F.lit("سلام "), F.col("text")))
    IO.allow_charset(spark, "windows-1256")
    u8.write.option("header", True).option("escape", '"').csv(base + "/utf8")
    cp.write.option("header", True).option("escape", '"').option("encoding", "windows-1256").csv(base + "/cp1256")
    r = IO.read_csv_any_encoding(spark, [base + "/utf8", base + "/cp1256"], "doc_id bigint, text string")
    return r.groupBy(F.col("_encoding").alias("encoding")).agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.count_if(F.col("text").startswith("سلام")).alias("n_persian_prefix"))


@query("result_set", f"""SELECT 'results' AS kind, model, CAST(doc_id AS VARCHAR) AS key, 1 AS n, CAST(NULL AS DOUBLE) AS value
  FROM preds_long WHERE predicted IN {s_in(LANGS)}
UNION ALL SELECT 'per_class', model, truth, sum(n), round(coalesce(sum(n) FILTER (WHERE truth = pred), 0) / sum(n), 6)
  FROM vcells WHERE truth IN {s_in(LANGS)} GROUP BY model, truth
UNION ALL SELECT 'pairs', model, concat_ws('>', truth, pred), sum(n), NULL FROM vcells WHERE truth IS DISTINCT FROM pred GROUP BY model, truth, pred
UNION ALL SELECT 'confusion', model, concat_ws('>', truth, pred), sum(n), NULL FROM vcells WHERE truth IN {s_in(LANGS)}
  GROUP BY model, truth, pred""", (PW, PL, SQL_VCELLS))
def q_result_set(spark, sf):
    """The result tables of all labellers (results, confusion, report, pairs, per class), written by model and read back."""
    valid = L.valid_predictions(_preds_long(spark, sf), "predicted", LANGS)
    c = C.cells(valid, "truth", "predicted", ["model"])
    frames = {"results": valid.select("model", "doc_id", "truth", "predicted"), "confusion": C.confusion(c, LANGS, ["model"]),
              "report": C.class_report(c, ["model"]), "pairs": C.confused_pairs(c, ["model"]),
              "per_class": C.per_class_accuracy(c, ["model"], LANGS)}
    paths = IO.write_result_set(frames, scratch_dir(spark, "results"))
    read = {kind: spark.read.parquet(p) for kind, p in paths.items()}
    none = F.lit(None).cast("double")
    rows = lambda kind, key, n, value=none: read[kind].select(
        F.lit(kind).alias("kind"), "model", key.cast("string").alias("key"), n.cast("bigint").alias("n"), value.alias("value"))
    out = rows("results", F.col("doc_id"), F.lit(1))
    out = out.unionByName(rows("per_class", F.col("label"), F.col("sample_count"), F.col("accuracy")))
    out = out.unionByName(rows("pairs", F.concat_ws(">", "truth", "pred"), F.col("count")))
    return out.unionByName(rows("confusion", F.concat_ws(">", "truth", "pred"), F.col("n")).filter("n > 0"))


@query("atomic_replace", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def q_atomic_replace(spark, sf):
    """A table replaced by another one, all of it read back."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    path = scratch_dir(spark, "atomic") + "/table"
    IO.atomic_replace(d.withColumn("digest", F.lit("old")), path)
    IO.atomic_replace(d, path)
    return spark.read.parquet(path)


@query("published_table", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def q_published_table(spark, sf):
    """SNK-2: two versions published one after the other; readers follow the pointer to the latest."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    path = scratch_dir(spark, "published")
    IO.publish(d.withColumn("digest", F.lit("old")), path)
    IO.publish(d, path)
    return IO.read_published(spark, path)


def _resume_fail(batch_no: int, attempt: int) -> bool:
    return batch_no % 3 == 0  # these batches fail every attempt in the first run


@query("resume_labelling", f"SELECT doc_id AS row_id, {s_list(LANGS)}[({sh('text')} % 4) + 1] AS predicted "
       "FROM corpus", (X.SQL_CORPUS,))
def q_resume_labelling(spark, sf):
    base = scratch_dir(spark, "resume")
    src = X.corpus(spark, sf).select(F.col("doc_id").alias("row_id"), "text")
    src.write.parquet(base + "/input")
    q = R.start(spark, base + "/input", "row_id bigint, text string", base + "/labelled", base + "/ckpt",
                R.offline_labeller(LANGS, _resume_fail), LANGS, "language")
    q.awaitTermination()
    R.catch_up(spark, base + "/input", base + "/labelled", base + "/catchup", R.offline_labeller(LANGS), LANGS,
               "language")
    return spark.read.parquet(base + "/labelled").select("row_id", "predicted")


__all__ = ["MODELS"]
