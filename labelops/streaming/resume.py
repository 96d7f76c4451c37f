"""Resumable labelling (STR-1) with Structured Streaming.

``readStream`` over the input table → ``trigger(availableNow=True)`` → ``foreachBatch``:
rows already labelled are skipped (anti join on the row id), the rest are numbered into
batches, these are written once, prompts are built, the labeller runs once per batch inside ``mapInPandas`` and
its raw responses are **written before they are parsed** (a lazy plan must never call
the labeller twice), then parsed, resolved over attempts and written back.  Each
micro-batch overwrites only its own partition (run id and epoch) and skips only rows that
*other* partitions have labelled, so a replay after a failure writes the same rows again,
from the answers in its journal (``label_once``), and a rerun adds to what is there.  A labeller that raises has failed one attempt.  Failed
batches stay unlabelled; ``catch_up`` labels ``input left_anti labelled`` through the same
functions, each pass into a partition of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelops.operators import batches as B
from labelops.session import scratch_dir, ship_package

Labeller = Callable[[str, list[str], int, int], str]


def _table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _marker(spark: SparkSession, path: str) -> bool:
    """Create a folder as a mark; false if it was there before."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return False if fs.exists(p) else fs.mkdirs(p)


def _once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; written first, unless an earlier try has committed it."""
    if not _table_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _first_try() -> bool:
    """False in a task that Spark runs again (after a failure, a lost executor, or speculatively)."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context is None or context.attemptNumber() == 0


def call_labeller(prompts: DataFrame, labeller: Labeller, attempt: int) -> DataFrame:
    """Run the user labeller once per batch (prompt, ordered texts) -> ``batch_no, attempt, body``.

    A task that Spark runs again may have asked before: it asks nothing, and its batches have failed this
    attempt. ``prompts`` should be a written table, so that the job has no shuffle to repeat."""
    def ask(prompt, texts, batch_no, first):
        if not first:
            return "the task was run again"
        try:
            return labeller(prompt, texts, batch_no, attempt)
        except Exception as e:  # noqa: BLE001  a raising labeller is a failed attempt, not the end of the run
            return f"labeller raised {type(e).__name__}"

    def run(it):
        first = first_try()
        for pdf in it:
            bodies = [ask(p, list(t), int(b), first) for p, t, b in zip(pdf["prompt"], pdf["texts"], pdf["batch_no"])]
            yield pd.DataFrame({"batch_no": pdf["batch_no"].astype("int32"),
                                "attempt": [attempt] * len(pdf), "body": bodies})

    first_try = _first_try
    ship_package(prompts.sparkSession)
    return prompts.mapInPandas(run, "batch_no int, attempt int, body string")


def label_once(todo: DataFrame, labeller: Labeller, labels: Sequence[str], noun: str, work_dir: str,
               row_id: str = "row_id", text: str = "text", batch_size: int = B.LABEL_BATCH,
               max_attempts: int = B.MAX_ATTEMPTS, extract: bool = False) -> DataFrame:
    """Label one set of rows: ``row_id, predicted`` for rows that got a valid label.

    ``work_dir`` is the journal: the numbered batches, the responses of each attempt and the batches
    that each leaves open are tables that a replay finds and uses again. Texts are shuffled into batches
    once; a later attempt reads the batches still open from that table. A mark is set before an attempt
    asks. A replay that finds the mark without committed responses cannot know who was asked: that
    attempt has failed and the next one asks, so no row is asked twice in one attempt.
    """
    spark = todo.sparkSession
    batches = _once(spark, f"{work_dir}/batches", lambda: B.batch_texts(
        B.batch_numbers(todo.select(F.col(row_id).alias("id"), F.col(text).alias("text")), "id", batch_size), "id"))
    left, answered = batches.select("batch_no"), False
    for attempt in range(1, max_attempts + 1):
        path = f"{work_dir}/responses/attempt={attempt}"
        if not _table_exists(spark, f"{path}/_SUCCESS"):
            if not _marker(spark, f"{work_dir}/asked/attempt={attempt}"):
                continue  # asked, and the answers are lost
            pending = batches if not answered else _once(
                spark, f"{work_dir}/pending/attempt={attempt}", lambda: batches.join(left, "batch_no", "left_semi"))
            pending = B.with_prompts(pending, labels, noun).withColumn("texts", F.col("items.text"))
            call_labeller(pending.select("batch_no", "prompt", "texts"), labeller, attempt).write.mode("overwrite").parquet(path)
        got, answered = spark.read.parquet(path), True
        ok = got.withColumn("_p", B.parse_body(F.col("body"), labels, extract)).filter("_p.usable").select("batch_no")
        # ids alone, written: few enough to broadcast, they pick the next attempt's batches without a shuffle of texts
        left = _once(spark, f"{work_dir}/open/attempt={attempt}", lambda: left.join(ok, "batch_no", "left_anti"))
        if left.isEmpty():
            break
    numbered = (batches.select("batch_no", F.explode("items").alias("x"))
                .select(F.col("x.id").alias(row_id), "batch_no", "x.pos", F.lit(None).cast("string").alias("predicted")))
    if not answered:
        return numbered.select(row_id, "predicted").limit(0)
    responses = spark.read.parquet(f"{work_dir}/responses")
    resolved = B.resolve_attempts(responses, labels, extract, max_attempts)
    written = B.write_back(numbered, resolved)
    return written.filter(F.col("predicted").isNotNull()).select(row_id, "predicted")


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the runs that share a checkpoint, kept as a folder name inside it; a fresh checkpoint gets a new one."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(checkpoint)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root):
        for s in fs.listStatus(root):
            if s.getPath().getName().startswith("run-"):
                return s.getPath().getName()
    name = f"run-{uuid.uuid4().hex[:12]}"
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(root, name))
    return name


def _unlabelled(rows: DataFrame, output_path: str, row_id: str, own: str) -> DataFrame:
    """Rows that no *other* partition of the output has labelled. A replayed epoch thus works on all its
    rows again and may overwrite its own partition without losing any. The output is read only where
    its row ids lie between this batch's smallest and largest (files and row groups outside are skipped).
    The ids left are written first: where they are few they are broadcast, and no text is shuffled."""
    spark = rows.sparkSession
    if not _table_exists(spark, output_path):
        return rows
    low, high = rows.agg(F.min(row_id), F.max(row_id)).first()
    done = (spark.read.parquet(output_path).filter(F.col("part").cast("string") != own)
            .filter(F.col(row_id).between(F.lit(low), F.lit(high))).select(row_id))
    path = scratch_dir(spark, "unlabelled")
    rows.select(row_id).join(done, row_id, "left_anti").write.parquet(path)
    left = spark.read.parquet(path).select(F.col(row_id).alias("_left"))
    return rows.join(left, F.col(row_id).eqNullSafe(F.col("_left")), "left_semi")


def _write(out: DataFrame, output_path: str, own: str) -> None:
    (out.withColumn("part", F.lit(own)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(output_path))


def start(spark: SparkSession, input_path: str, schema: str, output_path: str, checkpoint: str,
          labeller: Labeller, labels: Sequence[str], noun: str, row_id: str = "row_id",
          text: str = "text", **kw):
    """Start the resumable labelling stream; returns the ``StreamingQuery`` (availableNow).

    Each epoch writes a partition named after the checkpoint's run id and the epoch, so a run with a
    fresh checkpoint never touches what an earlier run wrote.
    """
    run = _run_id(spark, checkpoint)

    def each(batch: DataFrame, epoch_id: int) -> None:
        own = f"{run}-{epoch_id}"
        todo = _unlabelled(batch, output_path, row_id, own)
        if todo.limit(1).count() == 0:
            return
        work = f"{checkpoint.rstrip('/')}/work/epoch={epoch_id}"
        _write(label_once(todo, labeller, labels, noun, work, row_id, text, **kw), output_path, own)

    stream = spark.readStream.schema(schema).parquet(input_path)
    return (stream.writeStream.foreachBatch(each).trigger(availableNow=True)
            .option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").start())


def catch_up(spark: SparkSession, input_path: str, output_path: str, work_dir: str, labeller: Labeller,
             labels: Sequence[str], noun: str, row_id: str = "row_id", text: str = "text", **kw) -> None:
    """Batch pass over rows the stream left unlabelled (failed batches); every pass writes its own partition."""
    own = f"catch-{uuid.uuid4().hex[:12]}"
    todo = _unlabelled(spark.read.parquet(input_path), output_path, row_id, own)
    if todo.limit(1).count() == 0:
        return
    work = f"{work_dir.rstrip('/')}/{own}"
    _write(label_once(todo, labeller, labels, noun, work, row_id, text, **kw), output_path, own)


# ---------------------------------------------------------------- deterministic offline labeller

def h32_text(s: str) -> int:
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:8], 16)


def offline_labeller(labels: Sequence[str], failing: Callable[[int, int], bool] | None = None) -> Labeller:
    """A reproducible stand-in for a remote labeller: label = labels[h32(text) % K].

    ``failing(batch_no, attempt)`` makes chosen calls answer with text that is not JSON.
    """
    labels = list(labels)

    def label(prompt: str, texts: list[str], batch_no: int, attempt: int) -> str:
        if failing is not None and failing(batch_no, attempt):
            return "The service is unavailable."
        return json.dumps({str(i + 1): labels[h32_text(t) % len(labels)] for i, t in enumerate(texts)})

    return label
