"""File sources and sinks on files written by the test."""

import glob
import json
import tempfile

from pyspark.sql import functions as F

from labelops.sources import files as IO
from labelops.streaming import resume as R


def test_bom_csv_roundtrip(spark):
    rows = [(1, 'سلام، "دنیا"\nخط دوم', "positive"), (2, "plain, text", "neutral")]
    df = spark.createDataFrame(rows, "id bigint, text string, sentiment string").coalesce(1)
    out = tempfile.mkdtemp(prefix="labelops-test-") + "/out.csv"
    IO.write_csv(df, out)
    part = sorted(glob.glob(out + "/part-*.csv"))[0]
    assert open(part, "rb").read(3) == b"\xef\xbb\xbf"
    back = IO.read_csv(spark, out, "id bigint, text string, sentiment string")
    assert sorted((r.id, r.text, r.sentiment) for r in back.collect()) == sorted(rows)
    assert [r.id for r in back.orderBy("row_id").collect()] == [1, 2]


def test_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="labelops-test-")
    with open(d + "/a.csv", "w", encoding="utf-8") as fh:
        fh.write("text,label\nhello,NA\nworld,\n")
    plain = IO.read_csv(spark, d + "/a.csv", "text string, label string")
    assert sorted((r.label or "") for r in plain.collect()) == ["", "NA"]
    na = IO.read_csv(spark, d + "/a.csv", "text string, label string", na_tokens=["NA"])
    assert [r.label for r in na.collect()] == [None, None]


def test_encoding_detection(spark):
    d = tempfile.mkdtemp(prefix="labelops-test-")
    with open(d + "/u.csv", "w", encoding="utf-8-sig") as fh:
        fh.write("text,label\nخوب است,positive\n")
    with open(d + "/w.csv", "w", encoding="cp1256") as fh:
        fh.write("text,label\nبد است,negative\n")
    r = IO.read_csv_any_encoding(spark, [d + "/u.csv", d + "/w.csv"], "text string, label string")
    got = {x.label: (x.text, x._encoding) for x in r.collect()}
    assert got == {"positive": ("خوب است", "utf-8"), "negative": ("بد است", "windows-1256")}


def test_atomic_replace(spark):
    path = tempfile.mkdtemp(prefix="labelops-test-") + "/t"
    IO.atomic_replace(spark.range(3), path)
    IO.atomic_replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_resume_labels_each_row_once(spark):
    base = tempfile.mkdtemp(prefix="labelops-test-")
    src = spark.createDataFrame([(i, f"text number {i}") for i in range(95)], "row_id bigint, text string")
    src.write.parquet(base + "/in")
    labels = ["a", "b", "c"]
    q = R.start(spark, base + "/in", "row_id bigint, text string", base + "/out", base + "/ck",
                R.offline_labeller(labels, lambda b, a: b == 2), labels, "tag")
    q.awaitTermination()
    first = spark.read.parquet(base + "/out")
    assert first.count() == 75  # batch 2 (20 rows) failed every attempt
    R.catch_up(spark, base + "/in", base + "/out", base + "/cu", R.offline_labeller(labels), labels, "tag")
    out = spark.read.parquet(base + "/out")
    assert out.count() == 95 and out.select("row_id").distinct().count() == 95
    expect = {i: labels[R.h32_text(f"text number {i}") % 3] for i in range(95)}
    assert {r.row_id: r.predicted for r in out.collect()} == expect
    # a rerun of the stream finds nothing new to label
    q2 = R.start(spark, base + "/in", "row_id bigint, text string", base + "/out", base + "/ck",
                 R.offline_labeller(labels), labels, "tag")
    q2.awaitTermination()
    assert spark.read.parquet(base + "/out").count() == 95
    json.dumps({})


def test_reruns_and_replays_lose_no_labels(spark, tmp_path):
    """A failing stream, two catch-up passes, a fresh checkpoint and a replayed epoch: every label stays."""
    from labelops.streaming import resume as R

    base, labels = str(tmp_path), ["a", "b"]
    spark.createDataFrame([(i, f"text {i}") for i in range(60)], "row_id long, text string").repartition(1).write.parquet(base + "/in")

    def run(checkpoint, failing):
        q = R.start(spark, base + "/in", "row_id bigint, text string", base + "/out", base + checkpoint,
                    R.offline_labeller(labels, failing), labels, "tag", batch_size=20)
        q.awaitTermination()

    def rows():
        ids = [r["row_id"] for r in spark.read.parquet(base + "/out").collect()]
        assert len(ids) == len(set(ids))
        return len(ids)

    run("/ck1", lambda b, a: b == 3)
    assert rows() == 40
    for _ in range(2):
        R.catch_up(spark, base + "/in", base + "/out", base + "/cu", R.offline_labeller(labels, lambda b, a: True), labels, "tag",
                   batch_size=20)
        assert rows() == 40
    run("/ck2", None)
    assert rows() == 60
    # the epoch of the first run again, as after a lost commit: it writes its own partition anew
    own = [r["part"] for r in spark.read.parquet(base + "/out").select("part").distinct().collect()]
    first = next(p for p in own if spark.read.parquet(base + "/out").filter(f"part = '{p}'").count() == 40)
    again = R._unlabelled(spark.read.parquet(base + "/in"), base + "/out", "row_id", first)
    assert again.count() == 40


def test_raising_labeller_leaves_its_batch(spark, tmp_path):
    from labelops.streaming import resume as R

    def labeller(prompt, texts, batch_no, attempt):
        if batch_no == 2:
            raise ConnectionError("down")
        import json

        return json.dumps({str(i + 1): "a" for i in range(len(texts))})

    base = str(tmp_path)
    spark.createDataFrame([(i, f"text {i}") for i in range(30)], "row_id long, text string").write.parquet(base + "/in")
    R.catch_up(spark, base + "/in", base + "/out", base + "/cu", labeller, ["a", "b"], "tag", batch_size=10)
    assert spark.read.parquet(base + "/out").count() == 20


def test_strict_json_rejects_what_json_rejects(spark):
    import json

    from labelops.operators import batches as B

    bodies = ['{"1": "a"}', '{"1": "a\\q"}', '{"1": "\\u12"}', '{"1": "a\nb"}', '{"1": "a\tb"}', '{"1": "\\u00e9 \\" \\\\"}', '{}', '{"1": "a",}']

    def strict(b):
        try:
            return all(isinstance(v, str) for v in json.loads(b).values())
        except ValueError:
            return False

    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r["ok"] for r in df.select("body", df.body.rlike(B.STRICT_OBJECT).alias("ok")).collect()]
    assert got == [strict(b) for b in bodies]
