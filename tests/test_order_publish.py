"""Total order (SRT-1), gapless replacement (SNK-2) and the chi-square tail (AGG-20)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from labelops.operators import compare as CP
from labelops.operators import order as O
from labelops.sources import files as IO


def test_positions_are_dense_and_in_code_point_order(spark):
    rng = random.Random(3)
    words = ["", "a", "B", "é", "z", "￮", "\U0001f600", "ab", None]
    rows = [(rng.choice(words), k) for k in range(400)] + [("same", 1000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "text string, id long").repartition(5)
    got = {r.id: r.position for r in O.number_sorted(df, ["text", "id"], ranges=6).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert got == {k: n for n, (_, k) in enumerate(want, 1)}


def test_no_range_holds_the_ties(spark):
    """Equal texts spread over the ranges by the rest of the key."""
    df = spark.range(4000).select(F.lit("same text").alias("text"), F.col("id"))
    n = df.repartitionByRange(8, "text", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(n) >= 6 and max(r["count"] for r in n) < 1500
    assert O.number_sorted(df, ["text", "id"], ranges=8).filter("position <> id + 1").isEmpty()


def test_order_of_nothing(spark):
    assert O.number_sorted(spark.range(0), ["id"]).collect() == []


def test_a_reader_always_finds_a_whole_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        IO.read_published(spark, path)
    IO.publish(spark.range(3), path)
    before = IO.read_published(spark, path)
    seen = []
    real = IO._fs

    def watching(s, p):  # a look at the table at every step of the next publication
        if not p.endswith(IO.POINTER):
            seen.append(IO.read_published(spark, path).count())
        return real(s, p)

    monkeypatch.setattr(IO, "_fs", watching)
    IO.publish(spark.range(5), path)
    monkeypatch.setattr(IO, "_fs", real)
    assert seen and set(seen) <= {3, 5}
    assert before.count() == 3 and IO.read_published(spark, path).count() == 5  # the old version is kept
    IO.publish(spark.range(7), path)
    IO.publish(spark.range(9), path)
    assert IO.read_published(spark, path).count() == 9
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.publish(spark.range(4), path)
    with pytest.raises(Exception):
        IO.publish(spark.range(4).select(F.raise_error(F.lit("stop")).alias("x")), path)
    assert IO.read_published(spark, path).count() == 4


def test_erfc(spark):
    ys = [0.0, 1e-8, 0.1, 0.7, 1.5, 2.4, 2.5, 2.6, 3.5, 5.0, 9.0]
    got = spark.createDataFrame([(y,) for y in ys], "y double").select(CP.erfc(F.col("y"))).collect()
    for y, r in zip(ys, got):
        assert math.isclose(r[0], math.erfc(y), rel_tol=1e-10, abs_tol=1e-13)
