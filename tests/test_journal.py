"""STR-1: nobody is asked twice in one attempt, whatever is lost in between."""

import json
from collections import Counter

import pytest

from labelops.streaming import resume as R

LABELS = ["a", "b"]


def counting(log, failing=lambda batch_no, attempt: False):
    def labeller(prompt, texts, batch_no, attempt):
        with open(log, "a") as f:
            f.writelines(f"{attempt}|{t}\n" for t in texts)
        if failing(batch_no, attempt):
            return "no answer"
        return json.dumps({str(i + 1): "a" for i in range(len(texts))})

    return labeller


def calls(log):
    try:
        with open(log) as f:
            return Counter(f.read().split("\n")[:-1])
    except FileNotFoundError:
        return Counter()


def rows(spark, n=45):
    return spark.createDataFrame([(i, f"text {i}") for i in range(n)], "row_id long, text string")


def test_a_replay_after_a_lost_commit_asks_nobody(spark, tmp_path):
    log, work = str(tmp_path / "log"), str(tmp_path / "work")
    first = R.label_once(rows(spark), counting(log, lambda b, a: b == 2 and a == 1), LABELS, "tag", work, batch_size=10)
    want = sorted(map(tuple, first.collect()))
    before = calls(log)
    again = R.label_once(rows(spark), counting(log), LABELS, "tag", work, batch_size=10)  # the output was never committed
    assert sorted(map(tuple, again.collect())) == want and len(want) == 45
    assert calls(log) == before and set(before.values()) == {1}
    assert sum(before.values()) == 45 + 10  # batch 2 again in its second attempt


def test_an_attempt_with_lost_answers_is_not_repeated(spark, tmp_path):
    log, work = str(tmp_path / "log"), str(tmp_path / "work")
    R._marker(spark, work + "/asked/attempt=1")  # the run died while attempt 1 was asking
    got = R.label_once(rows(spark), counting(log), LABELS, "tag", work, batch_size=10).collect()
    assert len(got) == 45 and {c.split("|")[0] for c in calls(log)} == {"2"}


def test_no_attempt_left(spark, tmp_path):
    log, work = str(tmp_path / "log"), str(tmp_path / "work")
    for k in (1, 2):
        R._marker(spark, f"{work}/asked/attempt={k}")
    assert R.label_once(rows(spark), counting(log), LABELS, "tag", work, max_attempts=2).collect() == []
    assert not calls(log)


def test_a_task_that_runs_again_asks_nobody(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    prompts = spark.createDataFrame([(1, "p", ["x"]), (2, "p", ["y"])], "batch_no int, prompt string, texts array<string>")
    monkeypatch.setattr(R, "_first_try", lambda: False)
    got = R.call_labeller(prompts, counting(log), 1).collect()
    assert not calls(log) and {r.body for r in got} == {"the task was run again"}


@pytest.mark.parametrize("low,high,left", [(0, 45, 25), (30, 45, 15), (0, 20, 0)])
def test_only_rows_without_a_label_are_left(spark, tmp_path, low, high, left):
    out = str(tmp_path / "out")
    R._write(rows(spark, 20).selectExpr("row_id", "'a' AS predicted"), out, "other")
    batch = rows(spark).filter(f"row_id >= {low} AND row_id < {high}")
    assert R._unlabelled(batch, out, "row_id", "own").count() == left
    assert R._unlabelled(batch, out, "row_id", "other").count() == high - low


def test_texts_are_grouped_once(spark, tmp_path, monkeypatch):
    """Later attempts read their batches from the journal instead of numbering and grouping all texts again."""
    log, work, plans, once = str(tmp_path / "log"), str(tmp_path / "work"), [], R._once

    def spy(session, path, make):
        def made():
            df = make()
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return df
        return once(session, path, made)

    monkeypatch.setattr(R, "_once", spy)
    got = R.label_once(rows(spark), counting(log, lambda b, a: b == 2 and a < 4), LABELS, "tag", work, batch_size=10)
    assert got.count() == 45 and sum("collect_list" in p for p in plans) == 1
    assert sum(calls(log).values()) == 45 + 3 * 10


def test_rows_without_an_id_stay_unlabelled(spark, tmp_path):
    out = str(tmp_path / "out")
    R._write(spark.range(5).selectExpr("id AS row_id", "'a' AS predicted"), out, "other")
    some = spark.createDataFrame([(None, "x"), (3, "y"), (4, "z"), (9, "w"), (9, "v")], "row_id long, text string")
    assert sorted(r.text for r in R._unlabelled(some, out, "row_id", "own").collect()) == ["v", "w", "x"]
