import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelops.llm import linededup as L


def words(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, min_words=L.MIN_WORDS):
    """{(id, line number): kept or not} by comparing every line with every earlier one."""
    all_ = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if w := words(line):
                all_.append(((L.NO_ID if d is None else d, k), w))
    out = []
    for place, w in all_:
        near = [p for p, v in all_ if p < place and (v == w or (min(len(v), len(w)) >= min_words and abs(len(v) - len(w)) < 2
                                                               and edits(v, w) <= 1))]
        out.append((place[0], place[1], not near))
    return sorted(out)


def got(df):
    rows = df.collect()
    return sorted((L.NO_ID if r["doc_id"] is None else r["doc_id"], r["line_no"], r["verdict"] == "kept") for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=7),
       st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=7))
def test_near_is_edit_distance_one(a, b):
    assert L.near(a, b) == (edits(a, b) <= 1)


def test_pairs_within_one_edit_share_half_key_and_variant():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice([b"x", b"y", b"zz"]) for _ in range(rng.randrange(2, 12))]
        b, i = list(a), rng.randrange(len(a))
        op = rng.randrange(3)
        if op == 0:
            b[i] = b"new"
        elif op == 1:
            del b[i]
        else:
            b.insert(i, b"new")
        assert set(L.half_keys(a)) & set(L.half_keys(b))
        every = [(h, True, True) for h in range(4)]
        va, vb = L.variants(a, every), L.variants(b, every)
        assert any((k, o) in vb for k, kind in va for o in {"s": "s", "d": "f", "f": "d"}[kind])


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocab = ["Alpha", "beta", "gamma", "straße", "delta", "eps", "zeta", "eta"]
    base = [" ".join(rng.choices(vocab, k=rng.randrange(1, 14))) for _ in range(25)]
    rows = [(None, base[0] + "\n" + base[1]), (50, None), (51, "\n \n"), (52, base[2].upper() + "\n\t" + base[2])]
    for d in range(60):
        out = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i, op = rng.randrange(len(w) + 1), rng.randrange(3)
                if op == 0:
                    w.insert(i, rng.choice(vocab))
                elif w and i < len(w):
                    w[i:i + 1] = [] if op == 1 else [rng.choice(vocab)]
            out.append(" ".join(w))
        rows.append((d, "\n".join(out)))
    rows += [rows[10], rows[11], (rows[12][0], rows[13][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.line_dedup(df, min_words=4)) == brute(rows, 4)


def test_documents_against_brute_force(docs, rows):
    assert got(L.line_dedup(docs)) == brute([(r["doc_id"], r["text"]) for r in rows])


@pytest.mark.parametrize("seed", [1])
def test_text_without_removed_lines(spark, seed):
    rows = [(1, "a b\nc d\n\na b", "x"), (2, "c d\nnew", "y"), (3, "a b", "z"), (4, None, None), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, verdict string")
    out = L.without_duplicates(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b\nc d\n", "x"), (2, "new", "y"), (4, None, None), (5, "", "e")]


def test_empty(empty):
    assert L.line_dedup(empty).collect() == []
    assert L.without_duplicates(empty).collect() == []


@pytest.mark.parametrize("id_", [None, 7])
def test_rows_that_share_an_id_are_rows_of_their_own(spark, id_):
    """Only one of two rows without an id (or under one id) holds a near-duplicate at line 0."""
    first = "one two three four five six seven eight nine"
    clean, near = "this line stands nowhere else in all of the input", first.replace("nine", "ten")
    a, b = "some words a b c d e f g h", "some words a b c d e f g x"
    rows = [(1, first), (id_, near), (id_, clean), (id_, "q\n" + a), (id_, "r\n" + b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(r["text"] for r in L.without_duplicates(df).collect())
    assert out in (sorted([first, clean, "q\n" + a, "r"]), sorted([first, clean, "q", "r\n" + b]))
    verdicts = [(r["verdict"], r["first_doc_id"], r["first_line_no"]) for r in L.line_dedup(df).collect() if r["verdict"] != "kept"]
    assert sorted(verdicts, key=str) == sorted([("near", 1, 0), ("near", id_, 1)], key=str)


def test_equal_rows_keep_their_lines(spark):
    df = spark.createDataFrame([(None, "a b\nc d"), (None, "a b\nc d"), (None, "a b\ne f")], "doc_id long, text string")
    out = [r["text"] for r in L.without_duplicates(df).collect()]
    assert sorted(out) in (["a b\nc d", "a b\nc d", "e f"], ["a b\ne f", "c d", "c d"])


def test_bitmap_leaves_wanted_rows_and_few_others(spark):
    """Texts that hold no line in question are not shuffled."""
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS rid", "id", "repeat('x', 100) AS text")
    wanted = rows.filter("id % 20 = 0").select("rid")
    got = {r.id for r in L.marked_rows(rows, wanted, 15).select("id").collect()}
    assert got >= set(range(0, 20_000, 20)) and len(got) < 2200
    plan = L.marked_rows(rows, wanted, 15)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(rid" not in plan
    assert L.marked_rows(rows, wanted.limit(0), 15).count() == 0
