import random
import re
import zlib
from collections import Counter

import pytest

from labelops.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near_of(vocab):
    """All pairs one edit apart, through wildcards and deletions of every word."""
    known, by, out = set(vocab), {}, {w: set() for w in vocab}
    for w in vocab:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1:]), set()).add(w)
            if (v := w[:i] + w[i + 1:]) in known and v:
                out[w].add(v)
                out[v].add(w)
    for group in by.values():
        for w in group:
            out[w] |= group - {w}
    return out


def brute(rows, least=5, support=3):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= support}
    form, near = {}, near_of(n)
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def found(docs, **how):
    df = S.variants(docs, **how)
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(docs, rows):
    want = brute([(r["doc_id"], r["text"]) for r in rows])
    assert found(docs) == want and any(r[1] for r in want)


@pytest.mark.parametrize("letters,longest", [("ab", 9), ("abcÿ", 7), ("a", 30)])
def test_search_finds_every_pair_once(letters, longest):
    rng = random.Random(longest)
    vocab = sorted({"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(200)})
    got = [p[1:] for p in S.near_words(vocab, vocab, vocab)]
    assert len(got) == len(set(got))
    want = near_of(vocab)
    assert {p for w, v in got for p in ((w, v), (v, w))} == {(w, v) for w in vocab for v in want[w]}


def test_hot_halves_are_dealt_in_parts(spark):
    """A third of the words share their left half; small parts give the same result."""
    rng = random.Random(2)
    words = [("prefix" if rng.random() < 0.4 else "".join(rng.choices("efg", k=6))) + "".join(rng.choices("xyz", k=rng.randint(4, 6)))
             for _ in range(400)]
    rows = [(i, " ".join([w] * rng.randint(3, 9))) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, hot=7, bucket=30) == brute(rows)


def test_chains_edits_and_long_words(spark):
    long = "ab" * 3000
    rows = [(1, "abcdef " * 3 + "abcdeg " * 6 + "abcdhg " * 12 + "xbcdhg " * 24), (2, f"{long} {long}b " * 3 + f"{long} " * 9),
            (3, "ÀÉÈabc àéèabc ÀÉÈABC " * 40), (4, " ".join(f"word{c}word" for c in "abcdefghijklmnop") * 40),
            (None, "nullid " * 4), (None, "nullid " * 4), (5, None), (6, ""), (7, "tie aaaaa aaaab aaaac " * 3 + "aaaab aaaac")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n")
    got = found(df)
    assert got == brute(rows)
    assert ("abcdef", "abcdeg", "xbcdhg", 3, 1, 6) in got


def test_parts_of_a_long_text():
    text = "alpha beta gamma " * 50 + "x" * 500 + " end"
    parts = list(S._parts(text, 40))
    assert "".join(parts) == text and Counter(w for p in parts for w in S.RUN.findall(p)) == Counter(S.RUN.findall(text))


def test_empty(empty):
    assert found(empty) == []
