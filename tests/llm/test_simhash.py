import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from labelops.llm import simhash as S


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """Smallest id reachable, for (id, fingerprint) pairs."""
    root = {f: f for _, f in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in pairs)


def got(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())


def test_long_text_is_hashed_in_chunks(monkeypatch):
    text = " ".join(random.Random(3).choices(["aa", "b", "Cc", "dd"], k=500))
    monkeypatch.setattr(S, "HASH_CHUNK", 7)
    assert S.fingerprint(text) == brute_fp(text)


def test_documents_against_brute_force(docs, rows):
    assert got(S.near_dups(docs)) == brute_components([(r["doc_id"], brute_fp(r["text"])) for r in rows])


@pytest.mark.parametrize("leaf", [4, 64])
def test_dense_cluster_is_split_and_linked(spark, leaf):
    """Nodes over the leaf size go down the trie; chains of two-bit steps stay connected."""
    rng = random.Random(leaf)
    fps, x = set(), rng.getrandbits(64)
    for _ in range(300):
        fps.add(x)
        for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
            x ^= 1 << b
        if rng.random() < 0.05:
            x = rng.getrandbits(64)
    fps = list(fps) + [0, 1, 2**64 - 1]
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "id long, fp long")
    links = S.trie_links(df, leaf=leaf)
    roots = {r["id"]: r["root"] for r in S.components(links).collect()}
    want = brute_components(list(enumerate(fps)))
    assert Counter((i, f"{f:016x}", roots.get(i, i)) for i, f in enumerate(fps)) == want


def test_empty(empty):
    assert S.near_dups(empty).collect() == []


def test_texts_under_one_id_do_not_join_their_groups(spark):
    """Ids 3 and 5 share one text, 5 and 9 another: two components, as their fingerprints do not link."""
    one, two = "alpha beta gamma delta epsilon zeta", "one two three four five six seven eight"
    rows = [(3, one), (5, one), (5, two), (9, two), (None, "a third text of its own"), (None, "and a fourth one, also alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_dups(df).collect())
    assert got == brute_components([(i, brute_fp(t)) for i, t in rows])
    assert sorted((r[0], r[2]) for r in got if r[0]) == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_a_third_of_the_rows_without_an_id(spark):
    rng = random.Random(4)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(rng.choices("abcdef", k=12))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_dups(df).collect())
    assert got == brute_components([(i, brute_fp(t)) for i, t in rows])
