import random
from collections import Counter

import pytest

from labelops.llm import tokencount as T


@pytest.fixture(scope="module")
def vocab():
    return T.pieces()


def greedy(word, vocabulary):
    """Longest match by trying every length; the end symbol alone counts nothing."""
    rest, n = (*word, T.END), 0
    while rest and rest != (T.END,):
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in vocabulary), 0)
        if not size:
            return -1
        rest, n = rest[size:], n + 1
    return n


def test_small_vocabularies_against_trying_every_length():
    rng = random.Random(6)
    for _ in range(300):
        letters = [97, 98, 99]
        vocabulary = {(c,) for c in letters[rng.randrange(2):]} | {(c, T.END) for c in letters}
        for _ in range(rng.randrange(12)):
            piece = tuple(rng.choices(letters, k=rng.randrange(2, 6)))
            vocabulary.add(piece + (T.END,) * rng.randrange(2))
        machine = T.Automaton(vocabulary)
        for _ in range(20):
            word = bytes(rng.choices(letters, k=rng.randrange(1, 15)))
            assert machine.count(word) == greedy(word, vocabulary)


def test_documents_against_brute_force(docs, rows, vocab):
    whole, known = set(vocab), {}
    want = Counter()
    for r in rows:
        ws = (r["text"] or "").lower().encode().split()
        for w in set(ws) - known.keys():
            known[w] = greedy(w, whole)
        want[r["doc_id"], len((r["text"] or "").encode()), len(ws), sum(known[w] for w in ws)] += 1
    out = T.token_counts(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_words"], r["n_tokens"]) for r in out) == want
    assert min(known.values()) > 0


def test_empty(empty):
    assert T.token_counts(empty).collect() == []
