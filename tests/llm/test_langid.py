import math
import random
import zlib
from functools import lru_cache

import numpy as np

from labelops.llm import langid as I


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"]
    rng = np.random.default_rng(1)
    prob = np.append(rng.random((len(pieces) + 1, 2)), [[0, 0]], axis=0)
    scorer = I.Scorer(["x", "y"], pieces, prob)
    at = {p: i for i, p in enumerate(pieces)}
    words = ["▁" + "".join(random.Random(k).choices("abc", k=1 + k % 7)) for k in range(40)]
    scorer.learn_words(words)

    def total(w, lang):
        @lru_cache(None)
        def rest(i):
            if i == len(w):
                return 1.0
            got = 0.0
            for j in range(i + 1, len(w) + 1):
                k = at.get(w[i:j], len(pieces) if j == i + 1 else None)
                if k is not None:
                    got += prob[k, lang] * rest(j)
            return got
        return rest(0)

    for w in words:
        for lang in (0, 1):
            assert math.isclose(scorer.rows[scorer.at[w], lang], math.log(total(w, lang)), rel_tol=1e-9)


def test_em_raises_the_likelihood():
    pieces, words = ["▁", "▁the", "the", "re", "a", "t", "h", "e", "r"], ["▁there", "▁the", "▁a", "▁tree"]
    n = np.array([3.0, 5.0, 2.0, 1.0])
    like = []
    for rounds in (0, 1, 4):
        prob = I.fit_language(words, n, pieces, rounds)
        s = I.Scorer(["x"], pieces, prob[:, None])
        s.learn_words(words)
        like.append(float(sum(c * s.rows[s.at[w], 0] for w, c in zip(words, n))))
    assert like[0] < like[1] < like[2] + 1e-9


def test_held_out_accuracy_and_odd_rows(docs, rows):
    out = I.identify(docs, docs.filter(~I.held_out())).collect()
    got = [(r["row"]["doc_id"], r["row"]["text"], r["row"]["lang"], r["lang_pred"], r["score"]) for r in out]
    assert len(got) == len(rows)
    held = [g for g in got if g[0] is not None and 0 <= g[0] < 9000 and zlib.crc32(str(g[0]).encode()) % 4 == 2]
    assert len(held) > 20 and sum(g[2] == g[3] for g in held) >= 0.9 * len(held)
    assert {g[3:] for g in got if not (g[1] or "").strip()} == {("und", 0.0)}
    assert all(0 <= g[4] <= 1 for g in got)


def test_nothing_to_learn_and_empty(docs, empty):
    assert {r["lang_pred"] for r in I.identify(docs, empty).collect()} == {"und"}
    assert I.identify(empty, empty).collect() == []


def test_long_runs_are_whole():
    """Runs of 100 letters and more: the sum over all segmentations, also across any cut."""
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab", "abababababab"]
    rng = np.random.default_rng(3)
    prob = np.append(rng.random((len(pieces) + 1, 2)), [[0, 0]], axis=0)
    prob /= prob.sum(axis=0)
    s, at = I.Scorer(["x", "y"], pieces, prob), {p: i for i, p in enumerate(pieces)}
    for n in (31, 32, 33, 100, 700):
        w = "▁" + "".join(random.Random(n).choices("ababc", k=n))
        for lang in (0, 1):
            alpha = [0.0]  # exact logarithms by Python's own sums
            for j in range(1, len(w) + 1):
                terms = []
                for i in range(max(0, j - 13), j):
                    k = at.get(w[i:j], len(pieces) if j == i + 1 else None)
                    if k is not None:
                        terms.append(alpha[i] + math.log(prob[k, lang]))
                top = max(terms)
                alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            assert math.isclose(s.total([w])[lang], alpha[-1], rel_tol=1e-9)


def test_long_words_count_in_the_fit():
    """Forward-backward in logarithms agrees with the plain one on a word that both can take."""
    pieces, w = ["▁", "▁a", "a", "b", "ab", "ba"], "▁" + "abbab" * 5
    rng = np.random.default_rng(5)
    prob = np.append(rng.random(len(pieces) + 1), 0)
    lattice = I.Lattice(pieces)
    spans, found = lattice.edges([w], len(w))
    alpha, beta = lattice.forward(spans, found, len(w), prob), np.zeros((len(w) + 1, 1))
    beta[-1], got = 1, np.zeros(len(prob))
    for (i, j), k in reversed(list(zip(spans, found[0]))):
        beta[i] += beta[j] * prob[k]
    for (i, j), k in zip(spans, found[0]):
        got[k] += (alpha[i] * prob[k] * beta[j] / alpha[-1])[0]
    assert np.allclose(lattice.long_counts(w, I._log(prob)), got)
    prob = I.fit_language([w * 4, "▁ab"], np.array([2.0, 3.0]), pieces)
    assert np.isfinite(prob).all() and math.isclose(prob.sum(), 1)


def test_parts_and_a_small_cache_change_no_score(rows, monkeypatch):
    texts = [r["text"] for r in rows][:60] + ["", None, "12 34", "x" * 500 + " end of it"]
    pieces = I.vocabulary()
    prob = np.append(np.random.default_rng(2).random((len(pieces) + 1, 3)), np.zeros((1, 3)), axis=0)
    prob /= prob.sum(axis=0)
    whole = I.Scorer(["a", "b", "c"], pieces, prob).score(texts)
    monkeypatch.setattr(I, "PART", 100)
    monkeypatch.setattr(I, "CACHE", 40)
    monkeypatch.setattr(I.parts_of, "__defaults__", (100,))
    monkeypatch.setattr(I._slices, "__defaults__", (100,))
    parts = I.Scorer(["a", "b", "c"], pieces, prob).score(texts)
    assert [p[0] for p in parts] == [p[0] for p in whole]
    assert np.allclose([p[1] for p in parts], [p[1] for p in whole])
