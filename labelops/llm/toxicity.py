"""Operator 4: toxic spans by a linear-chain conditional random field, scores from its marginals.

Tokens are runs of characters other than white space, each tagged toxic or not. A token's features
are its word (lower case, outer punctuation off) and the word's beginnings and endings, hashed into
a fixed number of weights; the chain adds a start weight and one weight per tag transition.

Training uses a bounded sample of labelled documents (``n_toxic`` and ``n_clean``, smallest hashes
first, found by a two-step top-n). Labels are per document, so tokens are labelled from them: in a
toxic document, a token is toxic if one of its features is found mostly in toxic documents (at
least ``MIN_SEEN`` of them, copies counted once, and ``MIN_RATIO`` times as often as in clean ones,
by share). Weights follow by gradient steps on the chain's likelihood, with forward-backward over
all sequences at once. A document's score is a logistic function of its largest token marginal and
of the (log) sum of the marginals over one half; its weights and offset are fitted on the same
sample. Tokens over one half are reported with their character offsets.

Scoring reads every text whole, in Arrow batches; documents of similar length go through the chain
together, so time is linear in the number of tokens and memory is bounded.

Defined results: null, empty and blank texts have no tokens and get the score of no evidence; with
no label of one of the classes everything scores 0; a null id counts as the empty string for the
held-out remainder; several labels of one id count as toxic if any is; repeated rows each come
back; other columns are ignored.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import ship_package

from .common import crc_mod

N_TOXIC = 1000
N_CLEAN = 2000
WEIGHTS = 1 << 18
AFFIXES = (3, 4, 5, 6)
MIN_SEEN = 8
MIN_RATIO = 20.0
STEPS = 40
RATE = 0.5
DECAY = 1e-4
SEGMENT = 256
CACHE = 400_000
OUTER = " \t\r\n.,;:!?\"'()[]{}<>*_-"


def features(token: str) -> list[int]:
    word = token.lower().strip(OUTER)
    names = [f"w{word}"]
    for n in AFFIXES:
        if len(word) >= n:
            names += [f"b{word[:n]}", f"e{word[-n:]}"]
    return [crc32(x.encode()) % WEIGHTS for x in names]


def marginals(e: np.ndarray, start: float, t: np.ndarray):
    """P(tag = 1) of each token. e (time, sequences): log odds of the tokens; t (2, 2) transitions.

    Only the ratio of the two tags' forward (and backward) messages is kept, so nothing overflows.
    Padding must carry e = 0 at the end; its backward message is then that of a free chain, so the
    caller passes sequences padded with nan, whose messages are reset.
    """
    pad = np.isnan(e)
    odds = np.exp(np.clip(np.where(pad, 0, e), -40, 40))
    m = np.exp(t)
    fwd, bwd = np.empty_like(odds), np.ones_like(odds)
    fwd[0] = odds[0] * np.exp(start)
    for i in range(1, len(odds)):
        r = fwd[i - 1]
        fwd[i] = odds[i] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
    for i in range(len(odds) - 2, -1, -1):
        q = odds[i + 1] * bwd[i + 1]
        b = (m[1, 0] + q * m[1, 1]) / (m[0, 0] + q * m[0, 1])
        bwd[i] = np.where(pad[i + 1], 1.0, b)
    both = fwd * bwd
    return np.where(pad, 0.0, both / (1 + both)), fwd, bwd


def _grid(lists, fill=np.nan):
    """Sequences as columns of a (time, sequences) grid, padded at the end."""
    size = np.array([len(x) for x in lists])
    grid = np.full((size.max(), len(lists)), fill)
    for k, x in enumerate(lists):
        grid[:len(x), k] = x
    return grid


def copies(docs: list[list[int]], words: list[str]) -> list[int]:
    """A group number per document; near copies share one (the least hash of their five-word shingles)."""
    code = [crc32(w.encode()) for w in words]
    least = [min((hash(tuple(code[k] for k in d[i:i + 5])) for i in range(max(1, len(d) - 4))), default=0) for d in docs]
    return least


def token_labels(docs: list[list[int]], toxic: np.ndarray, types: list[list[int]], words: list[str]) -> np.ndarray:
    """Which types count as toxic when they stand in a toxic document. docs: type numbers."""
    groups: dict[tuple, set[int]] = {}
    for d, y, g in zip(docs, toxic, copies(docs, words)):
        groups.setdefault((int(y), g), set()).update(d)
    seen, n = np.zeros((2, WEIGHTS)), np.zeros(2)
    for (y, _), kinds in groups.items():
        n[y] += 1
        seen[y][np.unique([f for k in kinds for f in types[k]]).astype(int)] += 1
    share = (seen + 0.5) / (n[:, None] + 1)
    telling = (seen[1] >= MIN_SEEN) & (share[1] >= MIN_RATIO * share[0])
    return np.array([telling[f].any() for f in types], bool)


def train(texts: list[str], toxic: np.ndarray) -> dict:
    """Chain weights and the document-level logistic weights from labelled texts."""
    index: dict[str, int] = {}
    docs = [[index.setdefault(w, len(index)) for w in t.split()] for t in texts]
    types = [features(w) for w in index]
    telling = token_labels(docs, toxic, types, list(index)) if types else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(types)), [len(f) for f in types])
    flat = np.array([f for fs in types for f in fs], int)
    segments = [(d[k:k + SEGMENT], y) for d, y in zip(docs, toxic) for k in range(0, len(d), SEGMENT)]
    theta, start, t = np.zeros(WEIGHTS), 0.0, np.zeros((2, 2))
    if segments:
        token = _grid([s for s, _ in segments], -1).astype(int)
        used = token >= 0
        gold = used & telling[token] & np.array([y for _, y in segments], bool)
        inner = used[1:]
        gold_pairs = np.array([[np.sum(inner & (gold[:-1] == a) & (gold[1:] == b)) for b in (0, 1)] for a in (0, 1)])
        size = used.sum()
        square, square_t, square_s = np.full(WEIGHTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
        for _ in range(STEPS):
            by_type = np.bincount(owner, theta[flat], len(types))
            e = np.where(used, by_type[token], np.nan)
            p, fwd, bwd = marginals(e, start, t)
            slope = np.bincount(token[used], (gold.astype(float) - p)[used], len(types))
            grad = np.bincount(flat, slope[owner], WEIGHTS) / size - DECAY * theta
            odds = np.exp(np.clip(np.where(used[1:], e[1:], 0), -40, 40))
            left, right, m = (1.0, fwd[:-1]), (1.0, odds * bwd[1:]), np.exp(t)
            mass = sum(m[a, b] * left[a] * right[b] for a in (0, 1) for b in (0, 1))
            joint = np.array([[np.sum((m[a, b] * left[a] * right[b] / mass)[inner]) for b in (0, 1)] for a in (0, 1)])
            grad_t = (gold_pairs - joint) / size - DECAY * t
            grad_t[0, 0] = 0  # one weight fixes the scale
            grad_s = float((gold[0] - p[0]).sum() / size - DECAY * start)
            square, square_t, square_s = square + grad**2, square_t + grad_t**2, square_s + grad_s**2
            theta = theta + RATE * grad / np.sqrt(square)
            t = t + RATE * grad_t / np.sqrt(square_t)
            start += RATE * grad_s / np.sqrt(square_s)
    model = {"theta": theta.astype(np.float32), "start": start, "t": t, "doc": None}
    evidence = np.array([[hi, np.log1p(total)] for hi, total, _ in Tagger(model).tag(texts)])
    model["doc"] = _logistic(evidence, toxic.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton steps with a small ridge; both classes weigh the same."""
    x = np.c_[x, np.ones(len(x))]
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - 1e-2 * beta
        hess = (x.T * (w * np.maximum(p * (1 - p), 1e-6))) @ x + 1e-2 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(hess, grad)
    return beta


class Tagger:
    """Marginals of whole texts, with a bounded cache of token log odds."""

    def __init__(self, model: dict):
        self.m, self.cache = model, {}

    def odds(self, words: list[str]) -> list[float]:
        cache, theta, out = self.cache, self.m["theta"], []
        if len(cache) > CACHE:
            cache.clear()
        for w in words:
            v = cache.get(w)
            if v is None:
                v = cache[w] = float(theta[features(w)].sum())
            out.append(v)
        return out

    def tag(self, texts, group: int = 256):
        """(largest marginal, sum of those over one half, [(token number, marginal)] of these) of each text."""
        lists = [(t or "").split() for t in texts]
        out = [(0.0, 0.0, [])] * len(lists)
        order = sorted((k for k in range(len(lists)) if lists[k]), key=lambda k: len(lists[k]))
        at = 0
        while at < len(order):
            longest = len(lists[order[min(at + group, len(order)) - 1]])
            some = order[at:at + max(1, min(group, 4_000_000 // longest))]
            p, _, _ = marginals(_grid([self.odds(lists[k]) for k in some]), self.m["start"], self.m["t"])
            high, total = p.max(axis=0), np.where(p > 0.5, p, 0).sum(axis=0)
            for c, k in enumerate(some):
                hits = np.flatnonzero(p[:, c] > 0.5).tolist() if high[c] > 0.5 else []
                out[k] = (float(high[c]), float(total[c]), [(i, float(p[i, c])) for i in hits])
            at += len(some)
        return out

    def score(self, texts):
        """(score, spans) of each text; spans are (start, end, marginal) in characters."""
        out = []
        for t, (high, total, hits) in zip(texts, self.tag(texts)):
            z = float(np.dot(self.m["doc"], [high, np.log1p(total), 1.0]))
            spans = []
            if hits:
                wanted = dict(hits)
                for i, found in enumerate(re.finditer(r"\S+", t)):
                    if i in wanted:
                        spans.append((*found.span(), wanted[i]))
            out.append((1 / (1 + np.exp(-max(-30.0, min(30.0, z)))), spans))
        return out


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """text, toxic of at most ``n_toxic`` and ``n_clean`` labelled documents."""
    ids = (labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"),
                   F.when(F.col("toxic") == 1, n_toxic).otherwise(n_clean).alias("most")))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    ids = ids.withColumn("r", rank("toxic", F.pmod("h", F.lit(64)))).filter(F.col("r") <= F.col("most"))
    ids = ids.withColumn("r", rank("toxic")).filter(F.col("r") <= F.col("most")).select("doc_id", "toxic").checkpoint()
    # at most n_toxic + n_clean rows, whatever the corpus
    return docs.join(F.broadcast(ids), "doc_id").filter(F.col("text").isNotNull()).select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             n_toxic: int = N_TOXIC, n_clean: int = N_CLEAN) -> DataFrame:
    """doc_id, score, predicted, spans for every row of docs, learned from the ids in labels."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    rows = sorted(map(tuple, sample(base, marks, n_toxic, n_clean).collect()))
    toxic = np.array([y for _, y in rows], int)
    model = train([x for x, _ in rows], toxic) if 0 < toxic.sum() < len(toxic) else None
    shared = spark.sparkContext.broadcast(model)

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches):
        tagger = Tagger(shared.value) if shared.value else None
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for k in range(0, len(texts), 1024):
                got = tagger.score(texts[k:k + 1024]) if tagger else [(0.0, [])] * len(texts[k:k + 1024])
                spans = [[dict(zip(("start", "end", "marginal"), s)) for s in g[1]] for g in got]
                yield pa.RecordBatch.from_arrays([ids.slice(k, len(got)), pa.array([float(g[0]) for g in got]),
                                                  pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array(spans, span)],
                                                 names=["doc_id", "score", "predicted", "spans"])

    return base.mapInArrow(run, "doc_id long, score double, predicted int, "
                                "spans array<struct<start:int,end:int,marginal:double>>")


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 5) == 0
