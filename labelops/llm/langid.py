"""Operator 10: language identification by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, computed by the forward algorithm;
a text's is the product over its words (runs of letters, lower case). The language with the largest
posterior wins; the posterior is the score.

Fitting: the piece probabilities come from expectation maximisation (forward-backward counts) on a
bounded sample: at most ``per_lang`` training documents of each language, those with the smallest
hashes. The sample is found by a two-step top-n, so no task sees a whole language. Each language is
fitted in a task of its own; what reaches the driver is vocabulary x languages numbers.
Scoring reads every text whole; scores of short words are cached in a task up to a bound in bytes.

Defined results: null text or text without a letter gives ``und`` and 0; with nothing to learn from,
every document does; a null id counts as the empty string for the held-out remainder; ties go to
the alphabetically first language; repeated rows each come back; other columns are ignored. Runs of
letters of any length are whole: up to ``SHORT`` letters many at once, longer ones by a forward pass
in logarithms that keeps the last alphas only. Long texts are read in parts that end between runs.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import ship_package

from .common import crc_mod, freeing

START = "▁"  # the vocabulary's mark of a word's start
LETTERS = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[\W\d_]")
SHORT = 32  # letters up to which probabilities are plain numbers
PART = 1 << 20  # characters of a text handled at a time
PER_LANG = 400
ROUNDS = 4
ALPHA = 0.1
CACHE = 300_000  # words a task remembers, and the bytes of their scores
CACHE_BYTES = 32 << 20


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-case letter pieces of a public piece vocabulary."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    letters = (p for p in every if p == START or (p == p.lower() and LETTERS.fullmatch(p.removeprefix(START))))
    return sorted(letters)


def words_of(text: str) -> list[str]:
    return [START + w for w in LETTERS.findall(text.lower())]


def parts_of(text: str, most: int = PART):
    """A text in parts of about ``most`` characters, cut where a run of letters ends."""
    at = 0
    while len(text) - at > most:
        m = GAP.search(text, at + most)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


class Lattice:
    """All segmentations of many words of one length at once. Piece indices: len(pieces) is an
    unknown single character, len(pieces) + 1 stands for no piece (probability 0)."""

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)

    def by_length(self, words):
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= SHORT + 1:
                groups.setdefault(len(w), []).append(i)
        for n, at in groups.items():
            for k in range(0, len(at), 4096):
                yield n, at[k:k + 4096]

    def edges(self, words: list[str], n: int):
        """(from, to) of each edge and the piece index of every word on it: shape (words, edges)."""
        spans = [(j - k, j) for j in range(1, n + 1) for k in range(1, min(j, self.longest) + 1)]
        get, none = self.index.get, self.none
        found = np.array([get(w[i:j], none) for w in words for i, j in spans], np.int32).reshape(len(words), -1)
        single = np.array([j - i == 1 for i, j in spans])
        found[:, single] = np.where(found[:, single] == none, self.unknown, found[:, single])
        return spans, found

    def forward(self, spans, found, n: int, prob: np.ndarray):
        """Alphas of shape (n + 1, words, ...) under prob (pieces + 2, ...)."""
        alpha = np.zeros((n + 1, len(found)) + prob.shape[1:])
        alpha[0] = 1
        for e, (i, j) in enumerate(spans):
            alpha[j] += alpha[i] * prob[found[:, e]]
        return alpha

    def ways(self, word: str):
        """For each place 1, 2, ... of a long word: where the pieces that end there begin, and which they are."""
        get = self.index.get
        for j in range(1, len(word) + 1):
            begin, piece = [], []
            for i in range(j - 1, max(0, j - self.longest) - 1, -1):
                k = get(word[i:j])
                if k is not None or i == j - 1:
                    begin.append(i)
                    piece.append(self.unknown if k is None else k)
            yield j, begin, piece

    def long_forward(self, word: str, log_prob: np.ndarray) -> np.ndarray:
        """Log probability of a word of any length (per language); keeps the last alphas only."""
        last = np.full((self.longest + 1,) + log_prob.shape[1:], -np.inf)
        last[0] = 0
        for j, begin, piece in self.ways(word):
            last[j % len(last)] = np.logaddexp.reduce(last[[i % len(last) for i in begin]] + log_prob[piece], axis=0)
        return last[len(word) % len(last)]

    def long_counts(self, word: str, log_prob: np.ndarray) -> np.ndarray:
        """Expected piece counts of a word of any length (forward-backward in logarithms, one language)."""
        ways = list(self.ways(word))
        alpha, beta = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
        alpha[0] = beta[-1] = 0
        for j, begin, piece in ways:
            alpha[j] = np.logaddexp.reduce(alpha[begin] + log_prob[piece])
        got = np.zeros(len(log_prob))
        for j, begin, piece in reversed(ways):
            np.add.at(got, piece, np.exp(alpha[begin] + log_prob[piece] + beta[j] - alpha[-1]))
            beta[begin] = np.logaddexp(beta[begin], log_prob[piece] + beta[j])
        return got


def _log(prob: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(prob)


def fit_language(words: list[str], counts: np.ndarray, pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces + 2) of one language from its word counts."""
    lattice = Lattice(pieces)
    prob = np.full(len(pieces) + 2, 1 / (len(pieces) + 1))
    prob[-1] = 0
    shapes = [(n, at, *lattice.edges([words[i] for i in at], n)) for n, at in lattice.by_length(words)]
    long = [(w, c) for w, c in zip(words, counts) if len(w) > SHORT + 1]
    for _ in range(rounds):
        got = np.zeros(len(pieces) + 2)
        for n, at, spans, found in shapes:
            alpha = lattice.forward(spans, found, n, prob)
            beta = np.zeros_like(alpha)
            beta[n] = 1
            for e in range(len(spans) - 1, -1, -1):
                i, j = spans[e]
                beta[i] += beta[j] * prob[found[:, e]]
            weight = counts[at] / alpha[n]
            for e, (i, j) in enumerate(spans):
                got += np.bincount(found[:, e], alpha[i] * prob[found[:, e]] * beta[j] * weight, len(got))
        for w, c in long:
            got += c * lattice.long_counts(w, _log(prob))
        got[:-1] += ALPHA
        got[-1] = 0
        prob = got / got.sum()
    return prob


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """lang, text of at most ``per_lang`` documents of each language; docs (doc_id, text, lang)."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    ids = ids.withColumn("r", rank("lang", F.pmod("h", F.lit(64)))).filter(F.col("r") <= per_lang)
    ids = ids.withColumn("r", rank("lang")).filter(F.col("r") <= per_lang).select("doc_id", "lang").checkpoint()
    n = ids.count()  # at most per_lang for each language
    return usable.join(F.broadcast(ids) if n <= 64 * per_lang else ids, ["doc_id", "lang"]).select("lang", "text")


def fit(docs: DataFrame, per_lang: int = PER_LANG, vocab_path: str | None = None):
    """(languages, pieces, probabilities (pieces + 2, languages)) from training rows (doc_id, text, lang)."""
    pieces = vocabulary(vocab_path)

    def count(batches):
        from collections import Counter

        for b in batches:
            got: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in parts_of(text):
                    got.setdefault(lang, Counter()).update(words_of(part))
            for lang, c in got.items():
                it = iter(c.items())
                while part := list(islice(it, 10_000)):
                    w, n = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w)), pa.array(w), pa.array(n, pa.int64())],
                                                     names=["lang", "word", "n"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        prob = fit_language(table["word"].to_pylist(), table["n"].to_numpy().astype(float), pieces)
        return pa.table({"lang": [table["lang"][0].as_py()], "prob": pa.array([prob.tolist()], pa.list_(pa.float64()))})

    counts = (sample(docs, per_lang).mapInArrow(count, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    fitted = sorted(counts.groupBy("lang").applyInArrow(learn, "lang string, prob array<double>").collect())
    langs = [r["lang"] for r in fitted]
    return langs, pieces, np.array([r["prob"] for r in fitted]).T.reshape(len(pieces) + 2, len(langs))


class Scorer:
    """Log probabilities of words under all languages, with a bounded cache of short words."""

    def __init__(self, langs, pieces, prob):
        self.langs, self.prob, self.lattice = langs, prob, Lattice(pieces)
        self.log_prob = _log(prob)
        self.room = max(1, min(CACHE, CACHE_BYTES // (8 * max(1, len(langs)))))
        self.at: dict[str, int] = {}
        self.rows = np.empty((self.room, len(langs)))

    def learn_words(self, words) -> None:
        """Scores of new short words, at most ``room`` distinct ones in a call, into the cache."""
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if len(self.at) + len(new) > self.room:
            self.at, new = {}, list(dict.fromkeys(words))
        start = len(self.at)
        for n, at in self.lattice.by_length(new):
            spans, found = self.lattice.edges([new[i] for i in at], n)
            self.rows[np.array(at) + start] = np.log(self.lattice.forward(spans, found, n, self.prob)[n] + 1e-300)
        self.at.update(zip(new, range(start, start + len(new))))

    def total(self, words) -> np.ndarray:
        """Sum of the scores of words, long ones included."""
        out = np.zeros(len(self.langs))
        for k in range(0, len(words), self.room):
            part = [w for w in words[k:k + self.room] if len(w) <= SHORT + 1]
            self.learn_words(part)
            if part:
                out += self.rows[[self.at[w] for w in part]].sum(axis=0)
        for w in words:
            if len(w) > SHORT + 1:
                out += self.lattice.long_forward(w, self.log_prob)
        return out

    def score(self, texts):
        """(language, posterior) of each text."""
        out = []
        for slice_ in _slices(texts):
            if sum(map(len, slice_)) <= 2 * PART:  # new words of many texts at once
                lists = [words_of(t) for t in slice_]
                fresh = list(dict.fromkeys(w for ws in lists for w in ws if len(w) <= SHORT + 1))
                if len(fresh) <= self.room:
                    self.learn_words(fresh)
                sums = [self.total(ws) if ws else None for ws in lists]
            else:  # one long text, in parts
                sums, n = [np.zeros(len(self.langs))], 0
                for part in parts_of(slice_[0]):
                    words = words_of(part)
                    n += len(words)
                    sums[0] += self.total(words)
                sums = sums if n else [None]
            for total in sums:
                if total is None or not self.langs:
                    out.append(("und", 0.0))
                    continue
                post = np.exp(total - total.max())
                best = int(post.argmax())
                out.append((self.langs[best], float(post[best] / post.sum())))
        return out


def _slices(texts, most: int = PART):
    """Texts in order, in lists of about ``most`` characters; None counts as empty."""
    held, size = [], 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", per_lang: int = PER_LANG, vocab_path: str | None = None) -> DataFrame:
    """row (a struct of all columns of docs), lang_pred, score; learned from the rows of training."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = training.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                           F.col(lang_col).cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(rows, per_lang, vocab_path))

    def run(batches):
        scorer = Scorer(*model.value)
        for b in batches:
            got = scorer.score(b.column(0).field(at).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())],
                                             names=["row", "lang_pred", "score"])

    base, at = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)
    kind = base.schema["row"].dataType.simpleString()
    return base.mapInArrow(freeing(run), f"row {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 4) == 2
