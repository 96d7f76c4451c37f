"""Operator 13: spelling variants by search schemes on a bidirectional FM-index.

1. **Words.** Runs of Latin letters are counted per batch of texts in the workers and summed by Spark with
   map-side combine. Words of ``MIN_LETTERS`` code points and ``MIN_COUNT`` occurrences are the vocabulary.
2. **Routing.** Of two words that differ by one edit, one half of the shorter stands unchanged in the other:
   as its beginning or as its end. Each word asks under (its length, side, half) and can be found under
   the halves that words of its own length or one letter less would have. Keys are dealt to buckets
   whose number follows the vocabulary. A key with more than ``HOT`` words is dealt out in parts: a word
   is found in one part and asks in all.
3. **Search.** Each bucket's words, delimited and sorted, get an FM-index, and so do the reversed words
   (suffix arrays by prefix doubling, ranks by wavelet matrices). An extension to the right is a
   backward step in the reversed index, and the smaller symbols it passes over move the interval in the
   forward one (and the other way round to the left), so both suffix-rank intervals stay in step. The
   scheme matches the delimiter and one half exactly, then crosses the other half with one
   replaced or inserted code point, up to the closing delimiter; what is left is one word, whose
   rank among the delimiters is the interval in the other index. Deletions are the insertions
   seen from the longer word. All words of a bucket search in step, equal intervals once.
4. **Forms.** A bucket returns per word the number of its near words and the best one; these are combined
   per word. Roots follow forms by pointer doubling (counts double along a chain, so there are few rounds).

A pair is reported once: a match behind the right half counts only if the left halves differ. Long words
cost their length in steps, and only their half's hash is sent as a key.

Defined results: null text has no words; a null id counts as the empty string; a repeated row counts again; only the
letters A-Z change case; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.session import scratch_dir, ship_package

from .common import blocks_for

RUN = re.compile("[a-zÀ-ÿ]+")
OTHER = re.compile("[^a-zÀ-ÿ]")
MIN_LETTERS = 5
MIN_COUNT = 3
EDIT_MOD = 97
PART = 1 << 20  # characters of a text handled at a time
HELD = 200_000  # words counted in a worker before they are sent
BUCKET = 20_000  # rows (words under keys) of one bucket
HOT = 20_000
ASK = 4096  # words of a bucket that search in step


def _parts(text: str, most: int):
    """A text in parts of about ``most`` characters that end outside runs."""
    at = 0
    while len(text) - at > most:
        m = OTHER.search(text, at + most)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def corrupted(word: str, h: int, mod: int = EDIT_MOD) -> str:
    """The contract's edit: a word whose hash ``mod`` divides loses one code point."""
    return word if h % mod else word[:h % len(word)] + word[h % len(word) + 1:]


def count_words(least: int, part: int = PART, held: int = HELD):
    """(word, n) of the columns doc_id (as text) and text (bytes)."""
    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches):
        total: dict[str, int] = defaultdict(int)
        for b in batches:
            for doc, value in zip(b.column(0).to_pylist(), b.column(1)):
                start = crc32(f"{doc}:".encode())
                for piece in _parts(value.as_buffer().to_pybytes().lower().decode(), part):
                    for word, n in Counter(RUN.findall(piece)).items():
                        if len(word) >= least:
                            h = crc32(word.encode(), start)
                            if h % EDIT_MOD == 0:
                                word = corrupted(word, h)
                                if len(word) < least:
                                    continue
                            total[word] += n
                if len(total) > held:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LETTERS,
               support: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct words of at least ``least`` code points and ``support`` occurrences."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return (rows.mapInArrow(count_words(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= support))


class FM:
    """FM-index of delimited sorted words: ``codes`` holds their symbols (1 and up), ``sizes`` their lengths.
    Delimiters are symbol 0; row k of the suffix ranking, k up to the number of words, is the k-th delimiter."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, symbols: int):
        words = len(sizes)
        text = np.zeros(len(codes) + words + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[np.r_[0, np.cumsum(sizes + 1)]] = False
        text[inside] = codes
        sa = suffix_ranks(text, inside, words)
        before = np.where(sa > 0, text[sa - 1], symbols)  # nothing stands before the first delimiter
        self.rows = words + 1
        self.symbols = symbols
        self.bwt = before
        self.first = np.cumsum(np.r_[0, np.bincount(text, minlength=symbols)])
        # wavelet matrix: zeros up to each place, level by level from the top bit
        self.levels, now = [], before
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            one = now >> bit & 1
            zeros = np.concatenate([[0], np.cumsum(one == 0)])
            self.levels.append((bit, zeros, zeros[-1]))
            now = np.concatenate([now[one == 0], now[one == 1]])
        c = np.arange(symbols)
        self.begin = self._descend(np.zeros(symbols, np.int64), np.zeros(symbols, np.int64), c)[0]

    def _descend(self, lo, hi, c):
        less = np.zeros(len(lo), np.int64)
        for bit, zeros, all_zeros in self.levels:
            a, b, one = zeros[lo], zeros[hi], (c >> bit & 1).astype(bool)
            less += np.where(one, b - a, 0)
            lo, hi = np.where(one, all_zeros + lo - a, a), np.where(one, all_zeros + hi - b, b)
        return lo, hi, less

    def extend(self, lo, other, size, c):
        """Put symbol c before the pattern of rows [lo, lo + size): the new interval here, its start in the
        index of the reversed words, and its size."""
        a, b, less = self._descend(lo, lo + size, c)
        return self.first[c] + a - self.begin[c], other + less, b - a


def suffix_ranks(text: np.ndarray, inside: np.ndarray, words: int) -> np.ndarray:
    """Suffix array by prefix doubling. Delimiters rank by place, which agrees with the order of
    what follows them, as the words are sorted; so a suffix is settled at its first delimiter."""
    n = len(text)
    rank = np.where(inside, text + words, np.cumsum(~inside) - 1)
    step = 1
    while True:
        key = rank * (n + words + 2)
        key[:n - step] += rank[step:] + 1
        sa = np.argsort(key, kind="stable")
        k = key[sa]
        fresh = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[sa] = fresh
        if fresh[-1] == n - 1:
            return sa
        step *= 2


def _flat(lists) -> np.ndarray:
    """Code points of many words, one after the other."""
    return np.frombuffer("".join(lists).encode("utf-32-le"), np.uint32).astype(np.int64)


def _symbols(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Numbers from 1 by code point; letters that no indexed word has get the number after the last."""
    at = np.searchsorted(alphabet, points)
    known = alphabet[np.minimum(at, len(alphabet) - 1)] == points
    return np.where(known, at + 1, len(alphabet) + 1)


def near(fm: FM, codes: np.ndarray, start: np.ndarray, length: np.ndarray, exact: np.ndarray):
    """(query, row) pairs: delimited words that equal a query's first ``exact`` symbols and then differ by one
    replaced or inserted symbol. ``fm`` extends in the direction in which ``codes`` are read; rows
    count in the other index."""
    found_q, found_row = [], []
    q = np.arange(len(start))
    lo, other, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), fm.rows)

    def symbol(q, at):
        """The query's symbol at a place, the delimiter behind its end."""
        return np.where(at < length[q], codes[np.minimum(start[q] + at, len(codes) - 1)], 0)

    def rest(q, at, lo, other, size):
        """Match what is left exactly, with the closing delimiter."""
        while len(q):
            c = symbol(q, at)
            ok = (c < fm.symbols) & (size > 0)
            q, at, lo, other, size, c = (x[ok] for x in (q, at, lo, other, size, c))
            lo, other, size = fm.extend(lo, other, size, c)
            done = (at == length[q]) & (size > 0)
            found_q.append(q[done])
            found_row.append(other[done])
            go = (at < length[q]) & (size > 0)
            q, at, lo, other, size = q[go], at[go] + 1, lo[go], other[go], size[go]

    t = 0
    while len(q):
        here = np.full(len(q), t)
        c = symbol(q, here)
        err = np.flatnonzero(t >= exact[q])
        if len(err):
            # distinct intervals, and the symbols that can follow each
            _, one, of = np.unique(lo[err] * (len(fm.bwt) + 1) + size[err], return_index=True, return_inverse=True)
            a, b = lo[err][one], size[err][one]
            span = np.repeat(np.arange(len(a)), b)
            at = np.arange(len(span)) - np.repeat(np.cumsum(b) - b, b) + a[span]
            pair = np.unique(span * (fm.symbols + 1) + fm.bwt[at])
            node, follow = pair // (fm.symbols + 1), pair % (fm.symbols + 1)
            real = (follow > 0) & (follow < fm.symbols)
            node, follow = node[real], follow[real]
            ext = fm.extend(a[node], other[err][one][node], b[node], follow)
            begin, n = np.searchsorted(node, np.arange(len(a))), np.bincount(node, minlength=len(a))
            who = np.repeat(np.arange(len(err)), n[of])
            child = np.arange(len(who)) - np.repeat(np.cumsum(n[of]) - n[of], n[of]) + begin[of][who]
            who = err[who]
            differs = follow[child] != c[who]  # an equal symbol is inserted behind its run instead
            who, child = who[differs], child[differs]
            state = [x[child] for x in ext]
            rest(q[who], np.full(len(who), t), *state)
            inner = np.flatnonzero(t < length[q[who]])
            rest(q[who[inner]], np.full(len(inner), t + 1), *(x[inner] for x in state))
        go = np.flatnonzero((t < length[q]) & (c < fm.symbols))
        lo2, other2, size2 = fm.extend(lo[go], other[go], size[go], c[go])
        alive = size2 > 0
        q, lo, other, size = q[go][alive], lo2[alive], other2[alive], size2[alive]
        t += 1
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + found_q), np.concatenate(none + found_row)


def near_words(indexed: list[str], left: list[str], right: list[str]):
    """(side, word, near word), the near one at least as long, found behind the left half for ``left`` ("l") and
    before the right half for ``right`` ("r"). ``indexed`` are distinct words in code-point order."""
    if not indexed:
        return
    points = _flat(indexed)
    alphabet = np.unique(points)
    symbols = len(alphabet) + 1
    sizes = np.array([len(w) for w in indexed])
    turned = sorted(range(len(indexed)), key=(back := [w[::-1] for w in indexed]).__getitem__)
    forward = FM(_symbols(points, alphabet), sizes, symbols)
    backward = FM(_symbols(_flat([back[i] for i in turned]), alphabet), sizes[turned], symbols)
    for side, words, fm in (("l", left, backward), ("r", right, forward)):
        for at in range(0, len(words), ASK):
            asked = words[at:at + ASK]
            length = np.array([len(w) for w in asked])
            codes = _symbols(_flat(asked if side == "l" else [w[::-1] for w in asked]), alphabet)
            exact = length // 2 if side == "l" else length - length // 2
            q, row = near(fm, codes, np.cumsum(length) - length, length, exact)
            for i, r in zip(q.tolist(), row.tolist()):
                w = asked[i]
                if side == "l":
                    yield side, w, indexed[r]
                else:
                    v = indexed[turned[r]]
                    if not v.startswith(w[:len(w) // 2]):
                        yield side, w, v


def bucket_results(table: pa.Table) -> pa.Table:
    """Of one bucket: per word the number of near words found here, and the best (largest n, then smallest)."""
    words, n = table["word"].to_pylist(), table["n"].to_pylist()
    of = dict(zip(words, n))
    side, held, key = (table[c].to_pylist() for c in ("side", "held", "key"))
    indexed = sorted({w for w, h in zip(words, held) if h})
    asks = [sorted({w for w, s in zip(words, side) if s == x}) for x in ("l", "r")]
    asked = {(w, s): k for w, s, k in zip(words, side, key) if s}
    under = {(w, k) for w, h, k in zip(words, held, key) if h}
    best: dict[str, list] = {}

    def note(w, v):
        x = (-of[v], v)
        if w in best:
            b = best[w]
            b[0] += 1
            b[1] = min(b[1], x)
        else:
            best[w] = [1, x]

    for s, w, v in near_words(indexed, *asks):
        if (v, asked[w, s]) not in under:
            continue  # here for another half; this pair meets in the bucket where v is held under w's key
        note(w, v)
        if len(v) > len(w):  # replacements are found from both sides
            note(v, w)
    return pa.table([pa.array(list(best), pa.string()), pa.array([b[0] for b in best.values()], pa.int64()),
                     pa.array([-b[1][0] for b in best.values()], pa.int64()), pa.array([b[1][1] for b in best.values()], pa.string())],
                    names=["word", "n_near", "near_n", "near"])


def _keys(hot_above: int, vocab: DataFrame, bucket: int) -> DataFrame:
    """(bucket, key, word, n, side, held): rows that ask have a side, rows that can be found are held."""
    size = F.char_length("word")
    key = lambda q, side, half, asks: F.struct(F.xxhash64(q, F.lit(side), half).alias("key"),
                                               F.lit(side).alias("side"), F.lit(asks).alias("asks"), q.alias("q"))
    of = [key(q, side, half(q), asks) for q, asks in ((size, True), (size - 1, False))
          for side, half in (("l", lambda q: F.expr("word").substr(F.lit(1), F.floor(q / 2).cast("int"))),
                             ("r", lambda q: F.expr("word").substr(size - q + F.floor(q / 2).cast("int") + 1, size)))]
    rows = vocab.select("word", "n", F.explode(F.array(*of)).alias("k")).select("word", "n", "k.*")
    rows = rows.filter(F.col("asks") | (F.col("q") >= F.lit(1)))
    hot = (rows.groupBy("key").count().filter(F.col("count") > hot_above)
           .select("key", F.ceil(F.col("count") / hot_above).cast("int").alias("parts")))
    rows = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    part = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))
    buckets = blocks_for(4 * vocab.count(), bucket)
    return rows.select("*", own.alias("own"), part.alias("part")).select(
        F.pmod(F.xxhash64("key", "part"), F.lit(buckets)).cast("int").alias("bucket"), "key", "word", "n",
        F.when(F.col("asks"), F.col("side")).alias("side"), (F.col("own") == F.col("part")).alias("held"))


def near_counts(vocab: DataFrame, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """(word, n_near, near_n, near) for words with near words; near is the one with the largest n, then the smallest."""
    ship_package(vocab.sparkSession)
    return (_keys(hot, vocab, bucket).groupBy("bucket")
            .applyInArrow(bucket_results, "word string, n_near long, near_n long, near string")
            .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.near").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of (word, form): the last form that is reached."""
    state = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        jump = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = (state.join(jump, "root", "left")
                 .select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")).checkpoint())
        state = after.drop("moved")
        if after.filter("moved").isEmpty():
            return state


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LETTERS,
             support: int = MIN_COUNT, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    spark = docs.sparkSession
    place = scratch_dir(spark, "spelling")
    vocabulary(docs, id_col, text_col, least, support).write.parquet(f"{place}/words")
    vocab = spark.read.schema("word string, n long").parquet(f"{place}/words")
    follows = F.col("near_n") >= 2 * F.col("n")
    (vocab.join(near_counts(vocab, hot, bucket), "word", "left")
     .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("near")).alias("form"),
             F.when(follows, F.col("near_n")).alias("form_n")).write.parquet(f"{place}/forms"))
    formed = spark.read.schema("word string, n long, n_near long, form string, form_n long").parquet(f"{place}/forms")
    return (formed.join(roots(formed.filter("form IS NOT NULL")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
