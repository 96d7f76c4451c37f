"""Operator 5: token counts by a linear longest-match automaton.

Greedy word-piece length of a word: take the longest vocabulary piece that starts the rest, again
and again. The vocabulary is a public byte-level one whose pieces either stand inside a word or end
it, so a word is its bytes followed by an end symbol. The automaton is the vocabulary's trie; every
node has a failure link (the node that spells what is left after the greedy pieces of its string are
taken off) and the number of pieces taken off. One pass over the word adds these numbers up: no
piece is ever built and no byte is read twice.

Words are runs of characters other than ASCII white space, in lower case. Every byte is a piece in
both forms, so nothing is unknown. Where the longest match takes the whole rest in its inner form,
the end symbol is left alone; it counts nothing.

Defined results: null, empty and blank text has no words and no tokens; words of any length take
linear time; repeated rows each come back; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.session import ship_package

END = 256
ENDING = "</w>"
CACHE = 500_000


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str | None = None) -> list[tuple[int, ...]]:
    """Vocabulary as symbol tuples: bytes, then END for pieces that end a word."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    alphabet, out = byte_alphabet(), []
    with open(path, encoding="utf-8") as f:
        for piece in json.load(f)["model"]["vocab"]:
            body = piece.removesuffix(ENDING)
            if body and all(c in alphabet for c in body):
                out.append(tuple(alphabet[c] for c in body) + (END,) * piece.endswith(ENDING))
    return out


class Automaton:
    """Trie as dictionaries, with failure links and popped counts; node 0 is the root."""

    def __init__(self, vocabulary):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for p in (*vocabulary, (END,)):
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                at = to
            whole[at] = True
        self.fail, self.pops = [-1] * len(whole), [0] * len(whole)
        queue = [0]
        for v in queue:  # breadth first: a node's shorter strings are ready before it
            for c, to in self.next[v].items():
                queue.append(to)
                if whole[to]:
                    self.fail[to], self.pops[to] = 0, int((v, c) != (0, END))
                    continue
                at, popped = self.fail[v], self.pops[v]
                while at >= 0 and c not in self.next[at]:
                    popped, at = popped + self.pops[at], self.fail[at]
                if at >= 0:
                    self.fail[to], self.pops[to] = self.next[at][c], popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of the word; -1 if it cannot be spelled."""
        at = n = 0
        for c in (*word, END):
            while c not in self.next[at]:
                n, at = n + self.pops[at], self.fail[at]
                if at < 0:
                    return -1
            at = self.next[at][c]
        return n + self.pops[at]  # only whole pieces end in the end symbol


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every row."""
    ship_package(docs.sparkSession)

    def run(batches):
        machine, cache = Automaton(pieces(vocab_path)), {}
        for b in batches:
            size, words, tokens = [], [], []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                ws = (t or "").lower().encode().split()
                total = 0
                for w in ws:
                    n = cache.get(w)
                    if n is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        n = cache[w] = machine.count(w)
                    total += n
                size.append(len(raw))
                words.append(len(ws))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.array(x, np.int64)) for x in (size, words, tokens))],
                                             names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
