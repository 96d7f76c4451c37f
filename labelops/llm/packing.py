"""Operator 7: harmonic packing of tokenized documents into sequences of at most 4096 tokens.

Lengths fall into reciprocal-capacity classes: class k holds pieces that fill exactly 1/k of a
sequence (k = 1, 2, 4, ... 4096), and a bin of class k takes exactly k pieces. A document is cut so
that every piece has such a length: whole sequences first, then the binary digits of the rest. So a
full bin has no padding. Bins are filled independently in each block of pieces (a hash of id, place
and content, so rows without an id spread like others), so there is no global order and no worker waits for another; what is left of a class at the end
of a block goes into bins of 2048, 1024, ... pieces' worth, powers of two again, which need no
padding either.

Tokenizing is done once per distinct word and worker (bounded cache): the tokenizer's rules never
look across white space. Only piece descriptions are shuffled, never texts or ids. The number of
blocks follows from the number of rows, so that a block stays small at any size.

With ``added_tokens`` (the registered query and the pipeline) the ids are those of the vocabulary's own
tokenizer: strings of its added tokens become those tokens. Texts that hold one are encoded whole.
Without it, ``pack`` takes such strings as ordinary text.

Defined results: null and empty text is the end id alone; repeated rows are packed each; rows with
a null id are packed like others; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import ship_package

from .common import blocks_for, freeing

CAPACITY = 4096
END_ID = 2
CACHE = 250_000  # words in each half of a worker's cache
MARKS = b",.;:!?"
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# The splitting rules of the vocabulary under which a word of letters is one item.
LETTER_RULE = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _byte_alphabet() -> dict[int, str]:
    """Character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}


BYTE_ALPHABET = _byte_alphabet()


class Cache(dict):
    """ids of words, computed when missing; two halves, of which the older one only gives words back."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        self[word] = ids = self.compute(word) if ids is None else ids
        return ids

    def turn(self) -> None:
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()


class WordTokenizer:
    """ids of texts as little-endian uint32 bytes, word by word through a bounded cache.

    The vocabulary's rules lower-case, split at white space and split a letter from the mark after
    it. So A-Z are lower-cased first (not where combining marks stand, which NFC joins by case),
    and marks at a word's end are words of their own. A word of letters alone is one item of the
    vocabulary's splitting rule (``LETTER_RULE``), so it goes to the merge model at once, in the
    model's byte alphabet; other words pass the whole tokenizer."""

    def __init__(self, path: str | None = None, added_tokens: bool = False):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.path, self.joint = path, Tokenizer.from_file(path)
        self.model, self.normalizer = self.joint.model, self.joint.normalizer
        rules = json.loads(self.joint.to_str())["pre_tokenizer"] or {}
        self.letter_rule = rules.get("pretokenizers") == LETTER_RULE
        self.seen = Cache(self.word_ids)
        self.added = list(self.joint.get_added_tokens_decoder().values()) if added_tokens else []

    @cached_property
    def plain(self):
        """The same tokenizer, for which special strings in a text are ordinary text."""
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(self.path)
        plain.encode_special_tokens = True
        return plain

    def holds_added(self, text: str) -> bool:
        """Whether a text holds the string of an added token, in the form the tokenizer looks for it."""
        norm = self.normalizer
        return any(a.content in (norm.normalize_str(text) if a.normalized and norm else text) for a in self.added)

    def word_ids(self, word: bytes) -> bytes:
        """ids of one word, its parts by the cache."""
        if word[-1] in MARKS and (n := _body(word)) < len(word):
            return self.seen[word[:n]] + self.seen[word[n:]]
        text = word.decode()
        if self.letter_rule and text.isalpha():
            # the rules' own form; on letters of Latin-1 it is lower case
            text = text.lower() if LATIN.fullmatch(text) else self.normalizer.normalize_str(text)
            if text.isascii():
                return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if text.isalpha():
                text = text.encode().decode("latin-1").translate(BYTE_ALPHABET)
                return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return np.array(self.plain.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts) -> list[bytes]:
        whole = {k: np.array(self.joint.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                 for k, t in enumerate(texts) if self.added and t and self.holds_added(t)}
        self.seen.turn()
        return [whole[k] if k in whole else self.by_word(t or "") for k, t in enumerate(texts)]

    def by_word(self, text: str) -> bytes:
        raw = text.encode()
        words = (raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()
        return b"".join(map(self.seen.__getitem__, words))


def _body(word: bytes) -> int:
    """Length of a word without the marks at its end, if a letter of a-z or of Latin-1 stands before them."""
    n = len(word.rstrip(MARKS))
    if n and 97 <= word[n - 1] <= 122:
        return n
    latin = n > 1 and word[n - 2] == 0xC3 and 0x80 <= word[n - 1] <= 0xBF and word[n - 1] not in (0x97, 0xB7)
    return n if latin else len(word)


#: one tokenizer and cache per vocabulary and Python worker; they outlive a task where workers are reused
_TOKENIZERS: dict[tuple[str | None, bool], WordTokenizer] = {}


def tokenizer(path: str | None, added_tokens: bool = False) -> WordTokenizer:
    if (path, added_tokens) not in _TOKENIZERS:
        _TOKENIZERS[path, added_tokens] = WordTokenizer(path, added_tokens)
    return _TOKENIZERS[path, added_tokens]


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of n ids: whole sequences, then the binary digits of the rest."""
    whole, rest = divmod(n, capacity)
    return [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None,
           end_id: int = END_ID, capacity: int = CAPACITY, added_tokens: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: one row per piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        from labelops.llm import packing

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = packing.tokenizer(vocab_path, added_tokens)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(ids), 256):
                out = []
                for doc, raw in zip(ids[k:k + 256], tok.ids(texts[k:k + 256])):
                    raw += end
                    n, at = len(raw) // 4, 0
                    for length in cut(n, capacity):
                        out.append((doc, at, length, crc32(raw[4 * at:4 * (at + length)]), n))
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(freeing(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None,
         end_id: int = END_ID, capacity: int = CAPACITY, per_block: int = 20_000, added_tokens: bool = False) -> DataFrame:
    """The pieces with their sequence_id and offset. ``capacity`` is a power of two."""
    ship_package(docs.sparkSession)
    blocks = blocks_for(docs.count(), per_block)
    rows = pieces(docs, id_col, text_col, vocab_path, end_id, capacity, added_tokens)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "doc_tokens", "start", "ids_crc32"), F.lit(blocks)))
    group = Window.partitionBy("block", "length")
    rows = rows.withColumn("n", F.count("*").over(group)).withColumn(
        "i", F.row_number().over(group.orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    k = (F.lit(capacity) / F.col("length")).cast("long")
    rows = rows.select("*", F.floor(F.col("i") / k).alias("bin"), (F.col("i") % k).alias("p"),
                       F.when(F.col("i") < F.col("n") - F.col("n") % k, F.lit(0)).otherwise(F.col("n") % k).alias("left"))
    # in the last bin, `left` pieces: p lies in the group of 2^h pieces, h the top bit in which p and left differ
    h = F.length(F.bin(F.col("p").bitwiseXOR(F.col("left")))) - 1
    base = F.expr("shiftleft(shiftright(left, h + 1), h + 1)")
    rows = rows.withColumn("h", F.when(F.col("left") > 0, h)).withColumn("base", F.when(F.col("left") > 0, base).otherwise(0))
    log = F.length(F.bin("length"))  # 1 to 13: the class
    seq = (F.col("block") * 16 + log) * F.lit(2**36) + F.col("bin") * 16 + F.coalesce("h", F.lit(15))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", seq.cast("long").alias("sequence_id"),
                       ((F.col("p") - F.col("base")) * F.col("length")).cast("long").alias("offset"))
