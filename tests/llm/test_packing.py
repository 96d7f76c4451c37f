import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelops.llm import packing as P


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(out, docs, tok, capacity=P.CAPACITY):
    """Round trip: pieces spell every document once; sequences are gapless and full or a power of two."""
    want = Counter()
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [P.END_ID]
        at = 0
        for n in P.cut(len(ids), capacity):
            want[d, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
    return seqs


@pytest.mark.parametrize("per_block", [3, 20_000])
def test_round_trip(docs, rows, tok, per_block):
    out = P.pack(docs, per_block=per_block).collect()
    seqs = check(out, [(r["doc_id"], r["text"]) for r in rows], tok)
    if per_block > 1000:  # nearly all sequences are full
        assert sum(sum(n for _, n in s) == P.CAPACITY for s in seqs.values()) >= 0.5 * len(seqs)


def test_special_strings_and_odd_space_are_ordinary_text(spark):
    text = "a <|endoftext|> b\x1cc d　é ́x it's 12 #!"
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    check(P.pack(df).collect(), [(1, text), (2, None)], plain)


def test_empty(empty):
    assert P.pack(empty).collect() == []


def test_words_spell_whole_texts():
    import random

    bits = ["a", "B", "Z", "h", "H", "I", "'", ",", ".", "!", " ", "\n", "̱", "́", "̇", "İ", "ß", "漢", "Σ", "é",
            "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "1", "\x1c", "　", "don't", "'S", "</w>"]
    pick = random.Random(3)
    texts = ["".join(pick.choices(bits, k=pick.randint(0, 14))) for _ in range(3000)]
    words = P.WordTokenizer()
    for text, got in zip(texts, words.ids(texts)):
        want = words.plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)


def test_added_tokens_of_the_vocabulary(spark, tok, tmp_path):
    """The registered query and the pipeline give the ids of the unmodified tokenizer."""
    import corpus_pipeline
    from labelops.llm.queries import op7_packing

    texts = ["a <|endoftext|> b", "A<|startoftext|>b.<|endoftext|>", "a <|ENDOFTEXT|> b <|", "it's 12 #! plain", None, "<|endoftext|>",
             "é\u0301 İ\x1cc <|endoftext|>\u3000x"]
    assert tok.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op7_packing(spark, str(tmp_path)).collect(), docs, tok)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    check(corpus_pipeline.pack(spark, df, str(tmp_path)).collect(), docs, tok)
