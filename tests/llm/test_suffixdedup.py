import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from labelops.llm import suffixdedup as D

COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows):
    first = {}
    key = lambda d: D.NO_ID if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i:i + 50]
            first[w] = min(first.get(w, D.NO_ID + 1), key(d))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < key(d):
                gone[i:i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


def test_keys_follow_the_window():
    """Equal windows have equal keys wherever they stand."""
    rng = random.Random(1)
    w = bytes(rng.choices(range(256), k=50))
    for _ in range(5):
        a, z = (bytes(rng.choices(range(256), k=rng.randrange(90))) for _ in range(2))
        keys = D.window_keys(np.frombuffer(a + w + z, np.uint8))
        assert len(keys) == len(a + z) + 1 and keys[len(a)] == D.window_keys(np.frombuffer(w, np.uint8))[0]


def test_suffix_array_and_kasai_against_sorting():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(50, 140))) for _ in range(40)] + [b"a" * 120, b"a" * 90, b"ab" * 60]
    buf, heads, best, kinds = D.shard_minima(texts, np.arange(len(texts)))
    windows = [t[i:i + 50] for t in texts for i in range(len(t) - 49)]
    owner = [k for k, t in enumerate(texts) for i in range(len(t) - 49)]
    order = sorted(set(windows))
    assert [bytes(buf[h:h + 50]) for h in heads] == order
    assert kinds.tolist() == [order.index(w) for w in windows]
    least = {}
    for w, o in zip(windows, owner):
        least[w] = min(o, least.get(w, o))
    assert best.tolist() == [least[w] for w in order]


@pytest.mark.parametrize("shard,hot,slice_", [(D.SHARD_BYTES, D.HOT, D.SLICE_BYTES), (200, D.HOT, 3000), (200, 3, 3000)])
def test_against_brute_force(spark, monkeypatch, shard, hot, slice_):
    """Passages, copies, overlaps and periodic texts; also with tiny shards, slices and hot keys."""
    rng = random.Random(shard + hot)
    word = lambda: "".join(rng.choices("aeinrstéß", k=rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(14) for _ in range(4)]
    rows = [(None, passages[0]), (500, None), (501, ""), (502, "short"), (503, "x " * 400), (504, "x " * 300), (505, "x " * 300)]
    for d in range(90):
        parts = [text(rng.randrange(0, 25)) for _ in range(3)]
        if d % 3 == 0:
            parts.insert(rng.randrange(4), passages[0])
        if d % 7 == 0:
            parts.insert(1, passages[rng.randrange(1, 4)][:rng.randrange(40, 80)])
        rows.append((d, "\n".join(parts)))
    rows += [(600 + d, rows[20 + d][1]) for d in range(9)] + [(700 + d, rows[40 + d][1][:120] + word() + rows[40 + d][1][130:]) for d in range(9)]
    rows += [(20, rows[20][1]), (20, rows[21][1]), rows[22], (-3, rows[23][1])]
    rng.shuffle(rows)
    for name, v in (("SHARD_BYTES", shard), ("HOT", hot), ("SLICE_BYTES", slice_)):
        monkeypatch.setattr(D, name, v)
    monkeypatch.setattr(D, "ship_package", lambda s: None)
    # in this process: the same functions without the workers, which would not see the small limits
    import pyarrow as pa

    df = spark.createDataFrame(rows, "doc_id long, text string")
    if shard == D.SHARD_BYTES and hot > 100:
        assert got(D.substring_dedup(df, bucket_bytes=4000)) == brute(rows)
    buckets = 5
    rid = list(range(len(rows)))
    batch = pa.RecordBatch.from_arrays([pa.array(rid), pa.array([d for d, _ in rows], pa.int64()),
                                        pa.array([(t or "").encode() for _, t in rows])], names=["rid", "doc_id", "text"])

    def grouped(batches, f):
        by = {}
        for t in batches:
            t = pa.table(t) if isinstance(t, pa.RecordBatch) else t
            for k in range(t.num_rows):
                by.setdefault(t["bucket"][k].as_py(), []).append(t.slice(k, 1))
        return [f(pa.concat_tables(x)) for x in by.values()]

    runs = {}
    for t in grouped(D.entries(buckets)([batch]), D.shared_runs):
        for r in t.to_pylist():
            runs.setdefault(r["rid"], []).append(r)
    some = [k for k in rid if k in runs]
    second = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)),
                                         batch.column(2).take(pa.array(some)), pa.array([runs[k] for k in some])],
                                        names=["rid", "doc_id", "text", "runs"])
    spans = {}
    for t in grouped(D.piece_texts(buckets)([second]), D.removed_windows):
        for r in t.to_pylist():
            spans.setdefault(r["rid"], []).append(r)
    last = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([spans.get(k) for k in rid]),
                                       pa.array([None] * len(rid), pa.bool_())], names=["doc_id", "text", "spans", "whole"])
    out = pa.Table.from_batches(list(D.finish(False)([last]))).to_pylist()
    assert Counter(tuple(r[c] for c in COLS) for r in out) == brute(rows)


def test_documents_against_brute_force(docs, rows):
    pairs = [(r["doc_id"], r["text"]) for r in rows]
    assert got(D.substring_dedup(docs)) == brute(pairs)
    assert got(D.substring_dedup(docs, keep_text=False, bucket_bytes=20_000)) == brute(pairs)


def test_empty(empty):
    assert D.substring_dedup(empty).collect() == []
