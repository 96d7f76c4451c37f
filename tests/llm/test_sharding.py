import zlib
from collections import Counter, defaultdict

from labelops.llm.sharding import shard_rows


def jump(key, n):
    """The published loop, on unsigned 64-bit keys."""
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_against_published_loop(docs, rows):
    out = shard_rows(docs, per_block=7).collect()
    want = Counter()
    for r in rows:
        text = (r["text"] or "").encode()
        key = r["doc_id"] or 0
        want[r["doc_id"], len(text) + 1, zlib.crc32(text), jump(key, 8), jump(key, 9)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out) == want
    assert {r["law"] for r in out} == {"key"}
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["grown_shard"] in (r["shard"], 8) for r in out)


def test_empty(empty):
    assert shard_rows(empty).collect() == []


def test_one_id_spreads_over_buckets(spark):
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"text {k}") for k in range(300)]
    out = shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), per_block=4)
    got = out.collect()
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == 300
