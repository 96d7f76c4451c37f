"""Operator 6: removal of repeated 50-byte strings with suffix arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id.

1. **Routing keys.** Every 50-byte window has a key: the smallest 64-bit hash of the 20-byte strings
   in it. Equal windows have equal keys, always; neighbouring windows mostly share one, so a
   document is a sequence of runs (key, first window, number of windows), one per about 16 bytes.
   Runs go to hash buckets by key, packed as arrays. A bucket keeps the runs whose key stands in two
   documents or more; no window outside these can occur in another document. They return
   packed by block of documents, where each document gets its runs in one row.
2. **Suffix arrays per shard.** The text of the remaining runs (their windows plus 49 bytes) meets
   by key. A bucket is cut at key boundaries into shards of bounded size. Each shard gets a suffix
   array by Larsson-Sadakane refinement (8, 16, 32, 50 bytes; only unsettled groups are sorted
   again) and common prefixes by Kasai's walk, run for all its texts in step. Neighbours with a
   common prefix of 50 bytes are equal windows; each class keeps its smallest id.
3. **Merging.** If one key's texts need several shards, the sorted distinct windows of these shards
   are searched in each other by binary search and the smallest ids are combined.
4. Removed windows go back to their document and are united into spans.

A document whose whole text a smaller id has (found by a map-side combined aggregate over text
hashes) loses all of it and takes no part in the steps; the smallest id of the text stands for it.
Equal run texts inside one Arrow slice are sent once. A key with more than ``HOT`` runs (a passage
shared by much of the corpus has few such keys, but many different surroundings) is not gathered:
each of its windows is routed by its own hash, and equal windows of a slice are sent once, so the
load spreads whatever the passage. Bucket numbers follow from the corpus size.

Defined results: null text is empty; matches are between different ids only, so repeated rows of one
id never remove each other; a null id counts as larger than any other; texts under 50 bytes lose
nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.session import ship_package

SPAN = 50
GRAM = 20
BUCKET_BYTES = 32 << 20  # of corpus text for one bucket
SLICE_BYTES = 2 << 20  # of text handled at a time in a task
SHARD_BYTES = 3 << 19  # of text under one suffix array
HOT = 50_000
NO_ID = 2**63 - 1
LONGEST = 255  # windows in one run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_keys(buf: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """Key of the window at each byte: the least hash of its ``gram``-byte strings."""
    have = {1: buf.astype(np.uint64) + np.uint64(1)}
    size, power = 1, {2**k: np.uint64(pow(0x100000001B3, 2**k, 2**64)) for k in range(gram.bit_length())}
    while size * 2 <= gram:  # hashes of doubled lengths
        h = have[size]
        have[size * 2] = h[:-size] * power[size] + h[size:]
        size *= 2
    h, done = have[size], size
    for s in sorted(have, reverse=True):
        while done + s <= gram:
            m = len(buf) - done - s + 1
            h, done = h[:m] * power[s] + have[s][done:done + m], done + s
    h, width, wide = _mix(h), span - gram + 1, 1
    while wide * 2 <= width:
        h, wide = np.minimum(h[:-wide], h[wide:]), wide * 2
    return np.minimum(h[:len(h) - (width - wide)], h[width - wide:]) if width > wide else h


def runs(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(document number, first window, number of windows, key) of each run, document by document."""
    windows = np.maximum(sizes - SPAN + 1, 0)
    if len(buf) < SPAN or not windows.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    keys = window_keys(buf)
    inside = np.zeros(len(keys) + 1, np.int8)  # windows that cross a document's end are outside
    some = windows > 0
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, starts[some] + windows[some], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    fresh[starts[some]] = True
    edge = np.flatnonzero(fresh | ~inside)
    first = edge[inside[edge]]
    n = np.append(edge, len(keys))[np.searchsorted(edge, first) + 1] - first
    parts = -(-n // LONGEST)
    if (parts > 1).any():  # long runs (periodic text) in pieces
        of = np.repeat(np.arange(len(n)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = first[of] + k * LONGEST, np.minimum(LONGEST, n[of] - k * LONGEST)
    doc = np.searchsorted(starts, first, side="right") - 1
    # empty documents share their start with the next one; the last of them is the one with text
    return doc, first - starts[doc], n, keys[first]


def _slices(sizes, most: int = SLICE_BYTES):
    """Consecutive row ranges of at most ``most`` bytes (or one row)."""
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= most:
            total, end = total + sizes[end], end + 1
        yield at, end
        at = end


def _bytes(col) -> list[bytes]:
    return [b or b"" for b in col.to_pylist()]


def _route(keys: np.ndarray, buckets: int):
    """Bucket of a key, and the 32 other bits that tell keys apart inside a bucket."""
    return (keys >> np.uint64(40)) % np.uint64(buckets), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


ENTRY = "bucket int, rids binary, ids binary, counts binary, keys binary, starts binary, sizes binary"


def entries(buckets: int):
    """Runs of all documents, packed by bucket: one row per slice of documents and bucket."""
    def run(batches):
        for b in batches:
            rid = b.column(0).to_numpy()
            ids = b.column(1).fill_null(NO_ID).to_numpy()
            texts = _bytes(b.column(2))
            for lo, hi in _slices([len(t) for t in texts]):
                sizes = np.array([len(t) for t in texts[lo:hi]])
                buf = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
                doc, first, n, key = runs(buf, np.cumsum(sizes) - sizes, sizes)
                to, small = _route(key, buckets)
                order = np.argsort(to.astype(np.uint16) if buckets < 1 << 16 else to, kind="stable")
                doc, first, n, small, to = doc[order], first[order], n[order], small[order], to[order]
                used, at = np.unique(to, return_index=True)
                out = []
                for k, s, e in zip(used, at, [*at[1:], len(to)]):
                    d, c = np.unique(doc[s:e], return_counts=True)
                    out.append((int(k), rid[lo:hi][d].tobytes(), ids[lo:hi][d].tobytes(), c.astype(np.uint32).tobytes(),
                                small[s:e].tobytes(), first[s:e].astype(np.uint32).tobytes(), n[s:e].astype(np.uint8).tobytes()))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                                     names=["bucket", "rids", "ids", "counts", "keys", "starts", "sizes"])

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(_bytes(table[name])), kind)


def shared_runs(table: pa.Table) -> pa.Table:
    """Of one bucket, the runs whose key stands in several documents, packed by document."""
    counts = _joined(table, "counts", np.uint32)
    rid, doc = (np.repeat(_joined(table, n, np.int64), counts) for n in ("rids", "ids"))
    keys, starts, sizes = _joined(table, "keys", np.uint32), _joined(table, "starts", np.uint32), _joined(table, "sizes", np.uint8)
    order = np.argsort(keys, kind="stable")
    sorted_keys, sorted_doc = keys[order], doc[order]
    at = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    size = np.diff(np.r_[at, len(keys)])
    several = np.minimum.reduceat(sorted_doc, at) < np.maximum.reduceat(sorted_doc, at)
    keep, hot = np.repeat(several, size), np.repeat(size > HOT, size)
    order, hot = order[keep], hot[keep]
    by = np.lexsort((starts[order], rid[order]))
    order, hot = order[by], hot[by]
    r, at = np.unique(rid[order], return_index=True)
    cut = [(s, e) for s, e in zip(at, [*at[1:], len(order)])]
    pack = lambda a: pa.array([a[s:e].tobytes() for s, e in cut], pa.binary())
    bucket = table["bucket"][0].as_py()
    return pa.table({"rid": pa.array(r, pa.int64()), "bucket": pa.array([bucket] * len(r), pa.int32()), "keys": pack(keys[order]),
                     "starts": pack(starts[order]), "sizes": pack(sizes[order]), "hot": pack(hot)})


BLOCK = "block int, bucket int, rids binary, counts binary, keys binary, starts binary, sizes binary, hot binary"


def shared_by_block(blocks: int):
    """``shared_runs`` of one bucket, packed by block of documents: the number of rows follows the
    number of buckets and blocks, not documents times buckets."""
    def run(table: pa.Table) -> pa.Table:
        t = shared_runs(table)
        rid = t["rid"].to_numpy()
        block = _block_of(rid, blocks)
        order = np.argsort(block, kind="stable")
        used, at = np.unique(block[order], return_index=True)
        cut = list(zip(at, [*at[1:], len(order)]))
        packed = [_bytes(t[name].take(pa.array(order))) for name in ("keys", "starts", "sizes", "hot")]
        counts = np.array([len(x) for x in packed[2]], np.uint32)
        flat = [pa.array(x, pa.binary()) for x in (
            [rid[order[s:e]].tobytes() for s, e in cut], [counts[s:e].tobytes() for s, e in cut],
            *([b"".join(x[s:e]) for s, e in cut] for x in packed))]
        bucket = table["bucket"][0].as_py()
        return pa.table([pa.array(used.astype(np.int32)), pa.array([bucket] * len(cut), pa.int32()), *flat],
                        names=["block", "bucket", "rids", "counts", "keys", "starts", "sizes", "hot"])

    return run


RUNS = "rid long, runs array<struct<bucket: int, keys: binary, starts: binary, sizes: binary, hot: binary>>"


def by_document(table: pa.Table) -> pa.Table:
    """Of one block of documents, the shared runs of each document in one row."""
    counts, rid = _joined(table, "counts", np.uint32).astype(np.int64), _joined(table, "rids", np.int64)
    docs = [len(b) // 8 for b in _bytes(table["rids"])]
    end = np.cumsum(counts)
    order = np.argsort(rid, kind="stable")
    at = np.flatnonzero(np.r_[True, rid[order][1:] != rid[order][:-1]])
    cut = [(int(end[k] - counts[k]), int(end[k])) for k in order]
    columns = [pa.array(np.repeat(table["bucket"].to_numpy(), docs)[order], pa.int32())]
    for name, width in (("keys", 4), ("starts", 4), ("sizes", 1), ("hot", 1)):
        blob = b"".join(_bytes(table[name]))
        columns.append(pa.array([blob[width * s:width * e] for s, e in cut], pa.binary()))
    runs_ = pa.StructArray.from_arrays(columns, names=["bucket", "keys", "starts", "sizes", "hot"])
    lists = pa.ListArray.from_arrays(pa.array([*at, len(order)], pa.int32()), runs_)
    return pa.table({"rid": pa.array(rid[order][at], pa.int64()), "runs": lists})


PIECE = "bucket int, keys binary, lengths binary, bytes binary, which binary, rids binary, ids binary, starts binary"


def piece_texts(buckets: int):
    """Texts of the shared runs by bucket; equal texts of a slice are sent once, with all their places."""
    def run(batches):
        for b in batches:
            rid, texts = b.column(0).to_pylist(), _bytes(b.column(2))
            ids = b.column(1).fill_null(NO_ID).to_pylist()
            lists = b.column(3).to_pylist()
            for lo, hi in _slices([len(t) for t in texts]):
                got: dict[int, dict] = {}
                for r, d, text, groups in zip(rid[lo:hi], ids[lo:hi], texts[lo:hi], lists[lo:hi]):
                    for g in groups:
                        four = (np.frombuffer(g[n], t).tolist() for n, t in
                                (("keys", np.uint32), ("starts", np.uint32), ("sizes", np.uint8), ("hot", bool)))
                        for key, start, n, hot in zip(*four):
                            if hot:  # window by window, each where its own hash sends it
                                for at in range(start, start + n):
                                    w = text[at:at + SPAN]
                                    x = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                                    _add(got, (x >> 32) % buckets, x & 0xFFFFFFFF, w, r, d, at)
                            else:
                                _add(got, g["bucket"], key, text[start:start + n + SPAN - 1], r, d, start)
                if got:
                    yield _packed(got)

    return run


def _add(got, bucket, key, text, rid, doc, start):
    x = got.setdefault(bucket, {"of": {}, "places": []})
    k = x["of"].setdefault((key, text), len(x["of"]))
    x["places"].append((k, rid, doc, start))


def _packed(got) -> pa.RecordBatch:
    rows = []
    for bucket, x in got.items():
        keys, texts = zip(*x["of"])
        which, rids, ids, starts = zip(*x["places"])
        rows.append((bucket, np.array(keys, np.uint32).tobytes(), np.array([len(t) for t in texts], np.uint32).tobytes(),
                     b"".join(texts), np.array(which, np.uint32).tobytes(), np.array(rids, np.int64).tobytes(),
                     np.array(ids, np.int64).tobytes(), np.array(starts, np.uint32).tobytes()))
    cols = list(zip(*rows))
    names = ["bucket", "keys", "lengths", "bytes", "which", "rids", "ids", "starts"]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number, zeros after the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    out = np.zeros(len(buf), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i:i + len(buf)]
    return out


def suffix_array(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows that start at ``at`` in sorted order, by Larsson-Sadakane refinement to 50 bytes.
    ``key`` has the eight bytes at each position."""
    n = len(key)
    sa = np.argsort(key)
    rank = np.zeros(n + 2 * SPAN, np.int64)

    def settle(order, key, slots):
        """Ranks of one sorted part: every group takes the slot of its first member. Gives the open slots."""
        new = np.r_[True, key[1:] != key[:-1]]
        rank[order] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.r_[new[1:], True]
        return slots[~alone]

    slots = settle(sa, key[sa], np.arange(n))
    for step in (8, 16, SPAN - 32):  # 16, 32, then 50 bytes from two overlapping 32-byte ranks
        if not len(slots):
            break
        part = sa[slots]
        key = rank[part] * (n + 1) + rank[part + step] + (part + step < n)
        by = np.argsort(key, kind="stable")
        sa[slots] = part[by]
        slots = settle(part[by], key[by], slots)
    wanted = np.zeros(n, bool)
    wanted[at] = True
    return sa[wanted[sa]]


def kasai(buf: np.ndarray, key: np.ndarray, sa: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Common prefix (up to 50) of each window with its predecessor in ``sa``; zero for the first.

    Kasai's walk: going one byte on, the common prefix shrinks by one at most. All texts (first
    window, number of windows) take the walk in step, one offset at a time. The rule needs the
    predecessor's next window to be in the array and the two windows to differ; else the walk
    starts again from zero. Prefixes grow by eight bytes, then by single ones."""
    window = np.zeros(len(buf) + 1, bool)
    window[sa] = True
    before = np.full(len(buf) + 1, -1)
    before[sa[1:]] = sa[:-1]
    place = np.zeros(len(buf) + 1, np.int64)
    place[sa] = np.arange(len(sa))
    out = np.zeros(len(sa), np.int64)
    h, last = np.zeros(len(first), np.int64), np.full(len(first), -1)
    for t in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > t)
        p = first[live] + t
        q, old = before[p], h[live]
        x = np.where((old > 0) & (old < SPAN) & window[last[live] + 1] & (last[live] >= 0), old - 1, 0)
        x[q < 0] = 0
        for width, same in ((8, key), (1, buf)):
            grow = np.flatnonzero((q >= 0) & (x + width <= SPAN))
            while len(grow):
                grow = grow[same[p[grow] + x[grow]] == same[q[grow] + x[grow]]]
                x[grow] += width
                grow = grow[x[grow] + width <= SPAN]
        h[live], last[live] = x, q
        out[place[p]] = x
    return out


def shard_minima(texts: list[bytes], least: np.ndarray):
    """Of one shard: sorted distinct windows (start of one of each), smallest id of each, class of every
    window (text by text). ``least`` is the smallest id that has the text."""
    size = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    first, n = np.cumsum(size) - size, size - SPAN + 1
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    key = words8(buf)
    sa = suffix_array(key, at)
    head = kasai(buf, key, sa, first, n) < SPAN
    kind = np.cumsum(head) - 1
    who = np.zeros(len(buf), np.int64)
    who[at] = least[owner]
    best = np.minimum.reduceat(who[sa], np.flatnonzero(head))
    kinds = np.zeros(len(buf), np.int64)
    kinds[sa] = kind
    return buf, sa[head], best, kinds[at]


def merge(shards) -> None:
    """Combine the smallest ids of windows that several shards hold, by binary search among their sorted windows."""
    view = [np.lib.stride_tricks.sliding_window_view(buf, SPAN)[heads].copy().view(f"S{SPAN}").ravel() for buf, heads, _, _ in shards]
    for i in range(len(shards)):
        for j in range(i):
            at = np.minimum(np.searchsorted(view[j], view[i]), len(view[j]) - 1)
            same = np.flatnonzero(view[j][at] == view[i])
            best_i, best_j = shards[i][2], shards[j][2]
            low = np.minimum(best_i[same], best_j[at[same]])
            best_i[same], best_j[at[same]] = low, low


def removed_windows(table: pa.Table) -> pa.Table:
    """Of one bucket, the windows that go, as byte spans packed by document."""
    keys, lengths = _joined(table, "keys", np.uint32), _joined(table, "lengths", np.uint32)
    n_texts = np.array([len(b) // 4 for b in _bytes(table["keys"])])
    places = np.array([len(b) // 4 for b in _bytes(table["which"])])
    which = _joined(table, "which", np.uint32) + np.repeat(np.cumsum(n_texts) - n_texts, places)
    rids, ids, starts = _joined(table, "rids", np.int64), _joined(table, "ids", np.int64), _joined(table, "starts", np.uint32)
    blob, end = b"".join(_bytes(table["bytes"])), np.cumsum(lengths, dtype=np.int64)
    # equal texts of different slices become one
    index: dict[tuple[int, bytes], int] = {}
    same = np.array([index.setdefault((k, blob[e - n:e]), len(index)) for k, n, e in zip(keys.tolist(), lengths.tolist(), end.tolist())])
    del blob
    which = same[which]
    least = np.full(len(index), NO_ID)
    np.minimum.at(least, which, ids)
    out_rid, out_from, out_to = [], [], []
    ahead = ids > least[which]  # the whole text stands in a smaller document
    size = np.array([len(t) for _, t in index])
    out_rid.append(rids[ahead])
    out_from.append(starts[ahead].astype(np.int64))
    out_to.append(out_from[0] + size[which[ahead]])
    # places of the smallest documents: window by window
    own = np.flatnonzero(~ahead)
    own = own[np.argsort(which[own], kind="stable")]
    of_text = np.searchsorted(which[own], np.arange(len(index) + 1))
    order = sorted(range(len(index)), key=(items := [k for k, _ in index]).__getitem__)
    texts = [t for _, t in index]
    for shards in _shards(order, items, texts):
        results = [shard_minima([texts[i] for i in part], least[part]) for part in shards]
        if len(results) > 1:
            merge(results)
        for part, (_, _, best, kinds) in zip(shards, results):
            low, at = best[kinds], 0
            for i in part:
                n = len(texts[i]) - SPAN + 1
                gone = np.flatnonzero(low[at:at + n] < least[i])
                at += n
                if len(gone):
                    cut = np.flatnonzero(np.diff(gone) > SPAN)
                    s, e = gone[np.r_[0, cut + 1]], gone[np.r_[cut, len(gone) - 1]] + SPAN
                    for p in own[of_text[i]:of_text[i + 1]]:
                        out_rid.append(np.full(len(s), rids[p]))
                        out_from.append(s + int(starts[p]))
                        out_to.append(e + int(starts[p]))
    rid, a, z = map(np.concatenate, (out_rid, out_from, out_to))
    order = np.lexsort((a, rid))
    rid, a, z = rid[order], a[order], z[order]
    r, at = np.unique(rid, return_index=True)
    cut = list(zip(at, [*at[1:], len(rid)]))
    pack = lambda x: pa.array([x[s:e].astype(np.uint32).tobytes() for s, e in cut], pa.binary())
    return pa.table({"rid": pa.array(r, pa.int64()), "from": pack(a), "to": pack(z)})


GONE = "block int, rids binary, counts binary, from binary, to binary"


def _block_of(rid: np.ndarray, blocks: int) -> np.ndarray:
    return (rid.view(np.uint64) >> np.uint64(20)) % np.uint64(blocks)


def removed_by_block(blocks: int):
    """``removed_windows`` of one bucket, packed by block of documents, as ``shared_by_block`` packs runs."""
    def run(table: pa.Table) -> pa.Table:
        t = removed_windows(table)
        rid = t["rid"].to_numpy()
        block = _block_of(rid, blocks)
        order = np.argsort(block, kind="stable")
        used, at = np.unique(block[order], return_index=True)
        cut = list(zip(at, [*at[1:], len(order)]))
        a, z = (_bytes(t[name].take(pa.array(order))) for name in ("from", "to"))
        counts = np.array([len(x) // 4 for x in a], np.uint32)
        flat = [[rid[order[s:e]].tobytes() for s, e in cut], [counts[s:e].tobytes() for s, e in cut],
                [b"".join(a[s:e]) for s, e in cut], [b"".join(z[s:e]) for s, e in cut]]
        return pa.table([pa.array(used.astype(np.int32)), *(pa.array(x, pa.binary()) for x in flat)],
                        names=["block", "rids", "counts", "from", "to"])

    return run


def gone_by_document(table: pa.Table) -> pa.Table:
    """Of one block, the spans that each document loses, in one row."""
    rid = np.repeat(_joined(table, "rids", np.int64), _joined(table, "counts", np.uint32))
    a, z = _joined(table, "from", np.uint32), _joined(table, "to", np.uint32)
    order = np.argsort(rid, kind="stable")
    rid, a, z = rid[order], a[order], z[order]
    r, at = np.unique(rid, return_index=True)
    cut = list(zip(at, [*at[1:], len(rid)]))
    pack = lambda x: pa.array([x[s:e].tobytes() for s, e in cut], pa.binary())
    return pa.table({"rid": pa.array(r, pa.int64()), "from": pack(a), "to": pack(z)})


def _shards(order, keys, texts):
    """Lists of shards (lists of text numbers) in key order. Several keys share a shard; a key too
    large for one gets a list of shards of its own, to be merged."""
    part, size, k = [], 0, 0
    while k < len(order):
        e, own = k, 0
        while e < len(order) and keys[order[e]] == keys[order[k]]:
            own, e = own + len(texts[order[e]]), e + 1
        if own > SHARD_BYTES:
            several, now, room = [], [], 0
            for i in order[k:e]:
                if now and room + len(texts[i]) > SHARD_BYTES:
                    several, now, room = [*several, now], [], 0
                now.append(i)
                room += len(texts[i])
            yield [*several, now]
        else:
            if part and size + own > SHARD_BYTES:
                yield [part]
                part, size = [], 0
            part += order[k:e]
            size += own
        k = e
    if part:
        yield [part]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def unite(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def finish(keep_text: bool):
    def run(batches):
        for b in batches:
            ids, texts, lists = b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist()
            out = []
            for doc, text, groups, whole in zip(ids, texts, lists, b.column(3).to_pylist()):
                groups = groups if not whole else None
                both = [np.frombuffer(b"".join(g[n] for g in groups or []), np.uint32).tolist() for n in ("from", "to")]
                spans = unite(zip(*both)) if not whole or len(text) < SPAN else [(0, len(text))]
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, if ``keep_text``)."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    doc = F.col(id_col).cast("long")
    base = docs.select(F.xxhash64(F.coalesce(doc, F.lit(NO_ID)), text).alias("rid"), doc.alias("doc_id"), text.alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    # rows whose whole text a smaller id has; the hash is 128 bits of SHA-256
    digests = base.select("rid", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.substring(F.sha2("text", 256), 1, 32).alias("text"))
    least = digests.groupBy("text").agg(F.min("id").alias("least"))
    copies = digests.join(least, "text").filter("id > least").select("rid").distinct()
    # one partitioning by rid serves this join and both later ones: the texts are dealt out once
    shared = (base.join(copies, "rid", "left_anti").select("rid", "doc_id", "text")
              .mapInArrow(entries(buckets), ENTRY).groupBy("bucket").applyInArrow(shared_by_block(buckets), BLOCK)
              .groupBy("block").applyInArrow(by_document, RUNS))
    gone = (base.join(shared, "rid").select("rid", "doc_id", "text", "runs")
            .mapInArrow(piece_texts(buckets), PIECE).groupBy("bucket")
            .applyInArrow(removed_by_block(buckets), GONE).groupBy("block")
            .applyInArrow(gone_by_document, "rid long, from binary, to binary").select("rid", F.struct("from", "to").alias("span")))
    gone = (gone.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True)
            .groupBy("rid").agg(F.collect_list("span").alias("spans"), F.max("whole").alias("whole")))
    out = base.join(gone, "rid", "left").select("doc_id", "text", "spans", "whole").mapInArrow(finish(keep_text), RESULT)
    return out if keep_text else out.drop("kept")
