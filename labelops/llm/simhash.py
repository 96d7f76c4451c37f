"""Operator 1: SimHash near-dedup by a binary trie self-join.

Fingerprints: bit b is 1 if it is set in over half of the document's shingle hashes (XXH64, seed 42).
All distinct fingerprints form a binary trie. Two fingerprints are linked if they differ in at most
``max_bits`` bits; the self-join walks pairs of trie nodes together, adds up the differing bits and
drops a pair once the budget is exceeded.

* The top of the trie is walked by Spark: nodes at a depth chosen from the number of fingerprints
  are paired by an equi-join on the prefixes within the budget. Pairs whose nodes hold more than
  ``leaf`` fingerprints go down ``STEP`` more bits, again by joins, until every node is small (at
  64 bits a node is one fingerprint), so a dense cluster is split whatever its size.
* Each remaining pair of subtries is one row; the walk goes on inside a task in numpy. A task gives
  back a spanning forest of the links it finds (fewer rows than fingerprints), not all pairs, which
  keeps every connection.
* Components come from alternating large-star and small-star steps on (larger, smaller) id pairs.

Exact copies share a fingerprint and meet as one node, so a text repeated in a third of the corpus
is one trie leaf. Fingerprint and edge tables are written to the shared checkpoint folder.

Defined results: null, empty or blank text has fingerprint zero and links like any other; a text
with fewer words than a shingle is one shingle; rows with a null id link like others but never name
a component (a component of such rows only has a null id); repeated rows each come back; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.session import scratch_dir, ship_package

from .common import freeing, row_key

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: fingerprints in one trie node handed to a task, and bits of one descent
LEAF = 2048
STEP = 4
#: shingles hashed, and node pairs expanded, at a time
HASH_CHUNK = 1 << 16
PAIR_CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a whole text; long texts are hashed in chunks of shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    total, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for at in range(0, total, HASH_CHUNK):
        part = words[at:min(at + HASH_CHUNK, total) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        h = np.array([xxh64_intdigest(b" ".join(g), SEED) for g in grams], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 keyed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), row key if ``keyed``."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]],
                                             names=["doc_id", "fp", *["key"] * keyed])

    key = [row_key(id_col, text_col).alias("key")] * keyed
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *key)
            .mapInArrow(freeing(run), "doc_id long, fp long" + ", key binary" * keyed))


def _ranges(lo1, hi1, lo2, hi2):
    """All index pairs of many small rectangles [lo1, hi1) x [lo2, hi2)."""
    n2 = hi2 - lo2
    size = (hi1 - lo1) * n2
    of = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return lo1[of] + k // n2[of], lo2[of] + k % n2[of]


def walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: int):
    """Yield index pairs (i of a, j of b) within ``budget`` bits; a and b are sorted, each below one node."""
    one = np.uint64(1)
    stack = [(63 - depth, np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([0]))]
    while stack:
        bit, lo1, hi1, lo2, hi2, used = stack.pop()
        small = (hi1 - lo1) * (hi2 - lo2) <= 32 if bit >= 0 else np.ones(len(lo1), bool)
        if small.any():
            rect = [x[small] for x in (lo1, hi1, lo2, hi2)]
            cost = np.cumsum((rect[1] - rect[0]) * (rect[3] - rect[2])) // PAIR_CHUNK
            for c in np.unique(cost):
                i, j = _ranges(*(x[cost == c] for x in rect))
                ok = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    ok &= i < j
                yield i[ok], j[ok]
            lo1, hi1, lo2, hi2, used = (x[~small] for x in (lo1, hi1, lo2, hi2, used))
        if not len(lo1):
            continue
        shift = np.uint64(bit)
        mid1 = np.searchsorted(a, (a[lo1] >> shift | one) << shift)
        mid2 = np.searchsorted(b, (b[lo2] >> shift | one) << shift)
        children = []
        for l1, h1, l2, h2, more in ((lo1, mid1, lo2, mid2, 0), (mid1, hi1, mid2, hi2, 0),
                                     (lo1, mid1, mid2, hi2, 1), (mid1, hi1, lo2, mid2, 1)):
            keep = (l1 < h1) & (l2 < h2) & (used + more <= budget)
            if same:
                keep &= l1 <= l2  # the mirrored pair of nodes is visited from its other side
            children.append([x[keep] for x in (l1, h1, l2, h2, used + more)])
        joined = [np.concatenate(x) for x in zip(*children)]
        for at in range(0, len(joined[0]), PAIR_CHUNK):
            stack.append((bit - 1, *(x[at:at + PAIR_CHUNK] for x in joined)))


def forest(n: int, links) -> np.ndarray:
    """Smallest index reachable from each of n indices, links arriving in chunks."""
    label = np.arange(n)
    for u, v in links:
        while len(u):
            lu, lv = label[u], label[v]
            open_ = lu != lv
            u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
            np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
            while (label[label] != label).any():
                label = label[label]
    return label


def subtrie_links(fa, ia, fb, ib, same: bool, depth: int, budget: int):
    """(larger id, smaller id) of a spanning forest of the links between two subtries."""
    fa, ia = np.asarray(fa, np.int64).view(np.uint64), np.asarray(ia, np.int64)
    order = np.argsort(fa)
    fa, ia = fa[order], ia[order]
    if same:
        fb, ids, base = fa, ia, 0
    else:
        fb, ib = np.asarray(fb, np.int64).view(np.uint64), np.asarray(ib, np.int64)
        order = np.argsort(fb)
        fb, ids, base = fb[order], np.concatenate([ia, ib[order]]), len(fa)
    label = forest(len(ids), ((i, j + base) for i, j in _walk_pair(fa, fb, same, depth, budget)))
    x = np.flatnonzero(label != np.arange(len(ids)))
    u, v = ids[x], ids[label[x]]
    return np.maximum(u, v), np.minimum(u, v)


def _walk_pair(fa, fb, same, depth, budget):
    if not len(fa) or not len(fb):
        return
    # below `depth` only: the bits above are one constant, so they take a fixed part of the budget
    top = int(np.bitwise_count((fa[0] ^ fb[0]) >> np.uint64(64 - depth))) if depth else 0
    low = np.uint64(2**64 - 1) if depth == 0 else np.uint64(2 ** (64 - depth) - 1)
    yield from walk(fa & low, fb & low, same, depth, budget - top)


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _near(prefix, depth: int, budget: int):
    """All prefixes within ``budget`` flipped bits: the trie nodes the walk can pair with this one."""
    masks = [sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(depth), k)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: prefix.bitwiseXOR(m))


def trie_links(fps: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """Links of a table (fp, id) of distinct fingerprints as (u, v), u > v: a spanning set of ids."""
    depth, total = 0, fps.count()
    while total >> depth > leaf // 2 and depth < 64:
        depth += STEP
    ready, pairs = [], None
    while True:
        nodes = fps.groupBy(_prefix(depth).alias("node")).agg(F.count("*").alias("n"))
        if pairs is None:
            near = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"),
                                F.explode(_near(F.col("node"), depth, max_bits)).alias("b"))
        else:
            # children of both nodes of every heavy pair that stay within the budget
            down = nodes.withColumn("up", F.shiftrightunsigned("node", STEP))
            left = pairs.join(down.select(F.col("up").alias("a"), F.col("node").alias("ca"), F.col("n").alias("na")), "a")
            low = F.col("ca").bitwiseAND(2**STEP - 1)
            flips = F.transform(F.sequence(F.lit(0), F.lit(2**STEP - 1)),
                                lambda m: F.shiftleft("b", STEP).bitwiseOR(low.bitwiseXOR(m.cast("long"))))
            near = left.select(F.col("ca").alias("a"), "na", F.explode(flips).alias("b"))
            near = near.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()
        found = (near.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
                 .filter(F.col("a") <= F.col("b"))
                 .withColumn("heavy", (F.greatest("na", "nb") > leaf) & F.lit(depth < 64)).checkpoint())
        ready.append(found.filter(~F.col("heavy")).select(F.lit(depth).alias("depth"), "a", "b"))
        pairs = found.filter("heavy").select("a", "b")
        if depth >= 64 or pairs.isEmpty():
            break
        depth += STEP
    depths = list(range(depth - STEP * (len(ready) - 1), depth + 1, STEP))
    tasks = ready[0]
    for r in ready[1:]:
        tasks = tasks.unionByName(r)

    # fingerprints of the nodes that take part, at most `leaf` in one row
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("node")) for d in depths])).alias("at")
    used = tasks.select("depth", F.col("a").alias("node")).union(tasks.select("depth", "b")).distinct()
    packed = (fps.select("fp", "id", at).select("fp", "id", "at.depth", "at.node").join(used, ["depth", "node"], "left_semi")
              .groupBy("depth", "node").agg(F.collect_list(F.struct("fp", "id")).alias("x"))
              .select("depth", "node", F.col("x.fp").alias("fps"), F.col("x.id").alias("ids")))
    side = lambda c: packed.select("depth", F.col("node").alias(c), F.col("fps").alias(f"f{c}"), F.col("ids").alias(f"i{c}"))
    rows = tasks.join(side("a"), ["depth", "a"]).join(side("b"), ["depth", "b"])

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                lists = [cols[n][k].values.to_numpy(zero_copy_only=False) for n in ("fa", "ia", "fb", "ib")]
                same = cols["a"][k].as_py() == cols["b"][k].as_py()
                u, v = subtrie_links(*lists, same, cols["depth"][k].as_py(), max_bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.select("depth", "a", "b", "fa", "ia", "fb", "ib").mapInArrow(run, "u long, v long").distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) for every id in a link, root the smallest id reachable; alternating star steps."""
    edges, before = links.checkpoint(), None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").filter("u > v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, leaf: int, keyed: bool) -> DataFrame:
    """The rows of ``fingerprints`` with group, a number for each component that has nothing to do with
    ids, so two fingerprints never meet through an id they share, and component_id, its smallest id."""
    spark = docs.sparkSession
    ship_package(spark)
    place = scratch_dir(spark, "simhash")
    fingerprints(docs, id_col, text_col, shingle, keyed).write.parquet(f"{place}/docs")
    of_doc = spark.read.parquet(f"{place}/docs")
    (of_doc.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("id", F.monotonically_increasing_id())
     .write.parquet(f"{place}/fps"))
    fps = spark.read.parquet(f"{place}/fps")
    roots = components(trie_links(fps.select("fp", "id"), max_bits, leaf))
    label = fps.join(roots, "id", "left").select("fp", "first", F.coalesce("root", "id").alias("group"))
    least = label.groupBy("group").agg(F.min("first").alias("component_id"))
    return of_doc.join(label.select("fp", "group").join(least, "group"), "fp")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
              max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id."""
    return _grouped(docs, id_col, text_col, shingle, max_bits, leaf, False).select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """One row of docs for each component: the smallest by (id, nulls last; row key). Rows with equal id and text
    count as one, whatever their other columns."""
    rows = _grouped(docs, id_col, text_col, shingle, max_bits, leaf, True)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("first")
    kept = rows.groupBy("group").agg(first).select(F.col("first.key").alias("key"))
    whole = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    return whole.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
