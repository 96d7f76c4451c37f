"""Operator 11: phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces at punctuation and line ends, pieces into words. Everything is per language.

1. **Filter.** A phrase stands 100 times only if each pair and triple of neighbouring words in it does. Words
   and pairs, then the triples of open pairs, are counted in a table of hash cells, whose size follows
   the corpus up to ``CELL_BITS``; the cells that reach the support make a bitmap of at most 32 MB,
   which is broadcast. A cell may hold strangers, so it can leave a rare gram open, but never stops a
   frequent one. All words of all texts go into these counts.
2. **Graph.** Nodes are 4-grams, edges the open 5-grams between overlapping nodes, weighted by their
   occurrences. Besides these, only the ends are counted from text: the places where an open gram of
   1 to 4 words is followed by a piece's end or by a word that closes it. Counts are summed per slice of
   text in numpy, then over the slices of a task (``GRAMS_HELD`` grams at a time), so a gram in a third of
   the corpus is sent once a task. Grams travel packed by hash bucket, a row for each language and
   bucket; buckets follow the size of the corpus, and a group sums one of them.
3. **Shorter counts.** A node's count is the flow along its outgoing edges plus the ends in it; the same
   rule takes 4-grams to 3-grams, and so on down to words.
4. **Compaction.** A node whose count equals one incoming and one outgoing edge is passed through by
   every occurrence. Such unary paths are joined into one row by pointer doubling (the rounds follow
   the logarithm of the longest path; a cycle would need an endless text). Paths give the 4-grams
   that one of their edges covers.
5. **Score.** Cuts are scored in decimals of 38 digits, exact while 1000 * a * n is below 10^38. The ranking
   filters inside each task first, so only the best rows of every task meet.

Defined results: null text is empty; a null language is ``und``; empty pieces and texts have no words; a
repeated row counts again; ids and other columns are not read; an empty table gives an empty result. Texts are split as
bytes, so a text of any size is whole, and pieces of long texts are handled in parts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import scratch_dir, ship_package

from .common import freeing

SUPPORT = 100
LONGEST = 5
TOP = 2000
PART_BYTES = 2 << 20  # of text handled at a time in a task
CELL_BITS = 28  # the pair filter's largest table: 2^28 cells, a bitmap of 32 MB
CHUNK_BITS = 16
CELLS_HELD = 2 << 20  # cells kept in a task before they are sent
GRAMS_HELD = 1 << 20  # grams kept in a task before they are summed, and sent if more than half of them stay
BUCKET_BYTES = 8 << 20  # of text a hash bucket of grams stands for
#: piece separators of the contract become one byte that no word can hold; A-Z in lower case
BREAK = b"."
TO_LOWER = bytes(ord(BREAK) if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def parts_of(text: bytes, most: int):
    """A text in parts of about ``most`` bytes, cut at piece ends."""
    at = 0
    while len(text) - at > most:
        cut = text.find(BREAK, at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_slices(batches, most: int = PART_BYTES):
    """(language, words, token numbers with 0 between pieces) for slices of about ``most`` bytes of one
    language. ``batches`` have the columns lang and text as bytes; words[0] stands for the break."""
    held: dict[str, list] = defaultdict(list)
    size = 0

    def flush():
        for lang, texts in held.items():
            number = defaultdict()
            number.default_factory = number.__len__
            number[BREAK]
            joined = BREAK.join(texts).replace(BREAK, b" . ")
            tokens = joined.split()
            ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
            yield lang, list(number), np.concatenate([[0], ids, [0]]).astype(np.int64)
        held.clear()

    for b in batches:
        langs = b.column(0).to_pylist()
        for lang, value in zip(langs, b.column(1)):
            for part in parts_of(value.as_buffer().to_pybytes().translate(TO_LOWER), most):
                held[lang].append(part)
                size += len(part)
                if size >= most:
                    yield from flush()
                    size = 0
    yield from flush()


def _hashes(lang: str, words: list[bytes]):
    """Function from token numbers at neighbouring places to 64-bit hashes of their grams."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    h = np.array([xxh64_intdigest(w, seed) for w in words], np.uint64)

    def mixed(first, *more):
        x = h[first]
        for m in more:
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[m]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x

    return mixed


def _cells(mixed, bits: int):
    """Function from token numbers at neighbouring places to hash cells of words, pairs or triples."""
    return lambda *at: (mixed(*at) >> np.uint64(64 - bits)).astype(np.int64)


def _has(bitmap, cells: np.ndarray) -> np.ndarray:
    bitmap = np.frombuffer(bitmap, np.uint8)
    return (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def open_grams(a: np.ndarray, cell, bitmaps, longest: int):
    """For k = 1, 2, ...: whether the k-gram at each place may be frequent, as far as the bitmaps (of words and
    pairs, then of triples) tell. ``a`` ends with ``longest`` zeros."""
    common = np.zeros(int(a.max(initial=0)) + 1, bool)
    common[1:] = _has(bitmaps[0], cell(np.arange(1, len(common))))
    chains = [common[a]]
    while len(chains) < longest:
        k, now = len(chains) + 1, chains[-1]
        follow = np.zeros(len(a), bool)
        follow[:-1] = now[:-1] & now[1:]
        if k - 2 < len(bitmaps):
            at = np.flatnonzero(follow)
            follow[at] = _has(bitmaps[k - 2], cell(*(a[at + j] for j in range(k))))
        chains.append(follow)
    return chains


CELLS = "chunk int, lang string, n long, offsets binary, counts binary"


def cell_counts(bits: int, support: int, part_bytes: int = PART_BYTES, shared=()):
    """Rows of two kinds: cells with counts (up to the support), by chunk; words per language. Cells of words
    and pairs if no bitmap is ``shared``, else of the triples that the bitmap of pairs leaves open."""
    def run(batches):
        n: dict[str, int] = defaultdict(int)
        cells, counts = [], []
        bitmaps = [s.value for s in shared]
        for lang, words, a in token_slices(batches, part_bytes):
            cell = _cells(_hashes(lang, words), bits)
            if bitmaps:
                pair = open_grams(a, cell, bitmaps, 2)[1]
                at = np.flatnonzero(pair[:-1] & pair[1:])
                here = cell(a[at], a[at + 1], a[at + 2])
            else:
                live = a[a > 0]
                n[lang] += len(live)
                both = np.flatnonzero((a[:-1] > 0) & (a[1:] > 0))
                here = np.concatenate([cell(live), cell(a[both], a[both + 1])])
            c, k = np.unique(here.astype(np.uint32), return_counts=True)
            cells.append(c)
            counts.append(k.astype(np.uint32))
            if sum(map(len, cells)) > CELLS_HELD:
                yield _cell_rows(cells, counts, bits, support)
                cells, counts = [], []
        yield _cell_rows(cells, counts, bits, support)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(n), pa.int32()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
             pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], names=["chunk", "lang", "n", "offsets", "counts"])

    return run


def _summed(cells, counts):
    c, k = np.concatenate([np.zeros(0, np.uint32), *cells]), np.concatenate([np.zeros(0, np.uint32), *counts])
    order = np.argsort(c, kind="stable")
    c, k = c[order], k[order]
    at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    return c[at], np.add.reduceat(k, at) if len(at) else k


def _planes(x: np.ndarray) -> bytes:
    """16-bit numbers, low bytes first, then the high bytes, which are mostly zero and compress."""
    return x.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _from_planes(value) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value.as_buffer(), np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _cell_rows(cells, counts, bits: int, support: int) -> pa.RecordBatch:
    c, k = _summed(cells, counts)
    chunk, at = np.unique(c >> CHUNK_BITS, return_index=True)
    cut = list(zip(at, [*at[1:], len(c)]))
    low, k = (c & ((1 << CHUNK_BITS) - 1)).astype(np.uint16), np.minimum(k, min(support, 65535)).astype(np.uint16)
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.astype(np.int32)), pa.nulls(len(cut), pa.string()), pa.nulls(len(cut), pa.int64()),
         pa.array([_planes(np.diff(low[s:e], prepend=np.uint16(0))) for s, e in cut], pa.binary()),
         pa.array([_planes(k[s:e]) for s, e in cut], pa.binary())],
        names=["chunk", "lang", "n", "offsets", "counts"])


def frequent_cells(support: int):
    """Bitmap of one chunk: the cells that reach the support."""
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for off, k in zip(table["offsets"], table["counts"]):
            total[np.cumsum(_from_planes(off), dtype=np.int64)] += _from_planes(k)  # offsets of a row are distinct
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([np.packbits(total >= min(support, 65535)).tobytes()], pa.binary())})

    return run


GRAMS = "lang string, bucket int, grams binary, n binary"


def gram_counts(shared, bits: int, longest: int, part_bytes: int = PART_BYTES, buckets: int = 1):
    """Edges (k = longest) and the shorter open grams that no open gram extends, summed over the slices of a
    task: per language and bucket, the grams by lines and their counts as 64-bit numbers."""
    def run(batches):
        bitmaps = [s.value for s in shared]
        held, size = [], 0
        for lang, words, a in token_slices(batches, part_bytes):
            a = np.concatenate([a, np.zeros(longest, np.int64)])
            mixed = _hashes(lang, words)
            chains, grams, ns, bucket = open_grams(a, _cells(mixed, bits), bitmaps, longest), [], [], []
            for k, chain in enumerate(chains, 1):
                ends = chain if k == longest else chain & ~chains[k]
                at, n = _distinct(a, np.flatnonzero(ends), k, len(words))
                grams += [b" ".join(words[t] for t in a[p:p + k]) for p in at.tolist()]
                ns.append(n)
                bucket.append(((mixed(*(a[at + j] for j in range(k))) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32))
            held.append(pa.table({"lang": pa.array([lang] * len(grams), pa.string()), "bucket": np.concatenate(bucket),
                                  "gram": pa.array(grams, pa.binary()), "n": np.concatenate(ns)}))
            size += len(grams)
            if size > GRAMS_HELD:
                held = [_summed_grams(held, ["lang", "bucket", "gram"])]
                size = held[0].num_rows
                if size > GRAMS_HELD // 2:
                    yield _packed_grams(held[0])
                    held, size = [], 0
        if size:
            yield _packed_grams(_summed_grams(held, ["lang", "bucket", "gram"]))

    return run


def _summed_grams(tables, keys) -> pa.Table:
    import pyarrow.compute  # noqa: F401

    t = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return t.select([*keys, "n_sum"]).rename_columns([*keys, "n"])


def _packed_grams(t: pa.Table) -> pa.RecordBatch:
    t = t.sort_by([(c, "ascending") for c in ("lang", "bucket", "gram")])
    lang, bucket, grams, n = t["lang"].to_pylist(), t["bucket"].to_numpy(), t["gram"].to_pylist(), t["n"].to_numpy().astype("<i8")
    at = [i for i in range(len(lang)) if not i or bucket[i] != bucket[i - 1] or lang[i] != lang[i - 1]]
    cut = list(zip(at, [*at[1:], len(lang)]))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang[s] for s in at], pa.string()), pa.array(bucket[at], pa.int32()),
         pa.array([b"\n".join(grams[s:e]) for s, e in cut], pa.binary()), pa.array([n[s:e].tobytes() for s, e in cut], pa.binary())],
        names=["lang", "bucket", "grams", "n"])


def merged_grams(table: pa.Table) -> pa.Table:
    """(lang, k, gram, n) of one language and bucket."""
    parts = [pa.table({"gram": pa.array(g.as_py().split(b"\n"), pa.binary()), "n": np.frombuffer(n.as_buffer(), "<i8")})
             for g, n in zip(table["grams"], table["n"])]
    t = _summed_grams(parts, ["gram"])
    k = pa.array([g.as_buffer().to_pybytes().count(b" ") + 1 for g in t["gram"]], pa.int32())
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(k), pa.string()), "k": k, "gram": t["gram"], "n": t["n"]})


def _distinct(a: np.ndarray, at: np.ndarray, k: int, n_words: int):
    """Places of the distinct k-grams that start at ``at``, and how often each does."""
    key, first, n = a[at], np.arange(len(at)), np.ones(len(at), np.int64)
    for j in range(k):
        if j:
            key = key * n_words + a[at + j]
        _, first, key, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return at[first], n


def _words(gram, lo: int, hi: int):
    """Words lo to hi (exclusive) of a space-joined gram."""
    return F.array_join(F.slice(F.split(gram, " ", -1), lo + 1, hi - lo), " ")


def unary_paths(edges: DataFrame, nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, path, n): edges (lang, gram, n) joined along the nodes (lang, gram, n) that all occurrences
    pass through from one edge to one edge."""
    node = nodes.select("lang", F.col("gram").alias("node"), F.col("n").alias("flow"))
    ends = edges.select("lang", "gram", "n", _words(F.col("gram"), 0, longest - 1).alias("u"),
                        _words(F.col("gram"), 1, longest).alias("v"))
    into = ends.select("lang", F.col("v").alias("node"), F.col("gram").alias("before"), F.col("n").alias("flow"))
    out = ends.select("lang", F.col("u").alias("node"), "gram", F.col("n").alias("flow"))
    link = into.join(node, ["lang", "node", "flow"]).join(out, ["lang", "node", "flow"]).select("lang", "gram", "before")
    state = (edges.join(link, ["lang", "gram"], "left")
             .select("lang", "gram", "n", F.coalesce("before", "gram").alias("head"),
                     F.col("before").isNotNull().cast("long").alias("steps"))).checkpoint()
    while True:  # pointer doubling: the reach doubles in each round
        jump = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("far"), F.col("steps").alias("more"))
        after = state.join(jump, ["lang", "head"]).select(
            "lang", "gram", "n", F.col("far").alias("head"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("more") > 0).alias("moved")).checkpoint()
        state = after.drop("moved")
        if after.filter("moved").isEmpty():
            break
    last = F.substring_index("gram", " ", -1)
    return (state.groupBy("lang", "head", "n").agg(F.array_sort(F.collect_list(F.struct("steps", last.alias("w")))).alias("x"))
            .select("lang", F.concat_ws(" ", "head", F.expr("array_join(transform(slice(x, 2, size(x)), e -> e.w), ' ')")).alias("path"), "n")
            .withColumn("path", F.regexp_replace("path", " $", "")))


def gram_table(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
               longest: int = LONGEST, cell_bits: int | None = None, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, k, gram, n) of all grams of 1 to ``longest`` words that stand ``support`` times or more (words of
    rare pairs only may be missing), and (lang, n), the number of words of each language."""
    spark = docs.sparkSession
    ship_package(spark)
    place = scratch_dir(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if cell_bits is None:
        cell_bits = min(CELL_BITS, max(CHUNK_BITS, (size // 24).bit_length()))
    width = 1 << (CHUNK_BITS - 3)
    shared = []
    for step in ("pairs", "triples")[:longest - 1]:
        rows.mapInArrow(freeing(cell_counts(cell_bits, support, part_bytes, list(shared))), CELLS).write.parquet(f"{place}/{step}")
        cells = spark.read.schema(CELLS).parquet(f"{place}/{step}")
        bitmap = bytearray(max(width, 1 << max(0, cell_bits - 3)))
        for r in (cells.filter("chunk IS NOT NULL").select("chunk", "offsets", "counts").groupBy("chunk")
                  .applyInArrow(frequent_cells(support), "chunk int, bits binary").collect()):  # 32 MB at most
            bitmap[r.chunk * width:(r.chunk + 1) * width] = r.bits
        shared.append(spark.sparkContext.broadcast(bytes(bitmap)))
    total = spark.read.schema(CELLS).parquet(f"{place}/pairs").filter("chunk IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    (rows.mapInArrow(freeing(gram_counts(shared, cell_bits, longest, part_bytes, 1 + size // BUCKET_BYTES)), GRAMS)
     .groupBy("lang", "bucket").applyInArrow(merged_grams, "lang string, k int, gram binary, n long")
     .withColumn("gram", F.col("gram").cast("string")).write.partitionBy("k").parquet(f"{place}/counted"))
    for s in shared:
        s.unpersist()
    counted = spark.read.schema("lang string, gram string, n long, k int").parquet(f"{place}/counted")
    for k in range(longest, 0, -1):  # node flow plus the ends here
        level = counted.filter(F.col("k") == k).select("lang", "gram", "n")
        if k < longest:
            above = spark.read.schema("lang string, gram string, n long").parquet(f"{place}/k={k + 1}")
            level = (level.unionByName(above.withColumn("gram", F.substring_index("gram", " ", k)))
                     .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
        level.write.parquet(f"{place}/k={k}")
    grams = None
    for k in range(1, longest + 1):
        level = (spark.read.schema("lang string, gram string, n long").parquet(f"{place}/k={k}")
                 .filter(F.col("n") >= support).select("lang", F.lit(k).alias("k"), "gram", "n"))
        grams = level if grams is None else grams.unionByName(level)
    grams.write.parquet(f"{place}/grams")  # read several times below
    return spark.read.schema("lang string, k int, gram string, n long").parquet(f"{place}/grams"), total


def covered(grams: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, most): the largest count of a gram that is one word longer and holds this one."""
    paths = unary_paths(grams.filter(F.col("k") == longest), grams.filter(F.col("k") == longest - 1), longest)
    w = F.split("path", " ", -1)
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (longest - 2)), lambda i: F.array_join(F.slice(w, i, longest - 1), " "))
    out = paths.select("lang", F.explode(F.array_distinct(windows)).alias("gram"), "n")
    for k in range(2, longest - 1):
        level = grams.filter(F.col("k") == k + 1)
        for lo in (0, 1):
            out = out.unionByName(level.select("lang", _words(F.col("gram"), lo, lo + k).alias("gram"), "n"))
    return out.groupBy("lang", "gram").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
                 longest: int = LONGEST, top: int | None = TOP, cell_bits: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to ``longest`` words in order of their score,
    the first ``top`` of each language (all if None)."""
    grams, total = gram_table(docs, text_col, lang_col, support, longest, cell_bits, part_bytes)
    found = (grams.filter("k > 1").join(covered(grams, longest), ["lang", "gram"], "left")
             .filter("most IS NULL OR most < n").select("lang", F.col("gram").alias("phrase"), "k", F.col("n").alias("a")))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")
    cuts = found.select("*", cut).select("lang", "phrase", "a", "at",
                                         F.expr("substring_index(phrase, ' ', at)").alias("first"),
                                         F.expr("substring_index(phrase, ' ', at - k)").alias("rest"))
    part = lambda gram, n: grams.select("lang", F.col("gram").alias(gram), F.col("n").alias(n))
    scored = (cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
              .withColumn("score", F.expr("(1000BD * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)))"
                                          " div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")))
    best = (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("c"))
            .select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.withColumn("rank", F.row_number().over(order).cast("long"))
    out = out.filter(F.col("rank") <= top) if top is not None else out
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
