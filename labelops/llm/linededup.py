"""Operator 2: near-duplicate lines by a deletion-neighbourhood join; the earliest line stays.

A line is its words (runs of characters other than ASCII white space, A-Z in lower case). Two lines
are near-duplicates if at most one word edit (insertion, deletion, substitution) lies between them;
lines under ``MIN_WORDS`` words must be equal. A line goes if an equal or near-duplicate line comes
earlier in the input, by (id, line number, hash of the row). Lines without a word always stay.

1. One pass writes a table of lines: place, a 128-bit hash of the words, and four half keys. Equal
   lines meet by hash in a map-side combined aggregate.
2. Lines one edit apart agree in the first or in the second half of the longer one, so they share a
   half key. Lines that share none have no partner and need no variants. The rows of the others are
   found by a bitmap of their hashes (32 MB at most) before the exact join, so only their texts are shuffled.
3. The others emit their deletion variants (each word of the half that may differ left out) as
   hashed keys. A variant with its position and length joins substitutions, a variant and a whole
   line join insertions and deletions. Members of one key are compared with its earliest line only,
   never with each other: a group of any size gives one candidate per line and key.
4. Candidates are verified word by word.

Line and candidate tables are written to the shared checkpoint folder.

Defined results: null text has no lines; a null id comes after all others; rows with different
texts under one id (or without an id) are different rows, ordered at one line number by the hash of
the row; rows that repeat a row do not remove each other's line of the same number; texts of any length; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.session import scratch_dir, ship_package

from .common import freeing

MIN_WORDS = 8
NO_ID = 2**63 - 1
BITMAP_BITS = 28  # the largest bitmap of row hashes: 2^28 bits, 32 MB
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 2**64)

LINE = "rid long, doc long, line int, key binary, n_words int, halves array<long>"


def words_of(line: str) -> list[bytes]:
    return line.encode().lower().split()  # bytes: A-Z only, ASCII white space only


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the halves of this line as one of n words, then as the shorter partner of n + 1 words."""
    from xxhash import xxh64_intdigest

    n, out = len(words), []
    for size in (n, n + 1):
        front = size // 2
        for side, part in ((0, words[:front]), (1, words[n - (size - front):])):
            out.append(xxh64_intdigest(b" ".join(part), size * 2 + side) - 2**63)
    return out


def lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    def run(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, out = b.slice(lo, 512), []
                for rid, doc, text in zip(*(c.to_pylist() for c in part.columns)):
                    for k, line in enumerate(text.split("\n")):
                        if w := words_of(line):
                            out.append((rid, doc, k, xxh3_128_digest(b" ".join(w)), len(w), half_keys(w) if len(w) >= min_words else []))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                     names=["rid", "doc", "line", "key", "n_words", "halves"])

    return docs.select(*_row(id_col, text_col)).mapInArrow(freeing(run), LINE)


def _row(id_col: str, text_col: str):
    """rid (a row's hash, equal for equal rows), doc (null as the largest id), text."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(doc, text).alias("rid"), doc.alias("doc"), text.alias("text")


def near(a: list[bytes], b: list[bytes]) -> bool:
    """At most one word edit between two lines."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    return a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def _mix(x: np.ndarray, salt) -> np.ndarray:
    x = (x ^ salt) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def variants(words: list[bytes], roles) -> set[tuple[int, str]]:
    """Hashed keys (key, kind) of a line. roles: (half shared 0-3, substitution?, deletion?).

    A deletion variant's hash comes from prefix sums of a polynomial hash, so all variants of a line
    take linear time."""
    from xxhash import xxh64_intdigest

    n, out = len(words), set()
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, BASE, np.uint64), out=power[1:])
    h = np.array([xxh64_intdigest(w, 7) for w in words], np.uint64) * power[:n]
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    without = before[:-1] + (before[-1] - before[1:]) * np.uint64(INVERSE)
    at = np.arange(n, dtype=np.uint64)
    for half, sub, dele in roles:
        if half >= 2:
            out.add((int(_mix(before[-1:], np.uint64(n << 1))[0]), "f"))
            continue
        part = slice(n // 2, n) if half == 0 else slice(0, n // 2)
        if sub:
            out.update((k, "s") for k in _mix(_mix(without[part], at[part]).view(np.uint64), np.uint64(n << 1 | 1)).tolist())
        if dele:
            out.update((k, "d") for k in _mix(without[part], np.uint64((n - 1) << 1)).tolist())
    return out


def marked_rows(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """The rows whose rid may be in ``wanted``: all that are, and of the others those whose hash meets a
    marked bit of a broadcast bitmap of 2^bits bits (in blocks of 32768)."""
    cell = F.expr(f"rid & {(1 << bits) - 1}L")
    block, at = lambda c: F.shiftright(c, 15), lambda c: c.bitwiseAND(32767)
    marks = wanted.groupBy(block(cell).alias("block")).agg(F.bitmap_construct_agg(at(cell)).alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", F.shiftright(at(cell), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = (block(cell) == F.col("block")) & (F.getbit(byte, at(cell).bitwiseAND(7).cast("int")) == 1)
    return rows.join(F.broadcast(marks), hit, "left_semi")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """rid, doc_id, line_no, n_words, verdict (kept, equal, near), first_doc_id, first_line_no: every
    line with a word; the last two name the earlier line that removes it."""
    spark = docs.sparkSession
    ship_package(spark)
    place = scratch_dir(spark, "lines")
    lines(docs, id_col, text_col, min_words).write.parquet(f"{place}/lines")
    every = spark.read.parquet(f"{place}/lines")

    distinct = (every.groupBy("key").agg(F.min(F.struct("doc", "line", "rid")).alias("first"),
                                         F.max("n_words").alias("n_words"), F.min("halves").alias("halves")))
    half = distinct.filter(F.size("halves") > 0).select("key", "first", F.posexplode("halves").alias("half", "hk"))
    long_, short = F.when(F.col("half") < 2, F.col("key")), F.when(F.col("half") >= 2, F.col("key"))
    shared = (half.groupBy("hk").agg(F.min(long_).alias("a"), F.max(long_).alias("b"), F.count(short).alias("n"))
              .select("hk", (F.col("a") != F.col("b")).alias("sub"), (F.col("a").isNotNull() & (F.col("n") > 0)).alias("del"))
              .filter("sub or del"))
    roles = (half.join(shared, "hk").filter((F.col("half") < 2) | F.col("del"))
             .groupBy("first").agg(F.collect_list(F.struct("half", "sub", "del")).alias("roles")))
    wanted = roles.select("first.rid", F.struct("first.doc", "first.line", "first.rid", "roles").alias("x"))
    wanted.groupBy("rid").agg(F.collect_list("x").alias("wanted")).write.parquet(f"{place}/wanted")
    per_row = spark.read.parquet(f"{place}/wanted")
    bits = min(BITMAP_BITS, max(15, (16 * per_row.count()).bit_length()))

    def fetch(batches):
        for b in batches:
            out = []
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of = text.split("\n")
                for x in wanted:
                    out.append((x["doc"], x["line"], x["rid"], b" ".join(words_of(of[x["line"]])), x["roles"]))
            if out:
                cols = list(zip(*out))
                role = pa.list_(pa.struct([("half", pa.int32()), ("sub", pa.bool_()), ("del", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                                  pa.array(cols[3], pa.binary()), pa.array(cols[4], role)], names=["doc", "line", "rid", "words", "roles"])

    base = docs.select(*_row(id_col, text_col))
    (marked_rows(base, per_row.select("rid"), bits).join(per_row, "rid").select("text", "wanted")
     .mapInArrow(fetch, "doc long, line int, rid long, words binary, roles array<struct<half:int,sub:boolean,del:boolean>>")
     .dropDuplicates(["doc", "line", "rid"]).write.parquet(f"{place}/candidates"))
    texts = spark.read.parquet(f"{place}/candidates")

    def emit(batches):
        for b in batches:
            for doc, line, rid, words, roles in zip(*(b.column(n).to_pylist() for n in ("doc", "line", "rid", "words", "roles"))):
                got = variants(words.split(b" "), [(r["half"], r["sub"], r["del"]) for r in roles])
                keys, kinds = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(got), pa.int64()), pa.array([line] * len(got), pa.int32()),
                                                  pa.array([rid] * len(got), pa.int64()), pa.array(keys, pa.int64()), pa.array(kinds, pa.string())],
                                                 names=["doc", "line", "rid", "vk", "kind"])

    out = texts.mapInArrow(emit, "doc long, line int, rid long, vk long, kind string").select(
        "vk", "kind", F.struct("doc", "line", "rid").alias("me"))
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("me"))).alias(k)
    least = out.groupBy("vk").agg(of("s"), of("d"), of("f"))
    partner = F.when(F.col("kind") == "s", F.col("s")).when(F.col("kind") == "d", F.col("f")).otherwise(F.col("d"))
    pairs = (out.join(least, "vk").select("me", partner.alias("first")).filter(F.col("first") < F.col("me")).distinct())
    text_of = lambda c: texts.select(F.struct("doc", "line", "rid").alias(c), F.col("words").alias(f"w_{c}"))
    both = pairs.join(text_of("me"), "me").join(text_of("first"), "first")

    def verify(batches):
        import pyarrow.compute  # noqa: F401

        for b in batches:
            ok = [near(x.split(b" "), y.split(b" ")) for x, y in zip(b.column("w_me").to_pylist(), b.column("w_first").to_pylist())]
            kept = pa.Table.from_batches([b]).filter(pa.array(ok, pa.bool_())).select(["doc", "line", "rid", "fdoc", "fline", "frid"])
            yield from kept.to_batches()

    found = (both.select("me.doc", "me.line", "me.rid", F.col("first.doc").alias("fdoc"), F.col("first.line").alias("fline"),
                         F.col("first.rid").alias("frid"), "w_me", "w_first")
             .mapInArrow(verify, "doc long, line int, rid long, fdoc long, fline int, frid long")
             .groupBy("doc", "line", "rid").agg(F.min(F.struct("fdoc", "fline", "frid")).alias("near")))
    firsts = distinct.select("key", "first.doc", "first.line", "first.rid")
    verdicts = firsts.join(found, ["doc", "line", "rid"], "left").select(
        "key", F.col("doc").alias("kdoc"), F.col("line").alias("kline"), F.col("rid").alias("krid"), "near")
    rows = every.select("rid", "doc", "line", "n_words", "key").join(verdicts, "key")
    is_first = (F.col("doc") == F.col("kdoc")) & (F.col("line") == F.col("kline")) & (F.col("rid") == F.col("krid"))
    verdict = F.when(~is_first, "equal").when(F.col("near").isNotNull(), "near").otherwise("kept")
    real = lambda c: F.when(c != NO_ID, c)
    by = F.when(~is_first, F.struct("kdoc", "kline")).otherwise(F.struct(F.col("near.fdoc").alias("kdoc"), F.col("near.fline").alias("kline")))
    return rows.select("rid", real(F.col("doc")).alias("doc_id"), F.col("line").alias("line_no"), "n_words", verdict.alias("verdict"),
                       by.alias("by")).select("rid", "doc_id", "line_no", "n_words", "verdict",
                                              real(F.col("by.kdoc")).alias("first_doc_id"), F.col("by.kline").alias("first_line_no"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, with the removed lines taken out of the text; texts that lose every line with a word go."""
    gone = (line_dedup(docs, id_col, text_col, min_words).filter("verdict <> 'kept'").groupBy("rid")
            .agg(F.collect_set("line_no").alias("gone")))
    row = docs.select(F.struct("*").alias("row"), _row(id_col, text_col)[0])
    names = docs.columns
    kept_type = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            texts, gone = b.column(0).field(names.index(text_col)).to_pylist(), b.column(1).to_pylist()
            out, stay = [], []
            for t, g in zip(texts, gone):
                if g:
                    g = set(g)
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
                out.append(t)
                stay.append(not g or bool(words_of(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(stay, pa.bool_())],
                                             names=["row", "new_text", "stay"])

    out = row.join(gone, "rid", "left").select("row", "gone").mapInArrow(freeing(cut), f"row {kept_type}, new_text string, stay boolean")
    return out.filter("stay").select(*[F.col("new_text").alias(n) if n == text_col else F.col(f"row.`{n}`") for n in names])
