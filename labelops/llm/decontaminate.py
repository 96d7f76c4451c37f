"""Operator 8: benchmark decontamination as a prefix-filtered set join, DataFrame operations only.

Every benchmark item gives windows of 13 consecutive words (one window if it has fewer). A document
contains a window exactly if the words stand there in order, so containment needs *all* tokens of
the window: with tokens ordered by rarity, the necessary prefix is the rarest token alone.

1. count the benchmark's words over the whole corpus (map-side combined; one row per word leaves a task);
2. each window is indexed under its rarest word, with the word's offset and the window's length;
3. document words are joined on that token; position and length bounds give candidate starts
   (start = position - offset must lie in the document, and so must start + length);
4. candidates go back to their document, where the exact words of the window are compared.

The benchmark side is broadcast only after its rows have been counted (``broadcast_rows``); beyond
that the same joins shuffle. Nothing is sampled: every word of every document takes part.

Defined results: null or wordless text has n_words 0 and is never contaminated; wordless items have
no window; equal items and repeated rows are kept and all counted; null ids are ordinary keys; an
empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, text_or_empty

#: separators: every ASCII character that is no letter and no digit (text is lower case by then)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13


def bench_words(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(c), SEPARATORS, -1), "")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """win (words joined by a space), len, words, items (ids as text): one row per distinct window."""
    words = items.select(F.col(id_col).cast("string").alias("item"), bench_words(text_or_empty(text_col)).alias("w"))
    words = words.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    return (words.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
            .select("item", "len", F.slice("w", F.col("s"), F.col("len")).alias("words"))
            .groupBy(F.array_join("words", " ").alias("win"), "len", "words")
            .agg(F.collect_set(F.coalesce("item", F.lit("null"))).alias("items")))


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a side only when its rows have been counted and are few."""
    return F.broadcast(df) if df.count() <= limit else df


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, share: int = 20, broadcast_rows: int = 200_000) -> DataFrame:
    """row (a struct of all columns of docs), n_words, n_hit, n_items, items_sha256, contaminated,
    items; one row per input row."""
    # documents meet their candidates by row, so rows without an id, or under one, do not share them
    base = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    text = text_or_empty(F.col(f"row.`{text_col}`"))
    windows = item_windows(items, window=window).checkpoint()
    exploded = base.select("key", F.posexplode(bench_words(text)).alias("pos", "word"))

    # 1. rarity of the benchmark's words, over all documents
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    counts = exploded.select("word").join(_small(vocabulary, broadcast_rows), "word", "left_semi").groupBy("word").count()

    # 2. the rarest word of each window is its necessary prefix
    tokens = windows.select("win", "len", F.posexplode("words").alias("off", "word"))
    ranked = tokens.join(counts, "word", "left").fillna(0, ["count"])
    anchors = (ranked.groupBy("win", "len")
               .agg(F.min(F.struct("count", "word", "off")).alias("a"))
               .filter(F.col("a.count") > 0)  # a token no document has: the window occurs nowhere
               .select("win", "len", F.col("a.word").alias("word"), F.col("a.off").alias("off"))
               .checkpoint())

    # 3. candidate starts by position
    starts = (exploded.join(_small(anchors, broadcast_rows), "word")
              .filter(F.col("pos") >= F.col("off"))
              .select("key", (F.col("pos") - F.col("off")).alias("start"), "len", "win"))
    starts = starts.join(_small(windows.select("win", "len", "items"), broadcast_rows), ["win", "len"])
    candidates = starts.groupBy("key").agg(F.collect_set(F.struct("start", "len", "win", "items")).alias("cands"))

    # 4. exact check inside the document's own words
    joined = base.join(candidates, "key", "left").select("row", bench_words(text).alias("w"), "cands")
    found = F.filter("cands", lambda c: (c["start"] + c["len"] <= F.size("w"))
                     & (F.array_join(F.slice(F.col("w"), c["start"] + 1, c["len"]), " ") == c["win"]))
    hits = joined.select("row", F.size("w").cast("long").alias("n_words"),
                         F.when(F.col("cands").isNotNull(), found).alias("hit"))
    covered = F.array_distinct(F.flatten(F.transform(
        "hit", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("hit", lambda c: c["items"]))))
    none = F.array().cast("array<string>")
    out = hits.select("row", "n_words",
                      F.coalesce(F.size(F.when(F.col("hit").isNotNull(), covered)), F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce(F.when(F.col("hit").isNotNull(), names), none).alias("items"))
    verdict = F.struct(
        "n_words", F.greatest("n_hit", F.lit(0)).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "items")
    # through a generator, so that a caller's filter on the verdict is not pushed below it, where it
    # would split the text again for each candidate
    return out.select("row", F.inline(F.array(verdict)))
