"""Batches, review flags, prompts, responses and write-back
(WIN-1, JN-2, JN-3, FLT-7, FLT-9, SET-3, AGG-25, AGG-27, TXT-1…TXT-3, SHT-2).

WIN-1 at scale: a global ``row_number()`` is one task.  ``number_rows`` instead ranks through a
tree over the bits of the integer key: rows are numbered inside buckets of 65 536 key values, and
the rows before a bucket are sums over its smaller siblings, level by level.  No window holds more
than 65 536 keys.  The counts of the lowest level are written once to the scratch folder, so the
input is evaluated twice, to count and to number, and only the key is read to count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import scratch_dir

# Batch sizes for review sheets and labelling calls, and attempts per batch.
REVIEW_BATCH = 100
LABEL_BATCH = 20
MAX_ATTEMPTS = 4  # first call + 3 retries
KEY_BITS = 16  # key bits per level of ``number_rows``

# Labelling prompt wording; {noun}, {nouns}, {count}, {language}, the label
# list and the label csv are filled in per task.
PROMPT_HEADER = (
    "\nYou are a precise {noun} classifier for {language} text. You must classify each text "
    "into EXACTLY ONE of these {count} {nouns}:\n"
    "{label_lines}\n"
    "\n"
    "IMPORTANT CONSTRAINTS:\n"
    "1. Use ONLY these {count} {nouns} - no variations, no additional {nouns}\n"
    "2. Return EXACTLY one {noun} per text\n"
    "3. Use lowercase for all {noun} labels\n"
    "4. Do not explain your choices or add any text besides the JSON object\n"
    "\n"
    "Classify the {noun} in each of these {language} texts:\n"
    "\n"
)
PROMPT_FOOTER = (
    "\nYour response must be a valid JSON object with this exact format:\n"
    "{{\n"
    '  "1": "{noun}_name",\n'
    '  "2": "{noun}_name",\n'
    "  ...\n"
    "}}\n"
    "\n"
    "Where {noun}_name is ONLY one of: {label_csv}.\n"
)
NUMBER_WORDS = {2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven", 8: "eight"}



def _strict_object(all_: str) -> str:
    """Pattern of a flat JSON object of string keys to string values (Python json.loads accepts
    exactly these bodies as a str->str dict). ``all_`` is the repetition used throughout: the
    grammar is deterministic, so giving nothing back changes no verdict."""
    chars = rf'[^"\\\x00-\x1F]{all_}'  # no raw control characters, only the escapes JSON has
    string = rf'"{chars}(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{{4}}){chars}){all_}"'
    blank = rf"[ \t\r\n]{all_}"
    entry = f"{string}{blank}:{blank}{string}{blank}"
    return rf"^{blank}\{{{blank}(?:{entry}(?:,{blank}{entry}){all_})?\}}{blank}\z"


STRICT_OBJECT = _strict_object("*")  # for engines whose patterns are automata
# possessive: Java matches such repetitions in a loop, others by one stack frame per repetition
LINEAR_STRICT_OBJECT = _strict_object("*+")
GREEDY_OBJECT = r"(\{[\s\S]*\})"


def prompt_parts(labels: Sequence[str], noun: str, nouns: str | None = None,
                 language: str = "Persian") -> tuple[str, str]:
    """Header and footer text of a labelling prompt."""
    nouns = nouns or noun + "s"
    fill = dict(noun=noun, nouns=nouns, count=NUMBER_WORDS.get(len(labels), str(len(labels))),
                language=language, label_lines="\n".join(f"- {x}" for x in labels),
                label_csv=", ".join(labels))
    return PROMPT_HEADER.format(**fill), PROMPT_FOOTER.format(**fill)


def number_rows(df: DataFrame, order_by: str, out: str = "rn") -> DataFrame:
    """Dense 1..n numbering by a unique integer key without a single-task window (see module doc)."""
    def parent(c: str) -> Column:
        return F.shiftright(F.col(c), KEY_BITS)

    level = df.select(F.shiftright(F.col(order_by).cast("bigint"), KEY_BITS).alias("_b0")) \
        .groupBy("_b0").agg(F.count(F.lit(1)).alias("_n0"))
    path = scratch_dir(df.sparkSession, "numbers")
    level.write.parquet(path)
    level = df.sparkSession.read.schema("_b0 bigint, _n0 bigint").parquet(path)
    levels = [level]
    for i in range(1, 64 // KEY_BITS):
        level = level.groupBy(parent(f"_b{i - 1}").alias(f"_b{i}")).agg(F.sum(f"_n{i - 1}").alias(f"_n{i}"))
        levels.append(level)
    # rows before each bucket: those before its parent and those of its smaller siblings; the last
    # level has one bucket for negative keys and one for the others
    before = None
    for i in reversed(range(len(levels))):
        top = before is None
        w = (Window.partitionBy() if top else Window.partitionBy("_up")).orderBy(f"_b{i}") \
            .rowsBetween(Window.unboundedPreceding, -1)
        here = levels[i].withColumn("_up", parent(f"_b{i}")) \
            .withColumn("_in", F.coalesce(F.sum(f"_n{i}").over(w), F.lit(0)).cast("bigint"))
        if top:
            before = here.select(f"_b{i}", F.col("_in").alias(f"_off{i}"))
        else:
            before = here.join(before, F.col("_up") == F.col(f"_b{i + 1}")) \
                .select(f"_b{i}", (F.col("_in") + F.col(f"_off{i + 1}")).alias(f"_off{i}"))
    tagged = df.withColumn("_b0", F.shiftright(F.col(order_by).cast("bigint"), KEY_BITS))
    ranked = tagged.withColumn("_local", F.row_number().over(Window.partitionBy("_b0").orderBy(order_by)))
    return (ranked.join(before, "_b0")
            .withColumn(out, F.col("_off0") + F.col("_local"))
            .drop("_b0", "_local", "_off0"))


def batch_numbers(df: DataFrame, order_by: str, size: int = REVIEW_BATCH) -> DataFrame:
    """WIN-1: ``batch_no`` 1.. and ``pos`` 1..size in ``order_by`` order; the last batch may be short."""
    n = number_rows(df, order_by, "_rn")
    return (n.withColumn("batch_no", F.ceil(F.col("_rn") / F.lit(size)).cast("bigint"))
            .withColumn("pos", ((F.col("_rn") - 1) % size + 1).cast("int"))
            .drop("_rn"))


def apply_flags(numbered: DataFrame, flags: DataFrame, out: str = "flagged") -> DataFrame:
    """JN-2: mark rows listed in ``flags(batch_no, pos)``; out-of-range flags match nothing."""
    f = flags.select(F.col("batch_no").cast("bigint"), F.col("pos").cast("int")).distinct() \
        .withColumn(out, F.lit(True))
    return numbered.join(f, ["batch_no", "pos"], "left").fillna(False, subset=[out])


def drop_flagged(flagged: DataFrame, flag: str = "flagged") -> DataFrame:
    """FLT-9: remove flagged rows and the flag column."""
    return flagged.filter(~F.col(flag)).drop(flag)


def batch_coverage(flagged: DataFrame, size: int = REVIEW_BATCH, flag: str = "flagged") -> DataFrame:
    """AGG-25: total batches, batches with / without flags, flags applied (in-range only)."""
    per = flagged.groupBy("batch_no").agg(F.count_if(F.col(flag)).alias("_f"), F.count(F.lit(1)).alias("_n"))
    return (per.agg(F.sum("_n").cast("bigint").alias("n_rows"),
                    F.count(F.lit(1)).alias("total_batches"),
                    F.count_if(F.col("_f") > 0).alias("batches_with_flags"),
                    F.sum("_f").cast("bigint").alias("total_flags"))
            .withColumn("batches_without_flags", F.col("total_batches") - F.col("batches_with_flags"))
            .withColumn("expected_batches", F.ceil(F.col("n_rows") / F.lit(size)).cast("bigint")))


def batches_unflagged(flagged: DataFrame, flag: str = "flagged") -> DataFrame:
    """SET-3: batch numbers with no applied flag."""
    return (flagged.groupBy("batch_no").agg(F.max(F.col(flag).cast("int")).alias("_any"))
            .filter(F.col("_any") == 0).select("batch_no"))


def _ordered_join(item: Column, sep: str) -> Column:
    """Join per-row strings of a batch in ``pos`` order (batches are bounded by their size)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), item.alias("s")))),
                                    lambda x: x["s"]), sep)


def review_sheet(numbered: DataFrame, text: str = "text") -> DataFrame:
    """SHT-2: per batch, ``"<pos>. <text>"`` lines separated by blank lines."""
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), F.col(text))
    return numbered.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_texts"),
                                            _ordered_join(line, "\n\n").alias("sheet"))


def batch_texts(numbered: DataFrame, *others: str, text: str = "text") -> DataFrame:
    """``batch_no, n_texts, items``: the rows of a batch (``pos``, text, other columns) in ``pos`` order."""
    return numbered.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("text"), *others))).alias("items"))


def with_prompts(batches: DataFrame, labels: Sequence[str], noun: str, nouns: str | None = None,
                 language: str = "Persian") -> DataFrame:
    """``batch_texts`` with its ``prompt``; no shuffle."""
    header, footer = prompt_parts(labels, noun, nouns, language)
    block = lambda x: F.concat(F.lit("Text "), x["pos"].cast("string"), F.lit(": "), x["text"], F.lit("\n\n"))
    blocks = F.array_sort(F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), block(x).alias("s"))))
    joined = F.array_join(F.transform(blocks, lambda x: x["s"]), "")
    return batches.withColumn("prompt", F.concat(F.lit(header), joined, F.lit(footer)))


def prompts(numbered: DataFrame, labels: Sequence[str], noun: str, nouns: str | None = None,
            language: str = "Persian", text: str = "text") -> DataFrame:
    """TXT-1: one prompt per batch: header, ``Text i: …`` blocks, JSON format footer."""
    out = with_prompts(batch_texts(numbered, text=text), labels, noun, nouns, language)
    return out.select("batch_no", "n_texts", "prompt")


def parse_body(body: Column, valid: Sequence[str], extract: bool = False) -> Column:
    """TXT-2 for one body: ``struct(usable, labels array<struct<key, label>>)``.

    usable = the (optionally extracted) body is a flat JSON object of strings; labels keep
    the last value per key, lower-cased, and only if it is a valid label. Time and stack do not
    depend on the number of entries or escapes other than by one sort.
    """
    b = F.regexp_extract(body, GREEDY_OBJECT, 1) if extract else body
    usable = F.coalesce(b.rlike(LINEAR_STRICT_OBJECT), F.lit(False))
    entries = F.map_entries(F.from_json(b, "map<string,string>"))
    # duplicate keys: sorted by key and last place first, the first of each key stays
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(
        e["key"].alias("key"), (-i).alias("place"), e["value"].alias("value"))))
    before = F.slice(F.concat(F.array(F.lit(None).cast("struct<key:string,place:int,value:string>")), placed), 1, F.size(placed))
    last = F.zip_with(placed, before, lambda e, b4: F.when(~e["key"].eqNullSafe(b4["key"]), F.struct(
        (-e["place"]).alias("place"), e["key"].alias("key"), F.lower(e["value"]).alias("label"))))
    kept = F.filter(last, lambda e: e.isNotNull() & e["label"].isin(list(valid)))
    kept = F.transform(F.array_sort(kept), lambda e: F.struct(e["key"].alias("key"), e["label"].alias("label")))
    empty = F.array().cast("array<struct<key:string,label:string>>")
    return F.struct(usable.alias("usable"), F.when(usable, kept).otherwise(empty).alias("labels"))


def parse_responses(responses: DataFrame, valid: Sequence[str], extract: bool = False,
                    body: str = "body") -> DataFrame:
    """TXT-2: ``batch_no, attempt, usable, key, label`` — one row per kept label (usable
    bodies with no valid label keep one row with null key/label)."""
    p = responses.withColumn("_p", parse_body(F.col(body), valid, extract))
    return p.select("batch_no", "attempt", F.col("_p.usable").alias("usable"),
                    F.explode_outer("_p.labels").alias("_e")) \
        .select("batch_no", "attempt", "usable", F.col("_e.key").alias("key"), F.col("_e.label").alias("label"))


def resolve_attempts(responses: DataFrame, valid: Sequence[str], extract: bool = False,
                     max_attempts: int = MAX_ATTEMPTS, body: str = "body") -> DataFrame:
    """TXT-3: per batch, the first usable attempt (<= max_attempts) and its labels
    (``batch_no, attempt, labels``); batches with no usable attempt get attempt null."""
    p = responses.filter(F.col("attempt") <= max_attempts).withColumn("_p", parse_body(F.col(body), valid, extract))
    return p.groupBy("batch_no").agg(
        F.min(F.when(F.col("_p.usable"), F.col("attempt"))).alias("attempt"),
        F.min_by(F.col("_p.labels"), F.when(F.col("_p.usable"), F.col("attempt"))).alias("labels"))


def write_back(numbered: DataFrame, resolved: DataFrame, pred: str = "predicted") -> DataFrame:
    """JN-3: labels into rows by (batch_no, pos); missing ids stay null, extra ids are
    ignored, existing predictions are never overwritten.  Adds ``new_label``."""
    lab = resolved.select("batch_no", F.explode("labels").alias("_e")) \
        .select("batch_no", F.col("_e.key").alias("_key"), F.col("_e.label").alias("new_label"))
    j = numbered.withColumn("_key", F.col("pos").cast("string")).join(lab, ["batch_no", "_key"], "left")
    return j.withColumn(pred, F.coalesce(F.col(pred), F.col("new_label"))).drop("_key")


def unlabelled(df: DataFrame, pred: str = "predicted") -> DataFrame:
    """FLT-7: rows still to label."""
    return df.filter(F.col(pred).isNull())


def progress(before: DataFrame, after: DataFrame, row_id: str, pred: str = "predicted") -> DataFrame:
    """AGG-27: rows to process, processed in this run, remaining (one pass over both states)."""
    both = (before.select(F.lit(True).alias("_b"), F.col(pred).isNull().alias("_null"))
            .unionByName(after.select(F.lit(False).alias("_b"), F.col(pred).isNull().alias("_null"))))
    out = both.agg(F.count_if(F.col("_b") & F.col("_null")).alias("to_process"),
                   F.count_if(~F.col("_b") & F.col("_null")).alias("remaining"))
    return out.select("to_process", (F.col("to_process") - F.col("remaining")).alias("processed"), "remaining")
