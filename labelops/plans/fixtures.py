"""Test inputs derived from the given tables, built by Spark (and, as SQL text, by the oracle).

Every derived table is a deterministic function of the driver tables: model
predictions, annotators, votes, review flags and labeller responses are made with
``h32`` hashes of row ids, so they grow with the data and are identical in both
engines.  ``SQL_*`` strings are the DuckDB twins used by ``oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelops.functions.text import NON_WS, WS, hkey
from labelops.operators import batches as B
from labelops.operators import clean as CL

# Label sets and model accuracies used to derive the fixtures.
LANGS = ["de", "en", "es", "fr"]
MODEL_HIT_PCT = {"Claude": 88, "DeepSeek": 84, "Gemini": 80, "GPT4o": 76}
MODELS = list(MODEL_HIT_PCT)
MODEL_FILES = {
    "Claude": "Claude_sentiment_results.csv",
    "DeepSeek": "DeepSeek_sentiment_results (1).csv",
    "Gemini": "Gemini_sentiment_results(2).csv",
    "GPT4o": "GPT4o_sentiment_results (2).csv",
}
QUALITY = ["good", "poor", "toxic"]
VOTE_COLUMNS_RAW = [" Anger", "Fear", "Happiness ", "Hatred", "Sadness", "Wonder"]
VOTE_COLUMNS = [c.strip().lower() for c in VOTE_COLUMNS_RAW]
BLANK_TEXT = "  　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- SQL helpers

def sh(expr: str) -> str:
    """SQL twin of ``h32``."""
    return f"(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT)"


def shk(*parts: str) -> str:
    """SQL twin of ``hkey``: parts are SQL expressions."""
    return sh("concat_ws('|', " + ", ".join(parts) + ")")


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def s_norm(x: str) -> str:
    return f"lower({s_strip(x)})"


def s_blank(x: str) -> str:
    return f"({x} IS NULL OR NOT regexp_matches({x}, '{NON_WS}'))"


def s_wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NON_WS}+'))"


def s_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def s_in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


# ---------------------------------------------------------------- documents

def docs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with null / blank texts and null labels mixed in (row_id = doc_id)."""
    d = table(spark, sf_dir, "documents")
    text = (F.when(hkey("null", F.col("doc_id")) % 50 == 0, F.lit(None).cast("string"))
            .when(hkey("blank", F.col("doc_id")) % 50 == 0, F.lit(BLANK_TEXT))
            .otherwise(F.col("text")))
    lang = F.when(hkey("nolang", F.col("doc_id")) % 40 == 0, F.lit(None).cast("string")).otherwise(F.col("lang"))
    return d.select("doc_id", text.alias("text"), lang.alias("lang"))


SQL_DOCS_RAW = f"""docs_raw AS (
  SELECT doc_id,
         CASE WHEN {shk("'null'", "doc_id")} % 50 = 0 THEN NULL
              WHEN {shk("'blank'", "doc_id")} % 50 = 0 THEN '{BLANK_TEXT}'
              ELSE text END AS text,
         CASE WHEN {shk("'nolang'", "doc_id")} % 40 = 0 THEN NULL ELSE lang END AS lang
  FROM documents)"""


def cleaned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.clean(docs_raw(spark, sf_dir), "text", "doc_id")


SQL_CLEANED = f"""cleaned AS (
  SELECT doc_id, text, lang FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM docs_raw)
  WHERE rn = 1 AND NOT {s_blank("text")} AND length(text) >= 10 AND {s_wc("text")} <= 100)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents deduplicated on text (first doc_id wins): the review / labelling corpus."""
    return CL.dedup_first(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "doc_id")


SQL_CORPUS = """corpus AS (
  SELECT doc_id, text, lang FROM (
    SELECT doc_id, text, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
  WHERE rn = 1)"""


# ---------------------------------------------------------------- predictions

def _shift(label_col, labels, by) -> F.Column:
    idx = F.array_position(F.array(*[F.lit(x) for x in labels]), label_col) - 1
    return F.element_at(F.array(*[F.lit(x) for x in labels]), ((idx + by) % len(labels) + 1).cast("int"))


def _s_shift(label: str, labels, by: str) -> str:
    return f"{s_list(labels)}[((list_position({s_list(labels)}, {label}) - 1 + {by}) % {len(labels)}) + 1]"


def preds_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, truth, <model>…`` — hash-made predictions of four labellers."""
    d = table(spark, sf_dir, "documents")
    truth = F.when(hkey("t", F.col("doc_id")) % 61 == 0, F.concat(F.initcap("lang"), F.lit(" "))) \
        .otherwise(F.col("lang"))
    cols = [F.col("doc_id"), F.col("text"), truth.alias("truth")]
    for m, pct in MODEL_HIT_PCT.items():
        base = F.when(hkey(m, F.col("doc_id")) % 100 < pct, F.col("lang")).otherwise(_shift(F.col("lang"), LANGS, 1))
        pred = (F.when(hkey("inv", m, F.col("doc_id")) % 97 == 0, F.lit("unknown"))
                .when(hkey("nul", m, F.col("doc_id")) % 89 == 0, F.lit(None).cast("string"))
                .when(hkey("case", m, F.col("doc_id")) % 23 == 0, F.concat(F.upper(base), F.lit(" ")))
                .otherwise(base))
        cols.append(pred.alias(m))
    return d.select(*cols)


def _sql_pred(m: str, pct: int) -> str:
    base = f"CASE WHEN {shk(f"'{m}'", 'doc_id')} % 100 < {pct} THEN lang ELSE {_s_shift('lang', LANGS, '1')} END"
    return (f"CASE WHEN {shk("'inv'", f"'{m}'", 'doc_id')} % 97 = 0 THEN 'unknown' "
            f"WHEN {shk("'nul'", f"'{m}'", 'doc_id')} % 89 = 0 THEN NULL "
            f"WHEN {shk("'case'", f"'{m}'", 'doc_id')} % 23 = 0 THEN upper({base}) || ' ' "
            f"ELSE {base} END AS \"{m}\"")


SQL_PREDS_WIDE = ("preds_wide AS (SELECT doc_id, text, "
                  f"CASE WHEN {shk("'t'", 'doc_id')} % 61 = 0 THEN upper(substr(lang, 1, 1)) || substr(lang, 2) || ' ' "
                  "ELSE lang END AS truth, "
                  + ", ".join(_sql_pred(m, p) for m, p in MODEL_HIT_PCT.items()) + " FROM documents)")

SQL_PREDS_LONG = ("preds_long AS (" + " UNION ALL ".join(
    f"SELECT doc_id, text, truth, '{m}' AS model, \"{m}\" AS predicted FROM preds_wide" for m in MODELS) + ")")


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-model result files as one long frame with a ``source_file`` column.

    DeepSeek's file misses a few rows, Gemini's has a few other truths, GPT4o's a few altered texts, and one file
    belongs to no model.
    """
    w = preds_wide(spark, sf_dir)
    parts = []
    for m in MODELS:
        f = w.select("doc_id", "text", "truth", F.col(m).alias("predicted"))
        if m == "DeepSeek":
            f = f.filter(hkey("miss", F.col("doc_id")) % 211 != 0)
        if m == "Gemini":
            f = f.withColumn("truth", F.when(hkey("other", F.col("doc_id")) % 103 == 0, F.lit("xx")).otherwise(F.col("truth")))
        if m == "GPT4o":
            f = f.withColumn("text", F.when(hkey("txt", F.col("doc_id")) % 101 == 0, F.concat("text", F.lit(" ")))
                             .otherwise(F.col("text")))
        parts.append(f.withColumn("source_file", F.lit(MODEL_FILES[m])))
    extra = w.select("doc_id", "text", "truth", F.col("Claude").alias("predicted")) \
        .withColumn("source_file", F.lit("notes (3).csv"))
    out = parts[0]
    for p in parts[1:] + [extra]:
        out = out.unionByName(p)
    return out


SQL_MODEL_FILES = "model_files AS (" + " UNION ALL ".join(
    [f"SELECT doc_id, text, truth, \"Claude\" AS predicted, '{MODEL_FILES['Claude']}' AS source_file FROM preds_wide",
     f"SELECT doc_id, text, truth, \"DeepSeek\", '{MODEL_FILES['DeepSeek']}' FROM preds_wide "
     f"WHERE {shk("'miss'", 'doc_id')} % 211 <> 0",
     f"SELECT doc_id, text, CASE WHEN {shk("'other'", 'doc_id')} % 103 = 0 THEN 'xx' ELSE truth END, \"Gemini\", "
     f"'{MODEL_FILES['Gemini']}' FROM preds_wide",
     f"SELECT doc_id, CASE WHEN {shk("'txt'", 'doc_id')} % 101 = 0 THEN text || ' ' ELSE text END, truth, "
     f"\"GPT4o\", '{MODEL_FILES['GPT4o']}' FROM preds_wide",
     "SELECT doc_id, text, truth, \"Claude\", 'notes (3).csv' FROM preds_wide"]) + ")"


# ---------------------------------------------------------------- annotations

def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels -> ground truth + two hash-made annotators + consensus (row_id = doc_id)."""
    lab = table(spark, sf_dir, "labels")
    gt = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    a = lab.select("doc_id", gt.alias("ground_truth"))
    a1 = F.when(hkey("a1", F.col("doc_id")) % 100 < 12,
                _shift(F.col("ground_truth"), QUALITY, 1 + hkey("a1n", F.col("doc_id")) % 2)) \
        .otherwise(F.col("ground_truth"))
    a2 = F.when(hkey("a2", F.col("doc_id")) % 100 < 22,
                _shift(F.col("ground_truth"), QUALITY, 1 + hkey("a2n", F.col("doc_id")) % 2)) \
        .otherwise(F.col("ground_truth"))
    a = a.withColumn("annotator1", a1).withColumn("annotator2", a2)
    a2_raw = F.when(hkey("up", F.col("doc_id")) % 13 == 0, F.concat(F.upper("annotator2"), F.lit(" "))) \
        .otherwise(F.col("annotator2"))
    cons = (F.when(F.col("annotator1") == F.col("annotator2"), F.col("annotator1"))
            .when(hkey("c", F.col("doc_id")) % 10 < 5, F.col("annotator1"))
            .when(hkey("c", F.col("doc_id")) % 10 < 9, F.col("annotator2"))
            .otherwise(F.col("ground_truth")))
    return a.withColumn("consensus", cons).withColumn("annotator2", a2_raw)


SQL_ANNOTATIONS = f"""ann0 AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS ground_truth
  FROM labels),
ann1 AS (
  SELECT doc_id, ground_truth,
    CASE WHEN {shk("'a1'", 'doc_id')} % 100 < 12
         THEN {_s_shift('ground_truth', QUALITY, f"1 + {shk("'a1n'", 'doc_id')} % 2")} ELSE ground_truth END AS annotator1,
    CASE WHEN {shk("'a2'", 'doc_id')} % 100 < 22
         THEN {_s_shift('ground_truth', QUALITY, f"1 + {shk("'a2n'", 'doc_id')} % 2")} ELSE ground_truth END AS annotator2
  FROM ann0),
annotations AS (
  SELECT doc_id, ground_truth, annotator1,
    CASE WHEN {shk("'up'", 'doc_id')} % 13 = 0 THEN upper(annotator2) || ' ' ELSE annotator2 END AS annotator2,
    CASE WHEN annotator1 = annotator2 THEN annotator1
         WHEN {shk("'c'", 'doc_id')} % 10 < 5 THEN annotator1
         WHEN {shk("'c'", 'doc_id')} % 10 < 9 THEN annotator2
         ELSE ground_truth END AS consensus
  FROM ann1)"""


# ---------------------------------------------------------------- votes

def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + six vote columns (0..5) with raw, untidy names."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", *[
        (hkey(c.strip().lower(), F.col("doc_id")) % 6).cast("int").alias(c) for c in VOTE_COLUMNS_RAW])


SQL_VOTES = "votes AS (SELECT doc_id, text, " + ", ".join(
    f"CAST({shk(f"'{c}'", 'doc_id')} % 6 AS INTEGER) AS {c}" for c in VOTE_COLUMNS) + " FROM documents)"
SQL_VOTES_OVER = "(" + " + ".join(f"CAST({c} >= 3 AS INTEGER)" for c in VOTE_COLUMNS) + ")"
SQL_DOMINANT = "CASE " + " ".join(f"WHEN {c} >= 3 THEN '{c}'" for c in VOTE_COLUMNS) + " END"


# ---------------------------------------------------------------- batches, flags, responses

def review_numbered(spark: SparkSession, sf_dir: str, size: int = B.REVIEW_BATCH) -> DataFrame:
    return B.batch_numbers(corpus(spark, sf_dir), "doc_id", size)


SQL_NUMBERED = """numbered AS (
  SELECT doc_id, text, lang,
         CAST(ceil(rn / {size}) AS BIGINT) AS batch_no, CAST((rn - 1) % {size} + 1 AS INTEGER) AS pos
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM corpus))"""


def review_flags(numbered: DataFrame) -> DataFrame:
    """Hash-made review flags: (batch_no, pos) for every batch, positions 1..100 (so the
    short last batch gets out-of-range flags); every third batch has none."""
    b = numbered.select("batch_no").distinct()
    p = b.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(B.REVIEW_BATCH))))
    return p.filter((hkey("flag", F.col("batch_no"), F.col("pos")) % 17 == 0) & (F.col("batch_no") % 3 != 0))


SQL_FLAGS = f"""flags AS (
  SELECT batch_no, CAST(pos AS INTEGER) AS pos
  FROM (SELECT DISTINCT batch_no FROM numbered) b, (SELECT unnest(range(1, {B.REVIEW_BATCH + 1})) AS pos) p
  WHERE {shk("'flag'", 'batch_no', 'pos')} % 17 = 0 AND batch_no % 3 <> 0)"""

SQL_FLAGGED = """flagged AS (
  SELECT n.doc_id, n.text, n.lang, n.batch_no, n.pos, (f.batch_no IS NOT NULL) AS flagged
  FROM numbered n LEFT JOIN flags f ON n.batch_no = f.batch_no AND n.pos = f.pos)"""


def label_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelling corpus in batches of 20, with a prediction column where an earlier run
    already labelled some rows."""
    n = B.batch_numbers(corpus(spark, sf_dir), "doc_id", B.LABEL_BATCH)
    return n.withColumn("predicted", F.when(hkey("prev", F.col("doc_id")) % 5 == 0, F.col("lang")))


SQL_LABEL_NUMBERED = SQL_NUMBERED.replace("numbered AS", "lnumbered0 AS").format(size=B.LABEL_BATCH) + f""",
lnumbered AS (
  SELECT *, CASE WHEN {shk("'prev'", 'doc_id')} % 5 = 0 THEN lang END AS predicted FROM lnumbered0)"""


def responses(numbered: DataFrame) -> DataFrame:
    """Hash-made labeller responses ``batch_no, attempt, body``: three attempts per batch,
    some broken (not JSON, an array, a number value, text around the object)."""
    lab = (F.when(hkey("lab", F.col("doc_id")) % 11 == 0, F.upper("lang"))
           .when(hkey("lab", F.col("doc_id")) % 11 == 1, F.lit("mixed"))
           .otherwise(F.col("lang")))
    item = F.concat(F.lit('"'), F.col("pos").cast("string"), F.lit('": "'), lab, F.lit('"'))
    per = numbered.groupBy("batch_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("s")))),
                                 lambda x: x["s"]), ", ").alias("_items"))
    obj = F.concat(F.lit("{"), F.col("_items"), F.lit("}"))
    att = per.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
    kind = hkey("kind", F.col("batch_no"), F.col("attempt")) % 10
    body = (F.when(kind == 0, F.lit("not json"))
            .when(kind == 1, F.lit('["en"]'))
            .when(kind == 2, F.lit('{"1": 3, "2": "en"}'))
            .when(kind == 3, F.concat(F.lit("Sure: "), obj, F.lit(" done")))
            .otherwise(obj))
    return att.select("batch_no", F.col("attempt").cast("int").alias("attempt"), body.alias("body"))


SQL_RESPONSES = f"""resp_items AS (
  SELECT batch_no, string_agg('"' || pos || '": "' ||
           CASE WHEN {shk("'lab'", 'doc_id')} % 11 = 0 THEN upper(lang)
                WHEN {shk("'lab'", 'doc_id')} % 11 = 1 THEN 'mixed' ELSE lang END || '"', ', ' ORDER BY pos) AS items
  FROM lnumbered GROUP BY batch_no),
responses AS (
  SELECT batch_no, CAST(attempt AS INTEGER) AS attempt,
    CASE {shk("'kind'", 'batch_no', 'attempt')} % 10
      WHEN 0 THEN 'not json' WHEN 1 THEN '["en"]' WHEN 2 THEN '{{"1": 3, "2": "en"}}'
      WHEN 3 THEN 'Sure: {{' || items || '}} done'
      ELSE '{{' || items || '}}' END AS body
  FROM resp_items, (SELECT unnest(range(1, 4)) AS attempt) a)"""
