"""Registered queries: one Spark plan per operator of the inventory, each with an
independent DuckDB SQL twin (``oracle``) where the operator is expressible in SQL.

Every query reads the given tables (or frames Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelops.functions.text import preview, word_count
from labelops.operators import agree as AG
from labelops.operators import batches as B
from labelops.operators import bootstrap as BS
from labelops.operators import cells as C
from labelops.operators import clean as CL
from labelops.operators import compare as CP
from labelops.operators import labels as L
from labelops.operators import profile as P
from labelops.operators import sample as S
from labelops.plans import bootstrap_sql as BQ
from labelops.plans import fixtures as X
from labelops.plans.fixtures import (s_blank, s_in, s_norm, s_wc, sh, shk, table)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
        return fn
    return deco


D, CLN, CORP = X.SQL_DOCS_RAW, X.SQL_CLEANED, X.SQL_CORPUS
PW, PL = X.SQL_PREDS_WIDE, X.SQL_PREDS_LONG
LANGS, MODELS, QUALITY = X.LANGS, X.MODELS, X.QUALITY

# ================================================================ projections

def _orders_raw(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("Unnamed: 0"), "o_orderkey", "o_custkey", "o_orderstatus",
                    F.col("o_orderkey").alias("Unnamed: 0.1"))


@query("drop_unnamed", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def q_drop_unnamed(spark, sf):
    return L.drop_unnamed(_orders_raw(spark, sf))


@query("positional_project", "SELECT o_orderkey, o_orderstatus FROM orders")
def q_positional_project(spark, sf):
    return L.positional_project(_orders_raw(spark, sf), [1, 3])


@query("rename_cols", "SELECT o_orderkey, o_orderstatus AS status FROM orders")
def q_rename_cols(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias(" O_OrderKey "),
                                          F.col("o_orderstatus").alias("O_OrderStatus "))
    return L.rename(L.normalise_names(o), {"o_orderstatus": "status"})


def _codes(spark, sf):
    lab = table(spark, sf, "labels")
    code = F.when(X.hkey("code", F.col("doc_id")) % 9 == 0, F.lit(2.0)) \
        .otherwise((F.col("quality") - F.col("toxic")).cast("double"))
    return lab.select("doc_id", code.alias("code"))


SQL_CODES = f"""codes AS (SELECT doc_id, CASE WHEN {shk("'code'", 'doc_id')} % 9 = 0 THEN 2.0::DOUBLE
                          ELSE CAST(quality - toxic AS DOUBLE) END AS code FROM labels)"""
SQL_CODE_MAP = "CASE code WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' WHEN -1 THEN 'negative' END"


@query("value_map", f"SELECT doc_id, code, {SQL_CODE_MAP} AS label FROM codes", (SQL_CODES,))
def q_value_map(spark, sf):
    c = _codes(spark, sf)
    return c.withColumn("label", L.map_values("code", L.SENTIMENT_CODES))


@query("unmapped_count", f"SELECT count(*) FILTER (WHERE {SQL_CODE_MAP} IS NULL) AS n_unmapped, "
       "count(*) AS n_total FROM codes", (SQL_CODES,))
def q_unmapped_count(spark, sf):
    return L.unmapped_count(q_value_map(spark, sf), "label")


def _events_raw(spark, sf):
    e = table(spark, sf, "events")
    k = X.hkey("case", F.col("event_id")) % 3
    raw = F.when(k == 0, F.upper("event_type")).when(k == 1, F.concat(F.lit(" "), "event_type", F.lit(" "))) \
        .otherwise(F.col("event_type"))
    return e.select("event_id", raw.alias("raw_type"))


SQL_EVENTS_RAW = f"""events_raw AS (SELECT event_id,
  CASE {shk("'case'", 'event_id')} % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN ' ' || event_type || ' '
       ELSE event_type END AS raw_type FROM events)"""
# Example open map for event types (unmapped types pass through).
EVENT_MAP = {"click": "engagement", "view": "engagement", "purchase": "conversion"}


@query("value_replace", f"""SELECT event_id, raw_type,
  CASE {s_norm('raw_type')} WHEN 'click' THEN 'engagement' WHEN 'view' THEN 'engagement'
       WHEN 'purchase' THEN 'conversion' ELSE {s_norm('raw_type')} END AS label FROM events_raw""", (SQL_EVENTS_RAW,))
def q_value_replace(spark, sf):
    return _events_raw(spark, sf).withColumn("label", L.replace_values("raw_type", EVENT_MAP))


@query("normalise_label", f"SELECT event_id, {s_norm('raw_type')} AS label FROM events_raw", (SQL_EVENTS_RAW,))
def q_normalise_label(spark, sf):
    return _events_raw(spark, sf).select("event_id", L.norm_label("raw_type").alias("label"))


@query("add_missing_cols", "SELECT doc_id, false AS is_ecommerce, CAST(NULL AS VARCHAR) AS predicted FROM documents")
def q_add_missing_cols(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return L.add_missing(d, {"is_ecommerce": False, "predicted": None}, {"predicted": "string"})


@query("placeholder_label", "SELECT doc_id, 'unknown' AS label FROM documents")
def q_placeholder_label(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return L.require_text(d, "text", "label").select("doc_id", "label")


@query("text_preview", "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' "
       "ELSE text END AS preview FROM documents")
def q_text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", preview("text", 50).alias("preview"))


# ================================================================ filters

@query("drop_blank", f"SELECT doc_id, lang FROM docs_raw WHERE NOT {s_blank('text')}", (D,))
def q_drop_blank(spark, sf):
    return CL.drop_blank(X.docs_raw(spark, sf)).select("doc_id", "lang")


@query("min_chars", "SELECT doc_id FROM docs_raw WHERE length(text) >= 10", (D,))
def q_min_chars(spark, sf):
    return CL.min_chars(X.docs_raw(spark, sf)).select("doc_id")


@query("word_limit", f"SELECT doc_id, CAST({s_wc('text')} AS INTEGER) AS n_words FROM docs_raw "
       f"WHERE {s_wc('text')} <= 100", (D,))
def q_word_limit(spark, sf):
    return CL.word_limit(X.docs_raw(spark, sf)).select("doc_id", word_count("text").cast("int").alias("n_words"))


@query("drop_category", "SELECT doc_id, lang FROM docs_raw WHERE lang IS DISTINCT FROM 'en'", (D,))
def q_drop_category(spark, sf):
    return CL.drop_category(X.docs_raw(spark, sf), "lang", "en").select("doc_id", "lang")


@query("valid_labels", "SELECT doc_id, " + ", ".join(
    [f"{s_norm('truth')} AS truth"] + [f"{s_norm(chr(34) + m + chr(34))} AS \"{m}\"" for m in MODELS])
    + " FROM preds_wide WHERE " + " AND ".join(
    f"{s_norm(c)} IN {s_in(LANGS)}" for c in ["truth"] + [f'"{m}"' for m in MODELS]), (PW,))
def q_valid_labels(spark, sf):
    w = X.preds_wide(spark, sf).drop("text")
    return L.valid_rows(w, ["truth", *MODELS], LANGS)


@query("valid_predictions", f"SELECT doc_id, model, predicted FROM preds_long WHERE predicted IN {s_in(LANGS)}",
       (PW, PL))
def q_valid_predictions(spark, sf):
    return L.valid_predictions(_preds_long(spark, sf), "predicted", LANGS).select("doc_id", "model", "predicted")


def _preds_long(spark, sf):
    return CP.to_long(X.preds_wide(spark, sf).drop("text"), MODELS, "doc_id", "truth")


# ================================================================ dedup, union, funnel

@query("dedup_first", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER "
       "(PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def q_dedup_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return CL.dedup_first(d, "text", "doc_id").select("doc_id", "lang")


@query("union_sources", """SELECT source_file, count(*) AS n_rows,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS share_pct FROM (
  SELECT 'part_a.tsv' AS source_file FROM documents WHERE lang IN ('de', 'en')
  UNION ALL SELECT 'part_b.tsv' FROM documents WHERE lang IN ('en', 'es', 'fr')) GROUP BY source_file""")
def q_union_sources(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    u = CL.union_sources({"part_a.tsv": d.filter(F.col("lang").isin("de", "en")),
                          "part_b.tsv": d.filter(F.col("lang").isin("en", "es", "fr"))})
    return CL.source_shares(u)


def _sql_funnel(order, remaining_form: bool) -> str:
    rule = {"blank": f"WHEN {s_blank('text')} THEN 'blank'",
            "duplicate": "WHEN rn > 1 THEN 'duplicate'",
            "too_short": "WHEN length(text) < 10 THEN 'too_short'",
            "too_long": f"WHEN {s_wc('text')} > 100 THEN 'too_long'"}
    case = "CASE " + " ".join(rule[r] for r in order) + " ELSE 'kept' END"
    steps = ", ".join(f"({i}, '{r}')" for i, r in enumerate(order, 1))
    base = f""", rules AS (SELECT {case} AS rule FROM (
  SELECT text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM docs_raw)),
tot AS (SELECT count(*) AS n_total FROM rules),
steps AS (SELECT s.step_no, s.step, CAST(count(r.rule) AS BIGINT) AS removed
  FROM (VALUES {steps}) s(step_no, step) LEFT JOIN rules r ON r.rule = s.step GROUP BY s.step_no, s.step)"""
    if not remaining_form:
        return base + """
SELECT CAST(step_no AS INTEGER) AS step_no, step, removed,
       CAST((SELECT n_total FROM tot) - sum(removed) OVER (ORDER BY step_no) AS BIGINT) AS remaining FROM steps"""
    return base + """,
rem AS (SELECT CAST(step_no AS INTEGER) AS step_no, step,
  CAST((SELECT n_total FROM tot) - sum(removed) OVER (ORDER BY step_no) AS BIGINT) AS remaining FROM steps
  UNION ALL SELECT 0, 'original', (SELECT n_total FROM tot))
SELECT step_no, step, remaining,
  round(coalesce(remaining * 100.0 / nullif((SELECT n_total FROM tot), 0), 0), 4)::DOUBLE AS pct_of_original FROM rem"""


@query("clean_funnel", _sql_funnel(CL.DUPLICATE_FIRST, False), (D,))
def q_clean_funnel(spark, sf):
    c = CL.classify(X.docs_raw(spark, sf), "text", "doc_id", CL.DUPLICATE_FIRST)
    return CL.funnel(c, CL.DUPLICATE_FIRST)


@query("clean_funnel_remaining", _sql_funnel(CL.BLANK_FIRST, True), (D,))
def q_clean_funnel_remaining(spark, sf):
    c = CL.classify(X.docs_raw(spark, sf), "text", "doc_id", CL.BLANK_FIRST)
    return CL.funnel_remaining(c, CL.BLANK_FIRST)


@query("size_change", """SELECT n_before, n_after, n_before - n_after AS removed,
  round(coalesce((n_before - n_after) * 100.0 / nullif(n_before, 0), 0), 4)::DOUBLE AS removed_pct
  FROM (SELECT (SELECT count(*) FROM docs_raw) AS n_before, (SELECT count(*) FROM cleaned) AS n_after)""", (D, CLN))
def q_size_change(spark, sf):
    return CL.size_change(X.docs_raw(spark, sf), X.cleaned_docs(spark, sf))


# ================================================================ profiles

SQL_DIST = """SELECT lang AS label, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM {src} GROUP BY lang
  QUALIFY lang IS NOT NULL"""


@query("label_distribution", SQL_DIST.format(src="cleaned"), (D, CLN))
def q_label_distribution(spark, sf):
    return P.label_distribution(X.cleaned_docs(spark, sf), "lang")


@query("label_distribution_raw", SQL_DIST.format(src="docs_raw"), (D,))
def q_label_distribution_raw(spark, sf):
    return P.label_distribution(X.docs_raw(spark, sf), "lang")


@query("distribution_change", """SELECT label, n_before,
  round(coalesce(n_before * 100.0 / nullif(tb, 0), 0), 4)::DOUBLE AS pct_before, n_after,
  round(coalesce(n_after * 100.0 / nullif(ta, 0), 0), 4)::DOUBLE AS pct_after,
  round(round(coalesce(n_after * 100.0 / nullif(ta, 0), 0), 4) - round(coalesce(n_before * 100.0 / nullif(tb, 0), 0), 4), 4)::DOUBLE AS change_pp
FROM (SELECT label, count(*) FILTER (WHERE b) AS n_before, count(*) FILTER (WHERE NOT b) AS n_after,
        sum(count(*) FILTER (WHERE b)) OVER () AS tb, sum(count(*) FILTER (WHERE NOT b)) OVER () AS ta
      FROM (SELECT lang AS label, true AS b FROM docs_raw UNION ALL SELECT lang, false FROM cleaned)
      GROUP BY label) WHERE label IS NOT NULL""", (D, CLN))
def q_distribution_change(spark, sf):
    return P.distribution_change(X.docs_raw(spark, sf), X.cleaned_docs(spark, sf), "lang")


@query("dataset_card", """SELECT (SELECT count(*) FROM cleaned) AS n_total,
  (SELECT count(DISTINCT lang) FROM cleaned) AS n_labels,
  (SELECT lang FROM cleaned WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) AS top_label,
  (SELECT count(*) FROM cleaned WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC LIMIT 1) AS top_count""",
       (D, CLN))
def q_dataset_card(spark, sf):
    return P.dataset_card(X.cleaned_docs(spark, sf), "lang")


@query("validation_header", f"""SELECT count(*) AS n_loaded, count(*) FILTER (WHERE t IN {s_in(LANGS)}) AS n_valid,
  count(DISTINCT t) FILTER (WHERE t IN {s_in(LANGS)}) AS n_classes FROM (SELECT {s_norm('truth')} AS t FROM preds_wide)""", (PW,))
def q_validation_header(spark, sf):
    t = X.preds_wide(spark, sf).select(L.norm_label("truth").alias("t"))
    ok = F.col("t").isin(LANGS)
    return t.agg(F.count(F.lit(1)).alias("n_loaded"), F.count_if(ok).alias("n_valid"),
                 F.count_distinct(F.when(ok, F.col("t"))).alias("n_classes"))


# ================================================================ sampling

def _sql_rank(src: str, n: int, seed, by: str | None = None, cols: str = "doc_id") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (f"SELECT {cols}, CAST(ord AS BIGINT) AS ord FROM (SELECT *, row_number() OVER ({part}ORDER BY "
            f"md5('{seed}|' || doc_id), doc_id) AS ord FROM {src}) WHERE ord <= {n}")


@query("sample_simple", _sql_rank("documents", 150, 42))
def q_sample_simple(spark, sf):
    return S.sample_simple(table(spark, sf, "documents"), 150, "doc_id").select("doc_id", "ord")


@query("sample_cap", _sql_rank("documents", 500, 42))
def q_sample_cap(spark, sf):
    return S.sample_cap(table(spark, sf, "documents"), 500, "doc_id").select("doc_id", "ord")


BAL_CLASSES, BAL_N = ["de", "en", "fr"], 130
SQL_BALANCED = ("balanced AS (" + _sql_rank(f"corpus WHERE lang IN {s_in(BAL_CLASSES)}", BAL_N, 42, "lang",
                                            "doc_id, text, lang") + ")")


def _balanced(spark, sf):
    return S.sample_balanced(X.corpus(spark, sf), "lang", BAL_CLASSES, BAL_N, "doc_id")


@query("sample_balanced", "SELECT doc_id, lang, ord FROM balanced", (CORP, SQL_BALANCED))
def q_sample_balanced(spark, sf):
    return _balanced(spark, sf).select("doc_id", "lang", "ord")


@query("sample_shortfall", f"""SELECT c.label, coalesce(a.n, 0) AS available, CAST({BAL_N} AS BIGINT) AS requested,
  CAST(least(coalesce(a.n, 0), {BAL_N}) AS BIGINT) AS taken, CAST(greatest({BAL_N} - coalesce(a.n, 0), 0) AS BIGINT) AS shortfall
  FROM (SELECT unnest({X.s_list(BAL_CLASSES)}) AS label) c
  LEFT JOIN (SELECT lang, count(*) AS n FROM corpus GROUP BY lang) a ON a.lang = c.label""", (CORP,))
def q_sample_shortfall(spark, sf):
    return S.sample_shortfall(X.corpus(spark, sf), "lang", BAL_CLASSES, BAL_N)


SQL_SHUFFLED = ("shuffled AS (SELECT doc_id, text, CAST(row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) "
                "AS BIGINT) AS ord FROM balanced)")


def _shuffled(spark, sf):
    return S.shuffle_order(_balanced(spark, sf).drop("ord"), "doc_id", 7)


@query("sample_shuffle", "SELECT doc_id, ord FROM shuffled", (CORP, SQL_BALANCED, SQL_SHUFFLED))
def q_sample_shuffle(spark, sf):
    return _shuffled(spark, sf).select("doc_id", "ord")


def _sql_sorted(src: str) -> str:
    return f"""(SELECT md5(string_agg(c, '' ORDER BY p)) AS checksum, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT substr(p, 1, 4) AS p, md5(string_agg(c, '' ORDER BY p)) AS c, sum(n) AS n FROM (
    SELECT substr(h, 1, 8) AS p, md5(string_agg(h || ':' || n, '' ORDER BY h)) AS c, sum(n) AS n FROM (
      SELECT md5(text) AS h, count(*) AS n FROM {src} GROUP BY 1) GROUP BY 1) GROUP BY 1))"""


@query("checksum_sorted", "SELECT * FROM " + _sql_sorted("balanced"), (CORP, SQL_BALANCED))
def q_checksum_sorted(spark, sf):
    return S.checksum(_balanced(spark, sf), "text")


def _sql_chunks(src: str, levels: int) -> str:
    if not levels:
        return f"(SELECT CAST(ord - 1 AS BIGINT) AS c, md5(text) AS d, 1 AS n FROM {src})"
    return (f"(SELECT c // 65536 AS c, md5(string_agg(d, '' ORDER BY c)) AS d, sum(n) AS n FROM "
            f"{_sql_chunks(src, levels - 1)} GROUP BY c // 65536)")


@query("checksum_ordered", "SELECT md5(string_agg(d, '' ORDER BY c)) AS checksum, CAST(sum(n) AS BIGINT) AS n_rows "
       "FROM " + _sql_chunks("shuffled", 3), (CORP, SQL_BALANCED, SQL_SHUFFLED))
def q_checksum_ordered(spark, sf):
    return S.checksum(_shuffled(spark, sf), "text", "ord")


@query("fingerprint", f"SELECT count(*) AS n_rows, CAST(sum({sh(chr(39) + chr(39) + ' || doc_id || ' + chr(39) + '|' + chr(39) + ' || text')}) AS BIGINT) "
       "AS hash_sum FROM balanced", (CORP, SQL_BALANCED))
def q_fingerprint(spark, sf):
    return S.fingerprint(_balanced(spark, sf), "text", "doc_id")


@query("checksum_check", f"""SELECT variant, checksum, expected, CASE WHEN variant = 'same' THEN 'PASS' ELSE 'FAIL' END
  AS status FROM (SELECT 'same' AS variant, checksum FROM {_sql_sorted('balanced')}
  UNION ALL SELECT 'changed', checksum FROM {_sql_sorted(
    "(SELECT CASE WHEN ord = 1 AND lang = 'de' THEN text || '.' ELSE text END AS text FROM balanced)")}),
  (SELECT checksum AS expected FROM {_sql_sorted('balanced')})""", (CORP, SQL_BALANCED))
def q_checksum_check(spark, sf):
    """The stored checksum of a sample against the sample drawn again and against one altered text."""
    same = _balanced(spark, sf).select("text", "lang", "ord")
    one = (F.col("ord") == 1) & (F.col("lang") == "de")
    changed = same.withColumn("text", F.when(one, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    variants = same.withColumn("variant", F.lit("same")).unionByName(changed.withColumn("variant", F.lit("changed")))
    return S.checksum_check(S.checksum(variants, "text", keys=["variant"]), S.checksum(same, "text"))


# ================================================================ votes

@query("dominant_label", f"SELECT doc_id, {X.SQL_DOMINANT} AS label FROM votes", (X.SQL_VOTES,))
def q_dominant_label(spark, sf):
    v = L.normalise_names(X.votes(spark, sf))
    return v.select("doc_id", L.dominant_label(X.VOTE_COLUMNS).alias("label"))


@query("votes_single_label", f"SELECT doc_id, {X.SQL_DOMINANT} AS label FROM votes WHERE {X.SQL_VOTES_OVER} = 1",
       (X.SQL_VOTES,))
def q_votes_single_label(spark, sf):
    v = L.normalise_names(X.votes(spark, sf))
    return L.single_label_rows(v, X.VOTE_COLUMNS).select("doc_id", "label")


@query("votes_histogram", f"SELECT CASE WHEN k >= 2 THEN '2+' ELSE CAST(k AS VARCHAR) END AS labels_over, "
       f"count(*) AS n FROM (SELECT {X.SQL_VOTES_OVER} AS k FROM votes) GROUP BY 1", (X.SQL_VOTES,))
def q_votes_histogram(spark, sf):
    return L.vote_histogram(L.normalise_names(X.votes(spark, sf)), X.VOTE_COLUMNS)


# ================================================================ review batches

NUMB = X.SQL_NUMBERED.format(size=B.REVIEW_BATCH)


def _flagged(spark, sf):
    n = X.review_numbered(spark, sf)
    return B.apply_flags(n, X.review_flags(n))


@query("batch_numbers", "SELECT doc_id, batch_no, pos FROM numbered", (CORP, NUMB))
def q_batch_numbers(spark, sf):
    return X.review_numbered(spark, sf).select("doc_id", "batch_no", "pos")


@query("apply_flags", "SELECT doc_id, batch_no, pos, flagged FROM flagged", (CORP, NUMB, X.SQL_FLAGS, X.SQL_FLAGGED))
def q_apply_flags(spark, sf):
    return _flagged(spark, sf).select("doc_id", "batch_no", "pos", "flagged")


@query("drop_flagged", "SELECT doc_id, lang FROM flagged WHERE NOT flagged",
       (CORP, NUMB, X.SQL_FLAGS, X.SQL_FLAGGED))
def q_drop_flagged(spark, sf):
    return B.drop_flagged(_flagged(spark, sf)).select("doc_id", "lang")


@query("batch_coverage", f"""SELECT count(*) AS n_rows, count(DISTINCT batch_no) AS total_batches,
  count(DISTINCT batch_no) FILTER (WHERE flagged) AS batches_with_flags,
  CAST(count(*) FILTER (WHERE flagged) AS BIGINT) AS total_flags,
  count(DISTINCT batch_no) - count(DISTINCT batch_no) FILTER (WHERE flagged) AS batches_without_flags,
  CAST(ceil(count(*) / {B.REVIEW_BATCH}) AS BIGINT) AS expected_batches FROM flagged""",
       (CORP, NUMB, X.SQL_FLAGS, X.SQL_FLAGGED))
def q_batch_coverage(spark, sf):
    return B.batch_coverage(_flagged(spark, sf))


@query("batches_unflagged", "SELECT DISTINCT batch_no FROM numbered WHERE batch_no NOT IN "
       "(SELECT batch_no FROM flagged WHERE flagged)", (CORP, NUMB, X.SQL_FLAGS, X.SQL_FLAGGED))
def q_batches_unflagged(spark, sf):
    return B.batches_unflagged(_flagged(spark, sf))


@query("review_sheet", "SELECT batch_no, count(*) AS n_texts, string_agg(pos || '. ' || text, chr(10) || chr(10) "
       "ORDER BY pos) AS sheet FROM numbered GROUP BY batch_no", (CORP, NUMB))
def q_review_sheet(spark, sf):
    return B.review_sheet(X.review_numbered(spark, sf))


@query("sample_examples", f"SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text "
       f"END AS preview, ord FROM ({_sql_rank('flagged WHERE flagged', 5, 42, None, 'doc_id, text')})",
       (CORP, NUMB, X.SQL_FLAGS, X.SQL_FLAGGED))
def q_sample_examples(spark, sf):
    f = _flagged(spark, sf).filter("flagged")
    return S.sample_cap(f, 5, "doc_id").select("doc_id", preview("text", 100).alias("preview"), "ord")


# ================================================================ labelling

LNUM = X.SQL_LABEL_NUMBERED
HEADER, FOOTER = B.prompt_parts(LANGS, "language", language="document")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("prompts", f"SELECT batch_no, count(*) AS n_texts, {_sql_str(HEADER)} || string_agg('Text ' || pos || ': ' "
       f"|| text || chr(10) || chr(10), '' ORDER BY pos) || {_sql_str(FOOTER)} AS prompt FROM lnumbered "
       "GROUP BY batch_no", (CORP, LNUM))
def q_prompts(spark, sf):
    return B.prompts(X.label_numbered(spark, sf), LANGS, "language", language="document")


_S_RE = r'"[^"\\]*(?:\\.[^"\\]*)*"'
SQL_PARSED = f"""parsed0 AS (
  SELECT batch_no, attempt, coalesce(regexp_matches(body, '{B.STRICT_OBJECT}'), false) AS usable,
         regexp_extract_all(body, '{_S_RE}') AS strs FROM responses),
pairs AS (
  SELECT batch_no, attempt, i,
         json_extract_string(CAST(strs[2 * i - 1] AS JSON), '$') AS key,
         lower(json_extract_string(CAST(strs[2 * i] AS JSON), '$')) AS label
  FROM (SELECT *, unnest(range(1, CAST(len(strs) / 2 AS BIGINT) + 1)) AS i FROM parsed0 WHERE usable)),
lastpairs AS (
  SELECT batch_no, attempt, key, label FROM (
    SELECT *, row_number() OVER (PARTITION BY batch_no, attempt, key ORDER BY i DESC) AS r FROM pairs)
  WHERE r = 1 AND label IN {s_in(LANGS)}),
parsed AS (
  SELECT p.batch_no, p.attempt, p.usable, l.key, l.label FROM parsed0 p
  LEFT JOIN lastpairs l ON l.batch_no = p.batch_no AND l.attempt = p.attempt AND p.usable)"""


def _responses(spark, sf):
    return X.responses(X.label_numbered(spark, sf))


@query("parse_responses", "SELECT batch_no, attempt, usable, key, label FROM parsed",
       (CORP, LNUM, X.SQL_RESPONSES, SQL_PARSED))
def q_parse_responses(spark, sf):
    return B.parse_responses(_responses(spark, sf), LANGS)


SQL_RESOLVED = f"""resolved AS (
  SELECT b.batch_no, u.attempt FROM (SELECT DISTINCT batch_no FROM responses) b
  LEFT JOIN (SELECT batch_no, min(attempt) AS attempt FROM parsed
             WHERE usable AND attempt <= {B.MAX_ATTEMPTS} GROUP BY batch_no) u ON u.batch_no = b.batch_no),
newlabels AS (
  SELECT p.batch_no, p.key, p.label FROM parsed p JOIN resolved r ON r.batch_no = p.batch_no AND r.attempt = p.attempt
  WHERE p.key IS NOT NULL),
written AS (
  SELECT n.doc_id, n.batch_no, n.pos, n.predicted AS before_pred, coalesce(n.predicted, l.label) AS predicted,
         l.label AS new_label
  FROM lnumbered n LEFT JOIN newlabels l ON l.batch_no = n.batch_no AND l.key = CAST(n.pos AS VARCHAR))"""


@query("resolve_attempts", "SELECT r.batch_no, r.attempt, CAST(count(l.key) AS INTEGER) AS n_labels FROM resolved r "
       "LEFT JOIN newlabels l ON l.batch_no = r.batch_no GROUP BY r.batch_no, r.attempt",
       (CORP, LNUM, X.SQL_RESPONSES, SQL_PARSED, SQL_RESOLVED))
def q_resolve_attempts(spark, sf):
    r = B.resolve_attempts(_responses(spark, sf), LANGS)
    return r.select("batch_no", "attempt", F.coalesce(F.size("labels"), F.lit(0)).cast("int").alias("n_labels"))


def _written(spark, sf):
    n = X.label_numbered(spark, sf)
    return B.write_back(n, B.resolve_attempts(X.responses(n), LANGS))


@query("write_back", "SELECT doc_id, predicted FROM written", (CORP, LNUM, X.SQL_RESPONSES, SQL_PARSED, SQL_RESOLVED))
def q_write_back(spark, sf):
    return _written(spark, sf).select("doc_id", "predicted")


@query("unlabelled", "SELECT doc_id FROM written WHERE predicted IS NULL",
       (CORP, LNUM, X.SQL_RESPONSES, SQL_PARSED, SQL_RESOLVED))
def q_unlabelled(spark, sf):
    return B.unlabelled(_written(spark, sf)).select("doc_id")


@query("progress", "SELECT count(*) FILTER (WHERE before_pred IS NULL) AS to_process, "
       "count(*) FILTER (WHERE before_pred IS NULL) - count(*) FILTER (WHERE predicted IS NULL) AS processed, "
       "count(*) FILTER (WHERE predicted IS NULL) AS remaining FROM written",
       (CORP, LNUM, X.SQL_RESPONSES, SQL_PARSED, SQL_RESOLVED))
def q_progress(spark, sf):
    before = X.label_numbered(spark, sf).select("doc_id", "predicted")
    return B.progress(before, _written(spark, sf), "doc_id")


# ================================================================ model alignment and metrics

MF = X.SQL_MODEL_FILES
SQL_MODEL_OF = ("CASE regexp_replace(regexp_replace(source_file, '\\.csv', '', 'g'), '\\s*\\(\\d+\\)$', '') "
                + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CP.RESULT_FILE_MODELS.items()) + " END")


def _model_long(spark, sf):
    f = X.model_files(spark, sf)
    return f.withColumn("model", CP.model_from_file(F.col("source_file"))).filter(F.col("model").isNotNull())


@query("model_files", f"SELECT source_file, {SQL_MODEL_OF} AS model, count(*) AS n_rows FROM model_files "
       "GROUP BY ALL", (PW, MF))
def q_model_files(spark, sf):
    f = X.model_files(spark, sf)
    return f.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("model", CP.model_from_file(F.col("source_file")))


@query("align_models", f"SELECT doc_id, coalesce(max(truth) FILTER (WHERE model = '{MODELS[0]}'), max(truth)) AS truth, "
       "count(DISTINCT truth) <= 1 AS truth_ok, " + ", ".join(
    f"max(predicted) FILTER (WHERE model = '{m}') AS \"{m}\"" for m in MODELS)
    + f" FROM (SELECT *, {SQL_MODEL_OF} AS model FROM model_files) WHERE model IS NOT NULL GROUP BY doc_id",
    (PW, MF))
def q_align_models(spark, sf):
    return CP.to_wide(_model_long(spark, sf), MODELS, "doc_id", "truth")


@query("alignment_check", f"""SELECT m.model, count(*) AS n_other, count(*) FILTER (WHERE d.doc_id IS NULL) AS n_extra,
  count(*) FILTER (WHERE d.doc_id IS NOT NULL AND d.text IS DISTINCT FROM m.text) AS n_text_mismatch,
  (SELECT count(*) FROM documents) AS n_reference,
  (SELECT count(*) FROM documents) - count(*) FILTER (WHERE d.doc_id IS NOT NULL) AS n_missing,
  ((SELECT count(*) FROM documents) - count(*) FILTER (WHERE d.doc_id IS NOT NULL) = 0
    AND count(*) FILTER (WHERE d.doc_id IS NULL) = 0
    AND count(*) FILTER (WHERE d.doc_id IS NOT NULL AND d.text IS DISTINCT FROM m.text) = 0) AS aligned
  FROM (SELECT *, {SQL_MODEL_OF} AS model FROM model_files) m LEFT JOIN documents d ON d.doc_id = m.doc_id
  WHERE m.model IS NOT NULL GROUP BY m.model""", (PW, MF))
def q_alignment_check(spark, sf):
    ref = table(spark, sf, "documents").select("doc_id", "text")
    return AG.alignment_check(ref, _model_long(spark, sf), "doc_id", "text", ["model"])


def _valid_cells(spark, sf):
    """cells of rows kept by the valid-prediction filter (raw labels), per model."""
    v = L.valid_predictions(_preds_long(spark, sf), "predicted", LANGS)
    return C.cells(v, "truth", "predicted", ["model"])


SQL_VCELLS = f"""vcells AS (SELECT model, truth, predicted AS pred, count(*) AS n FROM preds_long
  WHERE predicted IN {s_in(LANGS)} GROUP BY ALL)"""


@query("accuracy", """SELECT model, CAST(sum(n) AS BIGINT) AS n_valid,
  CAST(sum(n) FILTER (WHERE truth = pred) AS BIGINT) AS n_correct,
  round(coalesce(sum(n) FILTER (WHERE truth = pred), 0) / sum(n), 6) AS accuracy FROM vcells GROUP BY model""",
       (PW, PL, SQL_VCELLS))
def q_accuracy(spark, sf):
    return C.accuracy(_valid_cells(spark, sf), ["model"]).fillna(0, subset=["n_correct"])


@query("confusion", f"""SELECT g.model, g.truth, g.pred, coalesce(c.n, 0) AS n FROM
  (SELECT DISTINCT model FROM vcells) m, (SELECT unnest({X.s_list(LANGS)}) AS truth) t,
  (SELECT unnest({X.s_list(LANGS)}) AS pred) p, LATERAL (SELECT m.model, t.truth, p.pred) g
  LEFT JOIN vcells c ON c.model = g.model AND c.truth = g.truth AND c.pred = g.pred""", (PW, PL, SQL_VCELLS))
def q_confusion(spark, sf):
    return C.confusion(_valid_cells(spark, sf), LANGS, ["model"])


SQL_PERLABEL = """perlabel AS (
  SELECT model, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(sup) AS BIGINT) AS support,
         CAST(sum(prd) AS BIGINT) AS predicted FROM (
    SELECT model, truth AS label, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS sup, 0 AS prd FROM {cells}
    UNION ALL SELECT model, pred, 0, 0, n FROM {cells}) WHERE label IS NOT NULL GROUP BY model, label),
plm AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision,
            coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
            coalesce(2 * tp::DOUBLE / nullif(support + predicted, 0), 0) AS f1 FROM perlabel)"""


@query("class_report", """SELECT model, label AS "row", 0 AS row_kind, round(precision, 2) AS precision,
  round(recall, 2) AS recall, round(f1, 2) AS f1_score, support::DOUBLE AS support FROM plm
UNION ALL SELECT model, 'accuracy', 1, a, a, a, a FROM (
  SELECT model, coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0) AS a FROM plm GROUP BY model)
UNION ALL SELECT model, 'macro avg', 2, round(avg(precision), 2), round(avg(recall), 2), round(avg(f1), 2),
  sum(support)::DOUBLE FROM plm GROUP BY model
UNION ALL SELECT model, 'weighted avg', 3, round(coalesce(sum(precision * support) / nullif(sum(support), 0), 0), 2),
  round(coalesce(sum(recall * support) / nullif(sum(support), 0), 0), 2),
  round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0), 2), sum(support)::DOUBLE FROM plm GROUP BY model""",
       (PW, PL, SQL_VCELLS, SQL_PERLABEL.format(cells="vcells")))
def q_class_report(spark, sf):
    return C.class_report(_valid_cells(spark, sf), ["model"])


@query("confused_pairs", "SELECT model, truth, pred, CAST(sum(n) AS BIGINT) AS count FROM vcells "
       "WHERE truth IS DISTINCT FROM pred GROUP BY ALL", (PW, PL, SQL_VCELLS))
def q_confused_pairs(spark, sf):
    return C.confused_pairs(_valid_cells(spark, sf), ["model"])


@query("top_confused", "SELECT * FROM (SELECT model, truth, pred, count, CAST(row_number() OVER (PARTITION BY model "
       "ORDER BY count DESC, truth, pred) AS INTEGER) AS rank FROM (SELECT model, truth, pred, CAST(sum(n) AS BIGINT) "
       "AS count FROM vcells WHERE truth IS DISTINCT FROM pred GROUP BY model, truth, pred)) WHERE rank <= 3",
       (PW, PL, SQL_VCELLS))
def q_top_confused(spark, sf):
    return C.top_confused(_valid_cells(spark, sf), ["model"], 3)


@query("per_class_accuracy", f"""SELECT model, truth AS label, CAST(sum(n) AS BIGINT) AS sample_count,
  round(coalesce(sum(n) FILTER (WHERE truth = pred), 0) / sum(n), 6) AS accuracy FROM vcells
  WHERE truth IN {s_in(LANGS)} GROUP BY ALL""", (PW, PL, SQL_VCELLS))
def q_per_class_accuracy(spark, sf):
    return C.per_class_accuracy(_valid_cells(spark, sf), ["model"], LANGS)


SQL_ALLVALID = ("allvalid AS (SELECT doc_id, " + ", ".join(
    [f"{s_norm('truth')} AS truth"] + [f"{s_norm(chr(34) + m + chr(34))} AS \"{m}\"" for m in MODELS])
    + " FROM preds_wide WHERE " + " AND ".join(
    f"{s_norm(c)} IN {s_in(LANGS)}" for c in ["truth"] + [f'"{m}"' for m in MODELS]) + ")")


@query("per_class_by_model", f"""SELECT g.label, g.model, coalesce(s.n, 0) AS sample_count,
  round(coalesce(s.c::DOUBLE / nullif(s.n, 0), 0), 6) AS accuracy
  FROM (SELECT unnest({X.s_list(LANGS)}) AS label) l, (SELECT unnest({X.s_list(MODELS)}) AS model) m,
       LATERAL (SELECT l.label, m.model) g
  LEFT JOIN (""" + " UNION ALL ".join(
    f"SELECT truth AS label, '{m}' AS model, count(*) AS n, count(*) FILTER (WHERE \"{m}\" = truth) AS c "
    f"FROM allvalid GROUP BY truth" for m in MODELS) + ") s ON s.label = g.label AND s.model = g.model",
       (PW, SQL_ALLVALID))
def q_per_class_by_model(spark, sf):
    return CP.per_class_by_model(X.preds_wide(spark, sf), MODELS, LANGS)


SQL_NCELLS = f"""ncells AS (SELECT model, t AS truth, p AS pred, count(*) AS n FROM (
  SELECT model, {s_norm('truth')} AS t, {s_norm('predicted')} AS p FROM preds_long)
  WHERE t IN {s_in(LANGS)} AND p IN {s_in(LANGS)} GROUP BY ALL)"""


def _norm_cells(spark, sf):
    v = L.valid_rows(_preds_long(spark, sf), ["truth", "predicted"], LANGS)
    return C.cells(v, "truth", "predicted", ["model"])


@query("model_metrics", """SELECT a.model, round(a.acc, 6) AS accuracy, round(f.mf, 6) AS f1_macro,
  round(f.wf, 6) AS f1_weighted, a.n AS valid_samples
  FROM (SELECT model, CAST(sum(n) AS BIGINT) AS n, coalesce(sum(n) FILTER (WHERE truth = pred), 0) / sum(n) AS acc
        FROM ncells GROUP BY model) a
  JOIN (SELECT model, avg(f1) AS mf, coalesce(sum(f1 * support) / nullif(sum(support), 0), 0) AS wf
        FROM plm GROUP BY model) f ON f.model = a.model""",
       (PW, PL, SQL_NCELLS, SQL_PERLABEL.format(cells="ncells")))
def q_model_metrics(spark, sf):
    return C.model_metrics(_norm_cells(spark, sf), ["model"])


# ---------------------------------------------------------------- McNemar

PAIRS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1:]]
SQL_MCN = "mcn AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS model1, '{b}' AS model2,
  count(*) FILTER (WHERE ok AND c1 AND c2) AS both_correct, count(*) FILTER (WHERE ok AND c1 AND NOT c2) AS model1_only,
  count(*) FILTER (WHERE ok AND NOT c1 AND c2) AS model2_only, count(*) FILTER (WHERE ok AND NOT c1 AND NOT c2) AS both_wrong,
  count(*) FILTER (WHERE ok) AS n_valid FROM (
    SELECT coalesce(t IN {s_in(LANGS)} AND x IN {s_in(LANGS)} AND y IN {s_in(LANGS)}, false) AS ok,
           x = t AS c1, y = t AS c2 FROM (
      SELECT {s_norm('truth')} AS t, {s_norm(f'"{a}"')} AS x, {s_norm(f'"{b}"')} AS y FROM preds_wide))"""
    for a, b in PAIRS) + ")"


@query("mcnemar_counts", "SELECT * FROM mcn", (PW, SQL_MCN))
def q_mcnemar_counts(spark, sf):
    return CP.mcnemar_counts(X.preds_wide(spark, sf), MODELS, LANGS)


SQL_EXACT = """exact AS (SELECT *,
  CASE WHEN n_valid = 0 THEN NULL ELSE CAST(least(model1_only, model2_only) AS DOUBLE) END AS statistic,
  round(CASE WHEN n_valid = 0 THEN NULL WHEN model1_only + model2_only = 0 THEN 1.0
    ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(nn + 1) - lgamma(i + 1) - lgamma(nn - i + 1) - nn * ln(2)))
                         FROM (SELECT model1_only + model2_only AS nn,
                                      unnest(range(0, least(model1_only, model2_only) + 1)) AS i))) END, 9) AS p_value
  FROM mcn)"""


@query("mcnemar_exact", """SELECT *, p_value < 0.05 AS significant,
  CASE WHEN p_value IS NULL THEN 'not applicable' WHEN p_value < 0.05 THEN 'significant difference'
       ELSE 'no significant difference' END AS verdict FROM exact""", (PW, SQL_MCN, SQL_EXACT))
def q_mcnemar_exact(spark, sf):
    return CP.mcnemar_exact(q_mcnemar_counts(spark, sf))


SQL_ERFC = f"""CASE WHEN y < {CP.ERFC_SPLIT} THEN 1 - 2 * exp(-y * y) / sqrt(pi()) * list_reduce(
    list_prepend({{'t': y, 's': y, 'k': 0}}, list_transform(range(1, {CP.ERFC_TERMS + 1}), lambda i: {{'t': 0::DOUBLE, 's': 0::DOUBLE, 'k': i}})),
    lambda a, b: {{'t': a.t * (2 * y * y) / (2 * b.k + 1), 's': a.s + a.t * (2 * y * y) / (2 * b.k + 1), 'k': b.k}}).s
  ELSE exp(-y * y) / sqrt(pi()) / list_reduce(list_prepend(y, list_transform(range({CP.ERFC_TERMS}, 0, -1), lambda i: i::DOUBLE)),
    lambda a, b: y + b / 2 / a) END"""


@query("mcnemar_chi2", f"""SELECT * EXCLUDE (x, y), round(x, 9) AS chi2_statistic, 1 AS df, round({SQL_ERFC}, 9) AS chi2_p_value
  FROM (SELECT *, sqrt(x / 2) AS y FROM (SELECT *, CASE WHEN model1_only + model2_only > 0 THEN
    pow(abs(model1_only - model2_only) - 1, 2) / (model1_only + model2_only) END AS x FROM mcn))""", (PW, SQL_MCN))
def q_mcnemar_chi2(spark, sf):
    return CP.mcnemar_chi2(q_mcnemar_counts(spark, sf), with_p=True)


@query("pvalue_matrix", "SELECT model, " + ", ".join(
    f"max(p_value) FILTER (WHERE other = '{m}') AS \"{m}\"" for m in MODELS)
    + " FROM (SELECT model1 AS model, model2 AS other, p_value FROM exact UNION ALL "
      "SELECT model2, model1, p_value FROM exact) GROUP BY model", (PW, SQL_MCN, SQL_EXACT))
def q_pvalue_matrix(spark, sf):
    return CP.pvalue_matrix(q_mcnemar_exact(spark, sf), MODELS)


# ---------------------------------------------------------------- bootstrap (multinomial on cells, drawn in SQL)

def _bootstrap_sql(*results: str) -> str:
    """Interval rows with the number of valid samples, from draws over the normalised cells of each model."""
    cells = f"""ncells AS (SELECT model, t AS truth, p AS pred, count(*) AS n FROM (
  SELECT model, {s_norm('truth')} AS t, {s_norm('predicted')} AS p FROM preds_long)
  WHERE t IN {s_in(LANGS)} AND p IN {s_in(LANGS)} GROUP BY ALL)"""
    ctes = [PW, PL, cells, *BQ.drawn("ncells", ["model"], ["truth", "pred"]), *BQ.MEASURES,
            "totals AS (SELECT model, sum(n)::BIGINT AS valid_samples FROM ncells GROUP BY model)"]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT * FROM (" + " UNION ALL ".join(results) + ") JOIN totals USING (model)"


@query("bootstrap_accuracy", _bootstrap_sql(BQ.summary("accuracy", "accuracy")))
def q_bootstrap_accuracy(spark, sf):
    return BS.bootstrap(_norm_cells(spark, sf), ["model"], n_bootstrap=1000, metrics=["accuracy"])


@query("bootstrap_f1", _bootstrap_sql(BQ.summary("f1_macro", "f1_macro")))
def q_bootstrap_f1(spark, sf):
    return BS.bootstrap(_norm_cells(spark, sf), ["model"], n_bootstrap=1000, metrics=["f1_macro"])


@query("bootstrap_f1_weighted", _bootstrap_sql(BQ.summary("f1_weighted", "f1_weighted")))
def q_bootstrap_f1_weighted(spark, sf):
    return BS.bootstrap(_norm_cells(spark, sf), ["model"], metrics=["f1_weighted"])


@query("bootstrap_kappa", _bootstrap_sql(BQ.summary(BQ.KAPPA, "kappa")))
def q_bootstrap_kappa(spark, sf):
    return BS.bootstrap(_norm_cells(spark, sf), ["model"], metrics=["kappa"], measure=lambda c, k: C.kappa(c, k, digits=18))


_LINE = ("'bootstrap' AS section, model AS subject, metric, round(mean, 4) AS value, printf('%s: %.4f ± %.4f [%.4f, %.4f] (Valid samples: %d)', "
         "CASE metric WHEN 'accuracy' THEN 'Accuracy' ELSE 'F1-Macro' END, mean, std, ci_lower, ci_upper, valid_samples) AS text")


@query("report_bootstrap", _bootstrap_sql(BQ.summary("accuracy", "accuracy", digits=12), BQ.summary("f1_macro", "f1_macro", digits=12))
       .replace("SELECT * FROM (SELECT model", f"SELECT {_LINE} FROM (SELECT model", 1))
def q_report_bootstrap(spark, sf):
    from labelops.operators.report import bootstrap_lines

    return bootstrap_lines(BS.bootstrap(_norm_cells(spark, sf), ["model"], digits=12))


def _paired_sql() -> str:
    names = [f"m{i}" for i in range(len(MODELS))]
    norm = ", ".join(f"{s_norm(chr(34) + m + chr(34))} AS m{i}" for i, m in enumerate(MODELS))
    ok = " AND ".join(f"{c} IN {s_in(LANGS)}" for c in ["truth", *names])
    joint = f"""joint AS (SELECT truth, {', '.join(names)}, count(*) AS n FROM (SELECT {s_norm('truth')} AS truth, {norm} FROM preds_wide)
  WHERE {ok} GROUP BY ALL)"""
    draws = BQ.drawn("joint", [], ["truth", *names])
    per_model = " UNION ALL ".join(f"SELECT '{m}' AS model, replicate, truth, m{i} AS pred, sum(n) AS n FROM joint_drawn GROUP BY ALL"
                                   for i, m in enumerate(MODELS))
    draws[-1] = "joint_" + draws[-1]
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS model1, '{b}' AS model2, x.replicate, x.accuracy - y.accuracy AS accuracy, x.f1_macro - y.f1_macro AS f1_macro "
        f"FROM measured x JOIN measured y USING (replicate) WHERE x.model = '{a}' AND y.model = '{b}'" for a, b in PAIRS)
    ctes = [PW, joint, *draws, f"drawn AS ({per_model})", *BQ.MEASURES, f"pairs AS ({pairs})"]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(
        BQ.summary(m, m, "pairs", ("model1", "model2")) for m in ("accuracy", "f1_macro")))


@query("bootstrap_paired", _paired_sql())
def q_bootstrap_paired(spark, sf):
    w = X.preds_wide(spark, sf)
    w = w.filter(CP.valid_for_all(w, ["truth", *MODELS], LANGS))
    return BS.paired_differences(w.select(*[L.norm_label(c).alias(c) for c in ["truth", *MODELS]]), MODELS)


# ================================================================ annotation agreement

ANN = X.SQL_ANNOTATIONS
KPAIRS = [("annotator1", "annotator2"), ("annotator1", "ground_truth"), ("annotator2", "ground_truth")]
SQL_KCELLS = "kcells AS (SELECT pair, truth, pred, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{a}-{b}' AS pair, {s_norm(a)} AS truth, {s_norm(b)} AS pred FROM annotations" for a, b in KPAIRS) \
    + ") GROUP BY ALL)"


@query("kappa", """SELECT pair, CAST(n AS BIGINT) AS n, round(po, 6) AS po, round(pe, 6) AS pe,
  round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM (
  SELECT pair, n, tp / n AS po, pp / (n * n) AS pe FROM (
    SELECT pair, sum(tp)::DOUBLE AS tp, sum(support)::DOUBLE AS n, sum(support::DOUBLE * predicted::DOUBLE) AS pp
    FROM plm GROUP BY pair))""",
       (ANN, SQL_KCELLS, SQL_PERLABEL.format(cells="kcells").replace("model", "pair")))
def q_kappa(spark, sf):
    return AG.kappa_pairs(X.annotations(spark, sf), KPAIRS)


@query("agreement", "SELECT pair, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE truth = pred), 0) "
       "AS BIGINT) AS n_agree, round(coalesce(sum(n) FILTER (WHERE truth = pred), 0) * 100.0 / sum(n), 4)::DOUBLE "
       "AS agree_pct FROM kcells GROUP BY pair", (ANN, SQL_KCELLS))
def q_agreement(spark, sf):
    return AG.agreement_pairs(X.annotations(spark, sf), KPAIRS)


@query("final_accuracy", f"""SELECT count(*) AS n,
  count(*) FILTER (WHERE coalesce({s_norm('consensus')} = {s_norm('ground_truth')}, false)) AS matches,
  round(count(*) FILTER (WHERE coalesce({s_norm('consensus')} = {s_norm('ground_truth')}, false)) * 100.0 / count(*), 4)::DOUBLE
  AS accuracy_pct FROM annotations""", (ANN,))
def q_final_accuracy(spark, sf):
    return AG.final_accuracy(X.annotations(spark, sf))


@query("adjudication", f"""SELECT n, dis AS disagreements, to1 AS to_annotator1, to2 AS to_annotator2,
  dis - to1 - to2 AS neither, round(dis * 100.0 / n, 4)::DOUBLE AS disagreement_pct FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE d) AS dis, count(*) FILTER (WHERE d AND c = x1) AS to1,
         count(*) FILTER (WHERE d AND c = x2) AS to2 FROM (
    SELECT {s_norm('annotator1')} AS x1, {s_norm('annotator2')} AS x2, {s_norm('consensus')} AS c,
           {s_norm('annotator1')} IS DISTINCT FROM {s_norm('annotator2')} AS d FROM annotations))""", (ANN,))
def q_adjudication(spark, sf):
    return AG.adjudication(X.annotations(spark, sf))


@query("match_flag", f"SELECT doc_id, consensus, ground_truth, coalesce({s_norm('consensus')} = "
       f"{s_norm('ground_truth')}, false) AS match FROM annotations", (ANN,))
def q_match_flag(spark, sf):
    return AG.match_flag(X.annotations(spark, sf)).select("doc_id", "consensus", "ground_truth", "match")


SQL_ANN_TEXT = "anntext AS (SELECT a.*, d.text FROM annotations a JOIN documents d ON d.doc_id = a.doc_id)"


def _ann_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return X.annotations(spark, sf).join(d, "doc_id")


@query("annotation_sheets", "SELECT 'annotator1' AS sheet, doc_id, text, '' AS label FROM anntext UNION ALL "
       "SELECT 'annotator2', doc_id, text, '' FROM anntext", (ANN, SQL_ANN_TEXT))
def q_annotation_sheets(spark, sf):
    return AG.blind_sheets(_ann_text(spark, sf), "doc_id", "text", ["annotator1", "annotator2"])


@query("combined_sheet", f"SELECT doc_id, text, {s_norm('ground_truth')} AS ground_truth, annotator1, annotator2, "
       "'' AS consensus, true AS text_ok FROM anntext", (ANN, SQL_ANN_TEXT))
def q_combined_sheet(spark, sf):
    a = _ann_text(spark, sf)
    truth = a.select("doc_id", "text", "ground_truth")
    sheets = {n: a.select("doc_id", "text", n) for n in ("annotator1", "annotator2")}
    return AG.combined_sheet(truth, sheets, "doc_id", "text")


SQL_VIOL = f"""annv AS (SELECT doc_id, annotator1,
  CASE WHEN {shk("'v'", 'doc_id')} % 40 = 0 THEN ' ' WHEN {shk("'v'", 'doc_id')} % 40 = 1 THEN 'great'
       ELSE annotator2 END AS annotator2 FROM annotations)"""


def _ann_violations_input(spark, sf):
    a = X.annotations(spark, sf)
    k = X.hkey("v", F.col("doc_id")) % 40
    return a.withColumn("annotator2", F.when(k == 0, F.lit(" ")).when(k == 1, F.lit("great"))
                        .otherwise(F.col("annotator2")))


@query("label_violations", " UNION ALL ".join(
    f"SELECT CASE WHEN {s_blank(c)} THEN 'blank' ELSE 'invalid' END AS \"check\", '{c}' AS \"column\", doc_id, "
    f"{c} AS value FROM annv WHERE {s_blank(c)} OR {s_norm(c)} NOT IN {s_in(QUALITY)}"
    for c in ("annotator1", "annotator2")), (ANN, SQL_VIOL))
def q_label_violations(spark, sf):
    return AG.label_violations(_ann_violations_input(spark, sf), "doc_id", ["annotator1", "annotator2"], QUALITY)


# ================================================================ report

@query("metric_report", f"""SELECT 'dataset' AS section, 'all' AS subject, 'rows_loaded' AS metric,
  CAST(count(*) AS DOUBLE) AS value FROM preds_wide
UNION ALL SELECT 'dataset', 'all', 'rows_valid', CAST(count(*) AS DOUBLE) FROM preds_wide
  WHERE {s_norm('truth')} IN {s_in(LANGS)}
UNION ALL SELECT 'metrics', model, 'accuracy', round(acc, 4) FROM mm
UNION ALL SELECT 'metrics', model, 'f1_macro', round(mf, 4) FROM mm
UNION ALL SELECT 'metrics', model, 'f1_weighted', round(wf, 4) FROM mm
UNION ALL SELECT 'metrics', model, 'valid_samples', CAST(n AS DOUBLE) FROM mm
UNION ALL SELECT 'mcnemar', model1 || ' vs ' || model2, 'statistic', statistic FROM exact
UNION ALL SELECT 'mcnemar', model1 || ' vs ' || model2, 'p_value', p_value FROM exact""",
       (PW, PL, SQL_NCELLS, SQL_PERLABEL.format(cells="ncells"),
        """mm AS (SELECT a.model, a.acc, f.mf, f.wf, a.n FROM
  (SELECT model, sum(n) AS n, coalesce(sum(n) FILTER (WHERE truth = pred), 0) / sum(n) AS acc FROM ncells GROUP BY model) a
  JOIN (SELECT model, avg(f1) AS mf, coalesce(sum(f1 * support) / nullif(sum(support), 0), 0) AS wf
        FROM plm GROUP BY model) f ON f.model = a.model)""", SQL_MCN, SQL_EXACT))
def q_metric_report(spark, sf):
    from labelops.operators.report import metric_report
    w = X.preds_wide(spark, sf)
    return metric_report(w, MODELS, LANGS, _norm_cells(spark, sf), q_mcnemar_exact(spark, sf))


# ================================================================ bench-scale queries on lineitem

@query("bench_distribution", "SELECT l_returnflag AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) "
       "OVER (), 4)::DOUBLE AS pct FROM lineitem GROUP BY l_returnflag QUALIFY l_returnflag IS NOT NULL")
def q_bench_distribution(spark, sf):
    return P.label_distribution(table(spark, sf, "lineitem"), "l_returnflag")


FLAGS = ["A", "N", "R"]
SQL_RATERS = f"""raters AS (SELECT l_returnflag AS rater1,
  CASE WHEN {shk("'r2'", 'l_orderkey', 'l_linenumber')} % 100 < 15
       THEN {X._s_shift('l_returnflag', FLAGS, '1')} ELSE l_returnflag END AS rater2 FROM lineitem)"""


def _raters(spark, sf):
    li = table(spark, sf, "lineitem")
    r2 = F.when(X.hkey("r2", F.col("l_orderkey"), F.col("l_linenumber")) % 100 < 15,
                X._shift(F.col("l_returnflag"), FLAGS, 1)).otherwise(F.col("l_returnflag"))
    return li.select(F.col("l_returnflag").alias("rater1"), r2.alias("rater2"))


@query("bench_kappa", """SELECT pair, CAST(n AS BIGINT) AS n, round(po, 6) AS po, round(pe, 6) AS pe,
  round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM (
  SELECT pair, n, tp / n AS po, pp / (n * n) AS pe FROM (
    SELECT pair, sum(tp)::DOUBLE AS tp, sum(support)::DOUBLE AS n, sum(support::DOUBLE * predicted::DOUBLE) AS pp
    FROM plm GROUP BY pair))""",
       (SQL_RATERS, "rcells AS (SELECT 'rater1-rater2' AS pair, " + s_norm("rater1") + " AS truth, "
        + s_norm("rater2") + " AS pred, count(*) AS n FROM raters GROUP BY ALL)",
        SQL_PERLABEL.format(cells="rcells").replace("model", "pair")))
def q_bench_kappa(spark, sf):
    return AG.kappa_pairs(_raters(spark, sf), [("rater1", "rater2")])


from labelops.plans import io_queries  # noqa: E402,F401  (registers the file and stream queries)


# ================================================================ variants: fixed class order, greedy extraction, strict names

FIXED_CLASSES = ["en", "fr", "de", "es", "it"]


@query("label_distribution_fixed", f"""SELECT CAST(c.ord AS INTEGER) AS ord, c.label, coalesce(d.n, 0) AS n,
  round(coalesce(coalesce(d.n, 0) * 100.0 / nullif((SELECT count(*) FROM cleaned), 0), 0), 4)::DOUBLE AS pct
  FROM (SELECT unnest({X.s_list(FIXED_CLASSES)}) AS label, unnest(range(1, {len(FIXED_CLASSES) + 1})) AS ord) c
  LEFT JOIN (SELECT lang, count(*) AS n FROM cleaned GROUP BY lang) d ON d.lang = c.label""", (D, CLN))
def q_label_distribution_fixed(spark, sf):
    return P.label_distribution(X.cleaned_docs(spark, sf), "lang", FIXED_CLASSES)


SQL_PARSED_EXTRACT = SQL_PARSED.replace(
    "FROM responses)", "FROM (SELECT batch_no, attempt, regexp_extract(body, '(\\{[\\s\\S]*\\})', 1) AS body "
    "FROM responses))", 1)


@query("parse_responses_extract", "SELECT batch_no, attempt, usable, key, label FROM parsed",
       (CORP, LNUM, X.SQL_RESPONSES, SQL_PARSED_EXTRACT))
def q_parse_responses_extract(spark, sf):
    return B.parse_responses(_responses(spark, sf), LANGS, extract=True)


EXPECTED_FILES = ["Claude_sentiment_results.csv", "DeepSeek_sentiment_results.csv",
                  "Gemini_sentiment_results.csv", "GPT4o_sentiment_results.csv", "Mistral_sentiment_results.csv"]


def _sql_strict(expected: str) -> str:
    stem = expected[:-4].replace(".", "\\.")
    return (f"SELECT '{expected}' AS expected, count(*) FILTER (WHERE regexp_matches(source_file, "
            f"'^{stem}(\\s*\\(\\d+\\))?\\.csv$')) AS n_matches, min(source_file) FILTER (WHERE regexp_matches("
            f"source_file, '^{stem}(\\s*\\(\\d+\\))?\\.csv$')) AS matched FROM (SELECT DISTINCT source_file "
            "FROM model_files)")


@query("file_matches", "SELECT *, CASE WHEN n_matches = 1 THEN 'ok' WHEN n_matches = 0 THEN 'missing' "
       "ELSE 'ambiguous' END AS status FROM (" + " UNION ALL ".join(_sql_strict(e) for e in EXPECTED_FILES) + ")",
       (PW, MF))
def q_file_matches(spark, sf):
    names = X.model_files(spark, sf).select(F.col("source_file").alias("file_name")).distinct()
    return CP.strict_file_matches(names, EXPECTED_FILES)
