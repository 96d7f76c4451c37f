"""Registered queries of the subpackage (``opN_<name>``) and their DuckDB twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import (covertree, decontaminate, langid, linededup, packing, phrases, quality, sharding, simhash, spelling,
               suffixdedup, tokencount, toxicity)
from .common import table


def op1_simhash(spark, d):
    return simhash.near_dups(table(spark, d, "documents")).drop("fp")


def op2_linededup(spark, d):
    return linededup.line_dedup(table(spark, d, "documents")).drop("rid")


def op3_quality(spark, d):
    return quality.calibrated(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_toxicity(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = toxicity.toxicity(docs, labels.filter(~toxicity.held_out()))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"),
                      "spans")


def op5_tokencount(spark, d):
    return tokencount.token_counts(table(spark, d, "documents"))


def op6_suffixdedup(spark, d):
    return suffixdedup.substring_dedup(table(spark, d, "documents"), keep_text=False)


def op7_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), added_tokens=True)


def op8_decontaminate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, d, "benchmark"))
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_sharding(spark, d):
    return sharding.shard_rows(table(spark, d, "documents"))


def op10_langid(spark, d):
    docs = table(spark, d, "documents")
    out = langid.identify(docs.select("doc_id", "text"), docs.filter(~langid.held_out()))
    return out.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op11_phrases(spark, d):
    return phrases.collocations(table(spark, d, "documents"))


def op12_covertree(spark, d):
    return covertree.link_counts(table(spark, d, "embeddings"))


def op13_spelling(spark, d):
    return spelling.variants(table(spark, d, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_linededup": op2_linededup,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_tokencount": op5_tokencount,
    "op6_suffixdedup": op6_suffixdedup,
    "op7_packing": op7_packing,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding,
    "op10_langid": op10_langid,
    "op11_phrases": op11_phrases,
    "op12_covertree": op12_covertree,
    "op13_spelling": op13_spelling,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op12_covertree": """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON pairs.u = reach.v),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least.c AS component_id, e.vec_id = least.c AS kept
FROM embeddings e JOIN least ON least.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
""",
    "op11_phrases": """
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS gram, count(*) AS f
  FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM grams WHERE k > 1 AND f >= 100),
kept AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.f >= 100 * c.f
      AND contains(' ' || d.gram || ' ', ' ' || c.gram || ' '))),
cuts AS (
  SELECT lang, gram, f, c AS cut_at, array_to_string(string_split(gram, ' ')[1:c], ' ') AS first,
         array_to_string(string_split(gram, ' ')[c + 1:], ' ') AS rest
  FROM kept, range(1, 5) t(c) WHERE c < k),
scored AS (
  SELECT cuts.lang, cuts.gram, cuts.f AS a, cut_at, x.f AS l, y.f AS r, total.n,
         (1000::HUGEINT * cuts.f * total.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.gram = first
            JOIN grams y ON y.lang = cuts.lang AND y.gram = rest
            JOIN total ON total.lang = cuts.lang),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut_at) AS cut_rank FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram COLLATE "binary") AS rank
  FROM best WHERE cut_rank = 1)
SELECT lang, rank, gram AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
""",
}
