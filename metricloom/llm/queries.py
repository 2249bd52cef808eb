"""Registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import (
    ann, bpe_codec, hard_negatives, lexical, line_dedup, mixing, packing, quality_rules, set_join, substring_dedup, suffix_dedup, token_counts, token_files,
)
from metricloom.llm.storage import read_table
from metricloom.session import scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path, checksums=True)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(quality_rules.ledger(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "n_lines", "failed_rules")


SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
places AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM places),
covered AS (SELECT doc_id, i + unnest([0, 1, 2]) AS word FROM windows WHERE n >= 2),
repeats AS (SELECT doc_id, count(DISTINCT word) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
counted AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM w LEFT JOIN counted USING (doc_id) LEFT JOIN repeats USING (doc_id)),
bits AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 20 * word_chars THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END) AS BIGINT) AS failed_rules
  FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 AS base_failed,
       failed_rules = 0 AS kept, n_lines, failed_rules
FROM bits
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


SQL["op9_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT r, doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM d),
windows AS (
  SELECT r, doc_id, i, w, string_agg(w, ' ') OVER following AS key, count(*) OVER following AS n FROM places
  WINDOW following AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
judged AS (
  SELECT r, i, w, n = 13 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS copied FROM windows),
covered AS (
  SELECT r, i, w, coalesce(bool_or(copied) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
  FROM judged),
kept AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS left_over
  FROM covered GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))


@query
def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.joined(read_table(spark, sf_dir, "documents"))


SQL["op7_set_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT r, doc_id, len(ws) AS words, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM d),
windows AS (
  SELECT r, doc_id, words, i, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle
  FROM places),
sets AS MATERIALIZED (SELECT DISTINCT r, doc_id, shingle FROM windows WHERE i = 1 OR i + 4 <= words),
sizes AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM sets GROUP BY r, doc_id),
shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS common FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.r, b.r),
links AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM shared JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y
  WHERE 100 * common >= 75 * (a.n + b.n - common)),
either AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT x, y FROM either UNION SELECT reach.x, either.y FROM reach JOIN either ON reach.y = either.x),
components AS (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM d LEFT JOIN sizes ON d.r = sizes.r LEFT JOIN components ON d.doc_id = components.doc_id
"""


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(read_table(spark, sf_dir, "documents"))


SQL["op2_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
split AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i
          FROM d WHERE text IS NOT NULL),
marked AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS wordy FROM split),
reach AS (
  SELECT *, min(CASE WHEN wordy THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next,
         max(CASE WHEN wordy THEN i END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS last FROM marked),
runs AS (
  SELECT r, doc_id, i, true AS forward, string_agg(line, chr(10)) OVER (
    PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND coalesce(next - i, 0) FOLLOWING) AS run FROM reach
  QUALIFY next IS NOT NULL
  UNION ALL
  SELECT r, doc_id, i, false, string_agg(line, chr(10)) OVER (
    PARTITION BY r ORDER BY i ROWS BETWEEN coalesce(i - last, 0) PRECEDING AND CURRENT ROW) FROM reach
  QUALIFY last IS NOT NULL),
judged AS (
  SELECT r, i, coalesce(doc_id > min(doc_id) OVER (PARTITION BY forward, run), false)
    OR i > min(i) OVER (PARTITION BY forward, run, r) AS copied FROM runs),
gone AS (SELECT DISTINCT r, i FROM judged WHERE copied),
kept AS (
  SELECT split.r, count(*) AS n_lines, count(gone.i) AS n_removed,
         string_agg(line, chr(10) ORDER BY split.i) FILTER (WHERE gone.i IS NULL) AS left_over
  FROM split LEFT JOIN gone ON split.r = gone.r AND split.i = gone.i GROUP BY split.r)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM documents JOIN d ON documents.doc_id IS NOT DISTINCT FROM d.doc_id AND documents.text IS NOT DISTINCT FROM d.text
LEFT JOIN kept ON kept.r = d.r
"""


@query
def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL["op13_lexical_search"] = r"""
WITH held AS (
  SELECT row_number() OVER () AS r, doc_id, ws FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents)
  WHERE len(ws) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS terms FROM held),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
places AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM held),
counted AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM places
            WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
            FROM counted, whole GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM counted JOIN weights USING (term) JOIN asked USING (term), whole GROUP BY item_id, doc_id, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM scored WHERE score > 0)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    # The contract's noise in the labels.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), "vec_id % 100 = 0")


SQL["op12_hard_negatives"] = r"""
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, h.vec_id, a.label = h.label AS same, CAST(list_inner_product(a.v, h.v) AS BIGINT) AS score
  FROM held a JOIN held h ON a.vec_id <> h.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
  WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""


@query
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture(read_table(spark, sf_dir, "documents"))
    return plan.taken().select("doc_id", "size", "source_size", "target", "taken", "source")
