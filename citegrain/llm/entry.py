"""The operators as registered queries: each over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citegrain.llm import chat, decontaminate, line_dedup, packing, passage_dedup, quality_rules, simhash, site_quality, suffix_dedup, toxicity
from citegrain.llm.common import table

import corpus_pipeline


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.find_passages(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = site_quality.score_sites(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "host_posterior", "path_posterior", "score", "predicted", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=("n_lines", "n_dropped"))
    return cleaned.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(conversations.unionByName(planted)))


OP4 = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
            FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, win) > 1),
covered AS (SELECT k, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY k),
m AS (
  SELECT w.k, doc_id, len(words)::BIGINT AS n_words,
         length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN (%STOP%))) AS n_stop,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM w LEFT JOIN covered USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 50 AND 1000000 AND word_chars BETWEEN 2.0 * n_words AND 12.0 * n_words
       AND n_symbols <= CAST(0.1 AS DOUBLE) * n_words AND n_stop >= CAST(0.02 AS DOUBLE) * n_words AND 2 * n_repeat_words <= n_words
       AND 2 * n_dup_lines <= n_lines AND n_bullet <= CAST(0.9 AS DOUBLE) * n_lines AND n_ellipsis <= CAST(0.3 AS DOUBLE) * n_lines AS kept
FROM b
""".replace("%STOP%", ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS))

OP6 = r"""
WITH pages AS (SELECT row_number() OVER () AS k, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
lines AS (SELECT DISTINCT k, host, unnest(string_split(body, chr(10))) AS line FROM pages),
counts AS (SELECT host, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY host, line),
boiler AS (SELECT host, list(line) AS gone FROM counts JOIN totals USING (host) WHERE n >= 5 AND n > CAST(0.02 AS DOUBLE) * pages GROUP BY host),
cut AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS parts,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept
        FROM documents LEFT JOIN boiler ON host = coalesce(source, ''))
SELECT doc_id, source, len(parts)::BIGINT AS n_lines, (len(parts) - len(kept))::BIGINT AS n_dropped,
       CASE WHEN len(parts) = len(kept) THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_passage_dedup, op4_quality_rules, op5_site_quality, op6_line_dedup, op7_suffix_dedup, op8_simhash, op9_decontamination, op10_chat_formatting)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4, "op6_line_dedup": OP6}
