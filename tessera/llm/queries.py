"""The registered queries of this subpackage: each operator over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.conversations import damage, repair_conversations
from tessera.llm.language_model import score_documents
from tessera.llm.licenses import scan_licenses
from tessera.llm.mixing import mix_counts
from tessera.llm.negatives import hard_negatives
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.packing import best_fit_pack
from tessera.llm.personal import find_personal
from tessera.llm.quality import MIN_WORDS, REPEAT_PERCENT, RULES, STOP_WORDS, quality_verdicts
from tessera.llm.sharding import shard_by_size
from tessera.llm.token_counts import token_counts
from tessera.llm.tokens import read_documents, write_sequences
from tessera.llm.vectors import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_sequences(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, threshold=0.85)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(_table(spark, sf_dir, "documents"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(_table(spark, sf_dir, "documents"), shards=40)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(_table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), limit=512)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(_table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_mixing, op2_token_files, op3_ngram_join, op4_best_fit, op5_personal_data, op6_vector_dedup, op7_sharding, op8_quality, op9_licenses, op10_lm_scores, op11_token_counts, op12_conversation_repair, op13_hard_negatives)
    return {f.__name__: f for f in every}


def _rules_sql() -> str:
    quotient = {
        "mean_word_length": "word_chars / n_words",
        "symbols_per_word": "n_symbols / n_words",
        "stop_word_ratio": "n_stop / n_words",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
        "repeat_ratio": "n_repeat_words / n_words",
        "capital_ratio": "n_capital / nullif(word_chars, 0)",
        "words_per_line": "n_words / nullif(n_lines, 0)",
    }
    tests = []
    for rule in RULES:
        for sign, bound in ((">=", rule.low), ("<=", rule.high)):
            if bound is not None:
                tests.append(f"coalesce({quotient[rule.name]} {sign} {bound!r}, true)")
    return " AND ".join(tests)


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(f"'{form}'" for w in STOP_WORDS for form in dict.fromkeys((w, w.capitalize())))
    gap = r"[\x20\x09-\x0D]+"
    return {
        "op8_quality": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{gap}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 3)) AS k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_capital
  FROM d LEFT JOIN cov ON d.r = cov.r),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {_rules_sql()}) AS kept
FROM b""",
        "op13_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, o) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id, s.o) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    }
