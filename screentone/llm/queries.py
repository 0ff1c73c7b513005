"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screentone.llm import chat, decontamination, langid, licenses, packing, quality, runs, secrets, sharding, simhash, suffixes, toxicity, vectorcodes
from screentone.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcodes.compress(table(spark, sf_dir, "embeddings"), parts=4, rounds=4, scale=1024)
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), least=100)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


_ALL = (
    op1_secret_scan,
    op2_simhash,
    op3_language_id,
    op4_sharding,
    op5_license_scan,
    op6_decontamination,
    op7_chat_format,
    op8_quality,
    op9_toxicity,
    op10_packing,
    op11_vector_codes,
    op12_suffix_dedup,
    op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
_SHARE = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "upper_ratio": ("n_upper", "n_upper + n_lower"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
}
_RULES = " OR ".join(f"{m} {how} {bound!r}" for m, how, bound in quality.RULES)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL: dict[str, str] = {
    "op8_quality": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t),
win AS (SELECT doc_id, i, words[i:i + 4] AS v FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY 1),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(text) - len(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         len(text) - len(translate(text, '{_LETTERS}', '')) AS n_upper, len(text) - len(translate(text, '{_LETTERS.lower()}', '')) AS n_lower,
         len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bullet_lines
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
r AS (SELECT *, {", ".join(f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END AS {k}" for k, (a, b) in _SHARE.items())},
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_RULES}) AS kept FROM r""",
}
