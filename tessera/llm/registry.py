"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversations, decontaminate, exact_dedup, language, ngram_join, packing, periodic, quality, recompression, secrets, simhash, token_files, warc
from tessera.llm.tokens import default_tokenizer


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``held_out`` is null where ``doc_id`` is."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    held_out = quality.remainder(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``held_out`` is null where ``doc_id`` is."""
    docs = _read(spark, sf_dir, "documents")
    held_out = quality.remainder(F.col("doc_id"), 4) == 2
    return language.predict(docs, language.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.substring_dedup(_read(spark, sf_dir, "documents")).drop("kept_text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), default_tokenizer(), 2)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), default_tokenizer(), 1)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns the longest verbatim match of each document: its words, item, and places in both; null without any.

    Of equally long ones the first in the document counts, then the item with the smallest id as text.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, _read(spark, sf_dir, "benchmark"))
    ranked = F.transform("matches", lambda m: F.struct((-m.length).alias("short"), m.word.alias("word"), m.item_id.alias("item_id"), m.item_word.alias("item_word")))
    best = F.array_min(ranked)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    longest = [(-best["short"]).alias("match_words"), best["item_id"].alias("match_item"), best["word"].alias("match_at"), best["item_word"].alias("match_item_at")]
    return found.select(*columns, *longest)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(_read(spark, sf_dir, "conversations")), F.col("present"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.planted(_read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    top = [F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("(1000 * top.length) div top.period").alias("exponent_milli")
    digests = [F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, exponent, *digests)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_language, op3_substring_dedup, op4_simhash, op5_packing, op6_exact_dedup, op7_warc, op8_token_files, op9_decontamination, op10_secrets,
        op11_conversations, op12_periodic_runs, op13_ngram_join,
    )
}

OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
w AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(html)) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM d
"""

ORACLE_SQL = {"op6_exact_dedup": OP6_SQL, "op7_warc": OP7_SQL}
