"""The operators as queries over the driver's tables, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regemb.llm import (conversation_repair, exact_dedup, language_id, license_scan, mixing,
                        ngram_join, packing, quality, spotsigs, suffix_dedup, token_alignment,
                        token_count, toxicity)
from regemb.llm.base import crc_of_id, table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are."""
    rows = spotsigs.edited_and_next(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint("signatures").alias("fingerprint"),
        spotsigs.fingerprint("edited_signatures").alias("edited_fingerprint"),
        spotsigs.likeness("signatures", "edited_signatures").alias("near_edited"),
        spotsigs.likeness("signatures", "next_signatures").alias("near_next"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target",
                       mixing.taken_words(F.col("spans")).alias("taken"), "source")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every line that a template could confirm."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.Classifier(spark, docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, modulus=3, held_out=1)
    return quality.score_documents(docs, model).select(
        "doc_id", (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every text because a smaller document has it too."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text, learned outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels, modulus=4, held_out=2)
    return toxicity.score_documents(docs, lexicon).select(
        "doc_id", (F.pmod(crc_of_id(), F.lit(4)) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest audit and repaired digest of every damaged conversation."""
    rows = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(rows)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, modulus=3, held_out=1)
    return language_id.identify(docs, model).select(
        "doc_id", (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out"), "lang_pred", "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every text under two tokenizers."""
    return token_alignment.documents(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ngram_jaccard, op2_spotsigs, op3_packing, op4_mixing, op5_license_scan,
        op6_exact_dedup, op7_token_count, op8_quality, op9_suffix_dedup, op10_toxicity,
        op11_conversation_repair, op12_language_id, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL; the other queries are tested against brute force or held-out rows."""
    return {"op6_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g"""}
