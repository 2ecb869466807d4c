"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcstrata.llm import (
    alignment, chat, exact, html, lines, packing, pieces, pii, rules, simhash, spelling, substrings, token_counts)
from srcstrata.llm.common import table, texts

PACKING_VOCABULARY = "byte_bpe_50k.json"
PIECES_MODEL = "piece_bpe_32k.model"
AWKWARD = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.element_at(F.array(F.lit("user"), F.lit("assistant")),
                                                         (F.col("id") + 1).cast("int")), F.lit(AWKWARD))
    records = rows.union(extra).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    turns = chat.canonical_turns(records).filter("problem IS NULL")
    return chat.digests(chat.format_turns(turns)).select(
        F.col("conversation").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
        "formatted_chars")


def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    entries = rules.ledger(texts(table(spark, folder, "documents")), ["doc_id"])
    return entries.select(
        "doc_id", *[F.col(f"m_{n}").alias(n) for n in
                    ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("m_failed").alias("failed_rules"), (~rules.passes("base")).alias("base_failed"),
        rules.passes("v1").alias("kept"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.detect(table(spark, folder, "documents"))


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, folder, "documents"), public_tokenizers.path(PIECES_MODEL))


def op7_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deleted_runs(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(PACKING_VOCABULARY))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(PACKING_VOCABULARY))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment_digests(table(spark, folder, "documents"), public_tokenizers.path(PACKING_VOCABULARY),
                                       public_tokenizers.path(PIECES_MODEL))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_chat_format, op2_simhash_dedup, op3_exact_dedup, op4_quality_rules, op5_pii, op6_pieces, op7_html_extract,
    op8_substring_dedup, op9_line_dedup, op10_packing, op11_token_counts, op12_alignment, op13_spelling)}
