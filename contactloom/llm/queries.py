"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contactloom.llm import decontamination, html_extraction, language_id, minhash, packing, quality_rules, sharding, token_counts, token_files, toxicity
from contactloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packer of op2 on instruction data: whole conversations under limits on tokens, turns and learned tokens."""
    examples = packing.conversation_examples(table(spark, sf_dir, "conversations"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_examples(examples, packing.Limits(segments=32, loss_tokens=2048))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_identified(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.measured(table(spark, sf_dir, "documents")).select(*names)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(files)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "conversation_packing": conversation_packing,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash": op6_minhash,
    "op7_token_files": op7_token_files,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {"op5_quality_rules": quality_rules.oracle_sql(), "op6_minhash": minhash.oracle_sql()}
