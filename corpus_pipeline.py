"""From raw documents to packed sequences in five stages.

Each stage takes the documents that its predecessor kept and returns documents, the last
one the packed pieces. Between stages the documents lie in the shared folder as Parquet,
so a lost executor never reaches back over a stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contactloom.llm import decontamination, language_id, minhash, packing, quality_rules
from contactloom.llm.common import stored, table

#: Documents whose language is less certain than this go.
LEAST_CERTAIN = 0.5
#: Stretches of text in a table of the packing stage's workers, which share their memory with what earlier stages left.
REMEMBERED = 150_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the line rules go, and so do documents that fail the base counts or lose too much."""
    return quality_rules.clean(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of uncertain language go. The language column is learned from, not judged."""
    return language_id.of_known_language(docs, LEAST_CERTAIN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id."""
    return minhash.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned language models, hashing and packing are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None
