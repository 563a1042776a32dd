"""Aligner records to pairs or reads: filters with reasons, grouping by read, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.expand import FIVE_PRIME, LEFTMOST, gathered, paired
from contactloom.operators.ids import numbered

UNMAPPED, SECONDARY, QCFAIL, DUPLICATE = 4, 256, 512, 1024
REASONS = ("unmapped", "duplicate_or_qcfail", "secondary", "mapq")


def skip_reason(min_mapq: int = 0, include_secondary: bool = False) -> Column:
    """Why a record is left out, or null. The first reason counts, so each record is counted once."""
    has = lambda bits: F.col("flag").bitwiseAND(bits) != 0
    reason = F.when(has(UNMAPPED), "unmapped").when(has(QCFAIL | DUPLICATE), "duplicate_or_qcfail")
    if not include_secondary:
        reason = reason.when(has(SECONDARY), "secondary")
    return reason.when(F.col("mapping_quality") < min_mapq, "mapq")


def filter_reasons(records: DataFrame, min_mapq: int = 0, include_secondary: bool = False) -> DataFrame:
    return records.groupBy(F.coalesce(skip_reason(min_mapq, include_secondary), F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


def selected(records: DataFrame, min_mapq: int = 0, include_secondary: bool = False) -> DataFrame:
    return records.where(skip_reason(min_mapq, include_secondary).isNull())


def import_pairs(records: DataFrame, min_mapq: int = 0, min_order: int = 2, max_order: int | None = None, include_secondary: bool = False, five_prime: bool = False) -> DataFrame:
    """Pairs of all alignments of a name within a read group, both mates pooled, ends in canonical order."""
    reads = gathered(selected(records, min_mapq, include_secondary), ["rg", "name"], ["mate", "read_start", "ordinal"], min_order, max_order)
    return paired(reads, F.col("name"), FIVE_PRIME if five_prime else LEFTMOST, canonical=True)


def import_reads(records: DataFrame, min_mapq: int = 0, min_order: int = 1, max_order: int | None = None, include_secondary: bool = False) -> DataFrame:
    """One row for each read of (rg, name, mate), in that order: read_idx, rg, name, mate, n."""
    n = selected(records, min_mapq, include_secondary).groupBy("rg", "name", "mate").agg(F.count("*").alias("n"))
    n = n.where(F.col("n") >= min_order)
    n = n if max_order is None else n.where(F.col("n") < max_order)
    return numbered(n, ["rg", "name", "mate"], "read_idx")


def group_problems(records: DataFrame) -> DataFrame:
    """Groups that mix paired and unpaired records, or whose mates differ in read length."""
    per = records.groupBy("rg", "name").agg(
        (F.max((F.col("mate") == 0).cast("int")) + F.max((F.col("mate") > 0).cast("int"))).alias("kinds"),
    )
    mixed = per.where("kinds > 1").select("rg", "name", F.lit("mixed paired and unpaired").alias("problem"))
    if "read_length" not in records.columns:
        return mixed
    lengths = records.groupBy("rg", "name", "mate").agg(F.min("read_length").alias("low"), F.max("read_length").alias("high")).where("low <> high")
    return mixed.unionByName(lengths.select("rg", "name", F.lit("read lengths differ").alias("problem")))


def import_statistics(records: DataFrame, min_mapq: int = 0, min_order: int = 1, max_order: int | None = None, include_secondary: bool = False, by_mate: bool = True) -> DataFrame:
    """The seven counters of an import, as one row."""
    reason = records.withColumn("_reason", skip_reason(min_mapq, include_secondary))
    skipped = [F.count(F.when(F.col("_reason") == r, 1)).alias(f"skipped_{r}") for r in REASONS]
    counts = reason.agg(F.count("*").alias("input_records"), *skipped)
    keys = ["rg", "name", "mate"] if by_mate else ["rg", "name"]
    fits = (F.col("n") >= min_order) & (F.lit(True) if max_order is None else F.col("n") < max_order)
    reads = reason.where("_reason is null").groupBy(*keys).agg(F.count("*").alias("n"))
    reads = reads.agg(F.count(F.when(fits, 1)).alias("selected_read_groups"), F.count(F.when(~fits, 1)).alias("skipped_order_groups"))
    return counts.join(F.broadcast(reads), F.lit(True))


def ranks(records: DataFrame) -> DataFrame:
    """Place of each record in its group, from 0."""
    w = Window.partitionBy("rg", "name").orderBy("mate", "read_start", "ordinal")
    return records.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))
