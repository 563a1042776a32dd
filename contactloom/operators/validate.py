"""Integrity: counts, the conditions of every row, reads in order, and equal sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.ids import shard_offsets
from contactloom.schema import alignment_problem, pair_problem


def counts(rows: DataFrame) -> DataFrame:
    """One row: records of either quality and, for alignments, reads with a record of either quality."""
    q = F.col("mapq" if "mapq" in rows.columns else "mapping_quality")
    out = [F.count("*").alias("q0_records"), F.count(F.when(q >= 1, 1)).alias("q1_records")]
    if "mapq" in rows.columns:
        return rows.agg(*out)
    reads = rows.groupBy("read_idx").agg(F.count("*").alias("_n"), F.count(F.when(q >= 1, 1)).alias("_q"))
    return reads.agg(F.sum("_n").alias("q0_records"), F.sum("_q").alias("q1_records"), F.count("*").alias("q0_reads"), F.count(F.when(F.col("_q") > 0, 1)).alias("q1_reads"))


def row_issues(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """code, _shard, _row of rows that break a condition."""
    size = lambda n: F.broadcast(contigs.select(F.col("contig_id").alias(f"_id{n}"), F.col("length").alias(f"_length{n}")))
    if "chrom1_id" in rows.columns:
        rows = rows.join(size(1), F.col("chrom1_id") == F.col("_id1"), "left").join(size(2), F.col("chrom2_id") == F.col("_id2"), "left")
        problem = pair_problem(F.col("_length1"), F.col("_length2"))
    else:
        rows = rows.join(size(1), F.col("chrom_id") == F.col("_id1"), "left")
        problem = alignment_problem(F.col("_length1"))
    return rows.select(problem.alias("code"), "_shard", "_row").where("code is not null")


def read_issues(rows: DataFrame) -> DataFrame:
    """Reads whose ids decrease within a shard, or whose alignments differ in read length."""
    before = F.lag("read_idx").over(Window.partitionBy("_shard").orderBy("_row"))
    order = rows.select("_shard", "_row", "read_idx", before.alias("_before")).where("read_idx < _before").select(F.lit("READ_ORDER").alias("code"), "_shard", "_row")
    lengths = rows.groupBy("read_idx").agg(F.min("read_length").alias("_l"), F.max("read_length").alias("_m"), F.min(F.struct("_shard", "_row")).alias("_at")).where("_l <> _m")
    return order.unionByName(lengths.select(F.lit("READ_LENGTH_MISMATCH").alias("code"), "_at._shard", "_at._row"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place in the whole sequence: rank in the shard plus the sizes of the shards before."""
    rank = F.row_number().over(Window.partitionBy("_shard").orderBy("_row")).cast("bigint")
    offsets = shard_offsets(rows.groupBy("_shard").agg(F.count("*").alias("_n")), "_n")
    return rows.withColumn("_rank", rank).join(F.broadcast(offsets), "_shard").withColumn("_place", F.col("_before") + F.col("_rank")).drop("_rank", "_before", "_shard", "_row")


def sequence_mismatches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Places at which two ordered sets of rows differ, or where one has ended."""
    data = [c for c in expected.columns if c not in ("_shard", "_row", "qbucket")]
    pack = lambda df: _placed(df).select("_place", F.struct(*data).alias("_data"))
    a, b = pack(expected).withColumnRenamed("_data", "_a"), pack(found).withColumnRenamed("_data", "_b")
    return a.join(b, "_place", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("_place")
