"""Column sets of the two record kinds, and the conditions that every written row meets.

Positions of pairs are 1-based, intervals of alignments 0-based and half open. Stored
columns are signed, because Parquet statistics of unsigned columns prune nothing in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



PAIRS_DDL = "read_id string, chrom1_id int, pos1 bigint, chrom2_id int, pos2 bigint, strand1 string, strand2 string, mapq smallint"
CONCAT_DDL = (
    "read_idx bigint, read_length bigint, read_start bigint, read_end bigint, strand string, chrom_id int, "
    "start_pos bigint, end_pos bigint, mapping_quality smallint, identity float, filter_reason string"
)
PAIRS_COLUMNS = [f.split()[0] for f in PAIRS_DDL.split(", ")]
CONCAT_COLUMNS = [f.split()[0] for f in CONCAT_DDL.split(", ")]


class InvalidInput(ValueError):
    """The caller asked for something that can't be; the command line ends with code 2."""


def pair_problem(length1: Column, length2: Column) -> Column:
    """What is wrong with a pair, or null."""
    strand = lambda c: F.coalesce(F.col(c).isin("+", "-"), F.lit(False))
    inside = lambda pos, length: F.coalesce((F.col(pos) >= 1) & (F.col(pos) <= length), F.lit(False))
    missing = F.lit(False)
    for c in PAIRS_COLUMNS:
        missing = missing | F.col(c).isNull()
    return (
        F.when(missing, "NULL_VALUES")
        .when(~strand("strand1") | ~strand("strand2") | ~F.col("mapq").between(0, 255), "INVALID_RECORD_ENCODING")
        .when(~inside("pos1", length1) | ~inside("pos2", length2), "POSITION_OUT_OF_RANGE")
    )


def alignment_problem(length: Column) -> Column:
    """What is wrong with an alignment, or null."""
    missing = F.lit(False)
    for c in CONCAT_COLUMNS:
        missing = missing | F.col(c).isNull()
    finite = ~F.isnan("identity") & (F.abs("identity") != F.lit(float("inf")))
    return (
        F.when(missing, "NULL_VALUES")
        .when(~F.col("strand").isin("+", "-") | ~F.col("mapping_quality").between(0, 255), "INVALID_RECORD_ENCODING")
        .when(~((F.col("read_start") < F.col("read_end")) & (F.col("read_end") <= F.col("read_length")) & (F.col("read_start") >= 0)), "INVALID_READ_INTERVAL")
        .when(~F.coalesce((F.col("start_pos") < F.col("end_pos")) & (F.col("end_pos") <= length) & (F.col("start_pos") >= 0), F.lit(False)), "POSITION_OUT_OF_RANGE")
        .when(~finite, "INVALID_IDENTITY")
    )


def checked(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """``rows`` with an error in the plan for the first row that breaks a condition."""
    columns = rows.columns
    size = lambda n: F.broadcast(contigs.select(F.col("contig_id").alias(f"_id{n}"), F.col("length").alias(f"_length{n}")))
    if "chrom1_id" in columns:
        rows = rows.join(size(1), F.col("chrom1_id") == F.col("_id1"), "left").join(size(2), F.col("chrom2_id") == F.col("_id2"), "left")
        problem, key = pair_problem(F.col("_length1"), F.col("_length2")), columns[0]
    else:
        rows = rows.join(size(1), F.col("chrom_id") == F.col("_id1"), "left")
        problem, key = alignment_problem(F.col("_length1")), columns[0]
    stop = F.raise_error(F.concat_ws(" ", problem, F.lit("in row"), F.col(key).cast("string")))
    guarded = F.when(problem.isNotNull(), stop.cast(rows.schema[key].dataType)).otherwise(F.col(key))
    return rows.withColumn(key, guarded).select(*columns)
