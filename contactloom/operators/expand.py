"""All pairs of the alignments of a read.

One shuffle: alignments are gathered by read into an array sorted by place in the read. The
array is filtered by the number of alignments before any pair exists. The left alignment
of each pair is exploded first and carries only the tail of the array, so a read's pairs
are produced row by row, never as one nested array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIDPOINT, LEFTMOST, FIVE_PRIME = "midpoint", "leftmost", "five_prime"


def position(kind: str, of: Column) -> Column:
    """The 1-based position that stands for an alignment."""
    if kind == MIDPOINT:
        return of.start_pos + F.floor((of.end_pos - of.start_pos) / 2).cast("bigint") + 1
    if kind == LEFTMOST:
        return of.start_pos + 1
    return F.when(of.strand == "-", of.end_pos).otherwise(of.start_pos + 1)


def gathered(rows: DataFrame, keys: list[str], order: list[str], min_order: int, max_order: int | None) -> DataFrame:
    """keys and ``_read``: the alignments of each group with at least min_order and fewer than max_order."""
    fields = [*order, "chrom_id", "start_pos", "end_pos", "strand", "mapping_quality"]
    fields = list(dict.fromkeys(fields))
    read = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_read"))
    read = read.where(F.size("_read") >= max(min_order, 2))
    return read if max_order is None else read.where(F.size("_read") < max_order)


def paired(reads: DataFrame, name: Column, kind: str, canonical: bool) -> DataFrame:
    """Pairs of each ``_read``. ``canonical``: the end with the lower contig and position comes first;
    the numbers in the pair's id keep the order of the read."""
    # the sizes bound the loop, so the second explode sees only alignments behind the first
    left = reads.select(name.alias("_name"), "_read", F.posexplode("_read").alias("_i", "_a"))
    tail = F.slice("_read", F.col("_i") + 2, F.size("_read"))
    both = left.select("_name", "_i", "_a", F.posexplode(tail).alias("_k", "_b"))
    both = both.select("_name", "_i", (F.col("_i") + F.col("_k") + 1).alias("_j"), *[F.struct(F.col(f"{s}.chrom_id").alias("chrom"), position(kind, F.col(s)).alias("pos"), F.col(f"{s}.strand").alias("strand"), F.col(f"{s}.mapping_quality").alias("mapq")).alias(s) for s in ("_a", "_b")])
    swap = F.struct("_a.chrom", "_a.pos") > F.struct("_b.chrom", "_b.pos") if canonical else F.lit(False)
    first = lambda f: F.when(swap, F.col(f"_b.{f}")).otherwise(F.col(f"_a.{f}"))
    second = lambda f: F.when(swap, F.col(f"_a.{f}")).otherwise(F.col(f"_b.{f}"))
    return both.select(
        F.concat_ws(":", "_name", "_i", "_j").alias("read_id"),
        first("chrom").alias("chrom1_id"),
        first("pos").alias("pos1"),
        second("chrom").alias("chrom2_id"),
        second("pos").alias("pos2"),
        first("strand").alias("strand1"),
        second("strand").alias("strand2"),
        F.least("_a.mapq", "_b.mapq").alias("mapq"),
    )


def expand(rows: DataFrame, min_mapq: int = 0, min_order: int = 2, max_order: int | None = None) -> DataFrame:
    """concat2pairs: pairs of midpoints, ends in the order of the read. Numbers of alignments count after the
    quality filter; max_order is exclusive."""
    kept = rows.where(F.col("mapping_quality") >= min_mapq) if min_mapq else rows
    reads = gathered(kept, ["read_idx"], ["read_start", "source_row"], min_order, max_order)
    return paired(reads, F.col("read_idx").cast("string"), MIDPOINT, canonical=False)
