"""Binned contact matrices: sparse, symmetric, upper triangle, with their indexes.

Binning is a projection and one hash aggregate with partial sums on the map side; contig
offsets are a small broadcast table. Prefix sums over all bins run contig by contig with
one number for each contig on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.schema import InvalidInput
from contactloom.session import stored


def bin_counts(contigs: DataFrame, bin_size: int) -> DataFrame:
    if bin_size < 1:
        raise InvalidInput("a bin has at least one base")
    return contigs.withColumn("n_bins", F.expr(f"(length + {bin_size} - 1) div {bin_size}"))


def chrom_offset(contigs: DataFrame, bin_size: int) -> DataFrame:
    """contig_id and the number of bins before the contig. Contigs are a dictionary that is broadcast anyway,
    so one task may run over them."""
    before = Window.orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)
    return bin_counts(contigs, bin_size).select("contig_id", F.coalesce(F.sum("n_bins").over(before), F.lit(0)).cast("bigint").alias("offset"))


def bin_table(contigs: DataFrame, bin_size: int) -> DataFrame:
    """contig_id, bin_id over all contigs, start and end of each bin; the last bin of a contig may be short."""
    bins = bin_counts(contigs, bin_size).where("n_bins > 0").join(F.broadcast(chrom_offset(contigs, bin_size)), "contig_id")
    bins = bins.select("contig_id", "length", "offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1)).alias("_k"))
    return bins.select("contig_id", (F.col("offset") + F.col("_k")).alias("bin_id"), (F.col("_k") * bin_size).alias("start"), F.least((F.col("_k") + 1) * bin_size, F.col("length")).alias("end"))


def pixels(pairs: DataFrame, contigs: DataFrame, bin_size: int, min_mapq: int = 0, check_positions: bool = True) -> DataFrame:
    """bin1 <= bin2 and the number of pairs. Low quality goes before positions are checked."""
    rows = pairs.where(skipped(pairs, min_mapq).isNull()) if min_mapq or "skip" in pairs.columns else pairs
    return _binned(rows, contigs, bin_size, check_positions).select("bin1", "bin2", "count")


def skipped(pairs: DataFrame, min_mapq: int) -> Column:
    """Why a pair isn't binned ('unmapped' or 'mapq'), or null. Pairs text says so in ``skip``."""
    reason = F.when(F.col("mapq") < min_mapq, "mapq")
    return F.coalesce("skip", reason) if "skip" in pairs.columns else reason


#: Why a pair has no bins, as keys in place of theirs.
NO_BINS = {"mapq": -1, "unmapped": -2}


def _binned(rows: DataFrame, contigs: DataFrame, bin_size: int, check_positions: bool = True) -> DataFrame:
    """bin1, bin2 and count; rows with a reason to be skipped (column _skip) have one of NO_BINS as bin1.

    Both bins make one whole number, bin1 times all bins plus bin2, so that the aggregate's key is as cheap as can be.
    """
    bins = bin_counts(contigs, bin_size)
    total = bins.agg(F.greatest(F.sum("n_bins"), F.lit(1)).cast("bigint").alias("_bins"))
    where = contigs.select("contig_id", "length").join(chrom_offset(contigs, bin_size), "contig_id").join(F.broadcast(total), F.lit(True))
    for side in (1, 2):
        own = where.select(F.col("contig_id").alias(f"chrom{side}_id"), F.col("offset").alias(f"_offset{side}"), F.col("length").alias(f"_length{side}"), *(["_bins"] if side == 1 else []))
        rows = rows.join(F.broadcast(own), f"chrom{side}_id", "left" if check_positions else "inner")

    def bin_of(side: int) -> Column:
        at = F.col(f"_offset{side}") + F.expr(f"(pos{side} - 1) div {bin_size}")
        if not check_positions:
            return at
        outside = F.coalesce((F.col(f"pos{side}") < 1) | (F.col(f"pos{side}") > F.col(f"_length{side}")), F.lit(True))
        return F.when(outside, F.raise_error(F.concat(F.lit("position outside its contig: "), F.col(f"pos{side}").cast("string"))).cast("bigint")).otherwise(at)

    key = F.least(bin_of(1), bin_of(2)) * F.col("_bins") + F.greatest(bin_of(1), bin_of(2))
    if "_skip" in rows.columns:
        for reason, code in NO_BINS.items():
            key = F.when(F.col("_skip") == reason, F.lit(code).cast("bigint")).otherwise(key)
    found = rows.groupBy(key.alias("_key")).agg(F.count("*").alias("count")).join(F.broadcast(total), F.lit(True))
    first = F.when(F.col("_key") < 0, F.col("_key")).otherwise(F.expr("_key div _bins"))
    return found.select(first.alias("bin1"), F.pmod("_key", "_bins").alias("bin2"), "count")


def bin1_offset(pixels_: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """For each bin, and one past the last, the number of pixels whose first bin lies before it."""
    bins = bin_table(contigs, bin_size).select("contig_id", F.col("bin_id").alias("bin1"))
    # written once: the pixels behind it may be dear, and it has one row for each bin
    counts = bins.join(pixels_.groupBy("bin1").agg(F.count("*").alias("_n")), "bin1", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    counts = stored(counts, "bin-counts")
    own = Window.partitionBy("contig_id").orderBy("bin1").rowsBetween(Window.unboundedPreceding, -1)
    per = counts.groupBy("contig_id").agg(F.sum("_n").alias("_all"))
    before = per.select("contig_id", F.coalesce(F.sum("_all").over(Window.orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = counts.withColumn("_within", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(F.broadcast(before), "contig_id")
    out = out.select("bin1", (F.col("_before") + F.col("_within")).cast("bigint").alias("offset"))
    end = bin_counts(contigs, bin_size).agg(F.coalesce(F.sum("n_bins"), F.lit(0)).cast("bigint").alias("bin1"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("offset"))
    return out.unionByName(end.join(F.broadcast(total), F.lit(True)).select("bin1", "offset"))


def cool_summary(pairs: DataFrame, contigs: DataFrame, bin_size: int, min_mapq: int = 0) -> DataFrame:
    """One row, from one pass over the pairs: nnz, sum, nbins, nchroms, input_records, skipped_mapq, skipped_unmapped."""
    found = _binned(pairs.withColumn("_skip", skipped(pairs, min_mapq)), contigs, bin_size)
    rows = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0)).cast("bigint")
    kept = F.col("bin1") >= 0
    totals = found.agg(
        F.count(F.when(kept, 1)).alias("nnz"),
        rows(kept).alias("sum"),
        rows(F.lit(True)).alias("input_records"),
        rows(F.col("bin1") == NO_BINS["mapq"]).alias("skipped_mapq"),
        rows(F.col("bin1") == NO_BINS["unmapped"]).alias("skipped_unmapped"),
    )
    size = bin_counts(contigs, bin_size).agg(F.coalesce(F.sum("n_bins"), F.lit(0)).cast("bigint").alias("nbins"), F.count("*").alias("nchroms"))
    return totals.join(F.broadcast(size), F.lit(True))
