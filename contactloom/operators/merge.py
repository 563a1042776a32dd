"""Datasets joined end to end: one contig dictionary, order kept, read ids renumbered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.ids import numbered
from contactloom.schema import InvalidInput


def contig_union(sources: list[DataFrame]) -> DataFrame:
    """new_id, contig, length: names in the order in which they first come. Lengths of a name have to agree.
    Dictionaries are small by contract, so their numbering may take one task."""
    tagged = [c.select(F.lit(i).alias("_source"), "contig_id", "contig", "length") for i, c in enumerate(sources)]
    joined = reduce(DataFrame.unionByName, tagged).groupBy("contig").agg(F.min(F.struct("_source", "contig_id")).alias("_first"), F.min("length").alias("length"), F.max("length").alias("_most"))
    same = F.when(F.col("length") == F.col("_most"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("lengths differ for contig "), F.col("contig"))).cast("bigint"))
    return joined.select((F.row_number().over(Window.orderBy("_first")) - 1).cast("int").alias("new_id"), "contig", same.alias("length"))


def remapped(rows: DataFrame, contigs: DataFrame, union: DataFrame, columns: list[str]) -> DataFrame:
    """Contig numbers of a source turned into those of the union."""
    numbers = contigs.join(F.broadcast(union.select("contig", "new_id")), "contig").select("contig_id", "new_id")
    for c in columns:
        own = numbers.select(F.col("contig_id").alias(c), F.col("new_id").alias(f"_{c}"))
        rows = rows.join(F.broadcast(own), c).withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return rows


def merge_pairs(sources: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """All pairs of (pairs, contigs) sources with ``source``; ids and equal rows stay as they are."""
    union = contig_union([c for _, c in sources])
    parts = [remapped(rows, contigs, union, ["chrom1_id", "chrom2_id"]).withColumn("source", F.lit(i)) for i, (rows, contigs) in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts)


def merged_ids(sources: list[DataFrame]) -> DataFrame:
    """source, old_id and new_id of the reads of all sources, numbered from 1 in the order of source and id."""
    parts = [rows.select(F.lit(i).alias("source"), F.col("read_idx").alias("old_id")).distinct() for i, rows in enumerate(sources)]
    return numbered(reduce(DataFrame.unionByName, parts), ["source", "old_id"], "new_id")


def merge_alignments(sources: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    union = contig_union([c for _, c in sources])
    parts = [remapped(rows, contigs, union, ["chrom_id"]).withColumn("source", F.lit(i)) for i, (rows, contigs) in enumerate(sources)]
    ids = merged_ids([rows for rows, _ in sources])
    rows = reduce(DataFrame.unionByName, parts).withColumnRenamed("read_idx", "old_id")
    return rows.join(ids, ["source", "old_id"]).withColumnRenamed("new_id", "read_idx").drop("old_id")


def merge_copy_numbers(sources: list[DataFrame]) -> DataFrame:
    """contig and cn where some source declares one. A source without a declaration has no opinion; two different ones are an error."""
    if not sources:
        raise InvalidInput("nothing to merge")
    joined = reduce(DataFrame.unionByName, sources).groupBy("contig").agg(F.min("cn").alias("cn"), F.max("cn").alias("_most"))
    return joined.select("contig", F.when(F.col("cn") == F.col("_most"), F.col("cn")).otherwise(F.raise_error(F.concat(F.lit("copy numbers differ for "), F.col("contig"))).cast(joined.schema["cn"].dataType)).alias("cn"))


def effective_copy_numbers(contigs: DataFrame, declared: DataFrame) -> DataFrame:
    """contig and cn for all contigs; 1 where none is declared."""
    return contigs.join(F.broadcast(declared), "contig", "left").select("contig", F.coalesce("cn", F.lit(1)).cast("bigint").alias("cn"))
