"""Zone maps: where each part of a dataset has rows, to read fewer files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.regions import Region, merged


def zone_map(rows: DataFrame, part: Column) -> DataFrame:
    """part, contig_id, endpoint, min_start, max_end, max_mapq. Pairs have endpoints 1 and 2, alignments 0."""
    if "chrom1_id" in rows.columns:
        ends = F.array(*[F.struct(F.lit(n).alias("endpoint"), F.col(f"chrom{n}_id").alias("contig_id"), (F.col(f"pos{n}") - 1).alias("s"), F.col(f"pos{n}").alias("e")) for n in (1, 2)])
        quality = F.col("mapq")
    else:
        ends = F.array(F.struct(F.lit(0).alias("endpoint"), F.col("chrom_id").alias("contig_id"), F.col("start_pos").alias("s"), F.col("end_pos").alias("e")))
        quality = F.col("mapping_quality")
    flat = rows.select(part.alias("part"), quality.alias("_q"), F.explode(ends).alias("_x"))
    return flat.groupBy("part", F.col("_x.contig_id").alias("contig_id"), F.col("_x.endpoint").alias("endpoint")).agg(F.min("_x.s").alias("min_start"), F.max("_x.e").alias("max_end"), F.max("_q").alias("max_mapq"))


def candidate_parts(zones: DataFrame, regions: list[Region], min_mapq: int = 0, mode: str = "either") -> DataFrame:
    """Parts that may hold a row of the query. For ``both``, each end needs a zone of its own that overlaps."""
    table = zones.sparkSession.createDataFrame([(r.contig_id, r.start, r.end) for r in merged(regions)], "_contig int, _start bigint, _end bigint")
    test = (F.col("contig_id") == F.col("_contig")) & (F.col("min_start") < F.col("_end")) & (F.col("max_end") > F.col("_start"))
    near = zones.where(F.col("max_mapq") >= min_mapq).join(F.broadcast(table), test, "left_semi")
    if mode == "both":
        return near.groupBy("part").agg(F.countDistinct("endpoint").alias("_n")).where("_n = 2").select("part")
    return near.select("part").distinct()
