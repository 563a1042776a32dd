"""Genomic intervals: parsing, merging, and predicates that Catalyst can push down."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.schema import InvalidInput

#: Merged intervals up to which a predicate is written out as literals, which reach the Parquet scan.
LITERAL_REGIONS = 64


@dataclass(frozen=True, order=True)
class Region:
    """A 0-based half-open interval of a contig, by its number."""

    contig_id: int
    start: int
    end: int


def parse_region(text: str, contigs: dict[str, tuple[int, int]]) -> Region:
    """``NAME:START-END``; the name may hold colons. ``contigs``: name to (number, length)."""
    m = re.fullmatch(r"(.+):(\d+)-(\d+)", text)
    if not m:
        raise InvalidInput(f"not a region: {text!r}")
    return resolve([(m[1], int(m[2]), int(m[3]))], contigs)[0]


def resolve(regions: Iterable[tuple[str, int, int]], contigs: dict[str, tuple[int, int]]) -> list[Region]:
    out = []
    for name, start, end in regions:
        if name not in contigs:
            raise InvalidInput(f"unknown contig: {name}")
        number, length = contigs[name]
        if not 0 <= start < end <= length:
            raise InvalidInput(f"region outside its contig: {name}:{start}-{end}")
        out.append(Region(number, start, end))
    return out


def merged(regions: Iterable[Region]) -> list[Region]:
    """The union of the intervals; overlapping and touching ones become one."""
    out: list[Region] = []
    for r in sorted(regions):
        if out and out[-1].contig_id == r.contig_id and r.start <= out[-1].end:
            out[-1] = Region(r.contig_id, out[-1].start, max(out[-1].end, r.end))
        else:
            out.append(r)
    return out


def merge_intervals(df: DataFrame, key: str = "contig_id", start: str = "start", end: str = "end") -> DataFrame:
    """The same union for a table of any size: an interval begins a new island if it starts behind all before it."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce((F.col(start) > F.max(end).over(before)).cast("int"), F.lit(1))
    islands = df.select(key, start, end).withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(upto))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlaps(regions: list[Region], contig: Column, start: Column, end: Column) -> Column:
    """Whether ``[start, end)`` overlaps one of the intervals. No interval: never."""
    by_contig: dict[int, list[Region]] = {}
    for r in merged(regions):
        by_contig.setdefault(r.contig_id, []).append(r)
    tests = []
    for number, own in by_contig.items():
        places = [(start < r.end) & (end > r.start) for r in own]
        tests.append((contig == number) & reduce(lambda a, b: a | b, places))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def endpoint(regions: list[Region], side: int) -> Column:
    """Whether end ``side`` of a pair lies in one of the intervals; its position is 1-based."""
    pos = F.col(f"pos{side}")
    return overlaps(regions, F.col(f"chrom{side}_id"), pos - 1, pos)


def semi_join(rows: DataFrame, regions: list[Region], contig: str, start: Column, end: Column) -> DataFrame:
    """Rows that overlap, for region lists too long to be written out: a broadcast left semi join on the
    contig with the range as its residual."""
    table = interval_table(rows.sparkSession, regions)
    return rows.join(F.broadcast(table), (F.col(contig) == F.col("_contig")) & (start < F.col("_end")) & (end > F.col("_start")), "left_semi")


def filter_pairs(pairs: DataFrame, regions: list[Region], mode: str = "either") -> DataFrame:
    """``either``: one end in a region; ``both``: each end in a region, not necessarily the same."""
    if mode not in ("either", "both"):
        raise InvalidInput(f"pairs mode is 'either' or 'both', not {mode!r}")
    if len(merged(regions)) <= LITERAL_REGIONS:
        one, two = endpoint(regions, 1), endpoint(regions, 2)
        return pairs.where(one | two if mode == "either" else one & two)
    in_region = lambda df, n: semi_join(df, regions, f"chrom{n}_id", F.col(f"pos{n}") - 1, F.col(f"pos{n}"))
    if mode == "both":
        return in_region(in_region(pairs, 1), 2)
    # one pass: merged intervals of a contig are disjoint, so each end meets at most one and no row comes twice
    table = interval_table(pairs.sparkSession, regions)
    for n in (1, 2):
        own = table.select(*[F.col(c).alias(f"{c}{n}") for c in table.columns])
        test = (F.col(f"chrom{n}_id") == F.col(f"_contig{n}")) & (F.col(f"pos{n}") - 1 < F.col(f"_end{n}")) & (F.col(f"pos{n}") > F.col(f"_start{n}"))
        pairs = pairs.join(F.broadcast(own), test, "left")
    return pairs.where("_contig1 is not null or _contig2 is not null").drop(*[f"{c}{n}" for c in table.columns for n in (1, 2)])


def interval_table(spark: SparkSession, regions: list[Region]) -> DataFrame:
    """The merged intervals. The list came from the caller, so its size is known and it may be broadcast."""
    return spark.createDataFrame([(r.contig_id, r.start, r.end) for r in merged(regions)], "_contig int, _start bigint, _end bigint")


def filter_alignments(rows: DataFrame, regions: list[Region]) -> DataFrame:
    if len(merged(regions)) <= LITERAL_REGIONS:
        return rows.where(overlaps(regions, F.col("chrom_id"), F.col("start_pos"), F.col("end_pos")))
    return semi_join(rows, regions, "chrom_id", F.col("start_pos"), F.col("end_pos"))
