"""Subsets by contigs, regions, read ids and quality.

None is no condition and an empty list matches nothing. Values of one list are
alternatives, lists are joint conditions, and contigs and regions have to hold at the same
end of a pair or at the same alignment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.query import quality
from contactloom.operators.regions import LITERAL_REGIONS, Region, filter_alignments, filter_pairs, merged, overlaps
from contactloom.schema import InvalidInput

MOST_IDS, MOST_ID_BYTES = 100_000, 4 << 20
LITERAL_IDS = 200


def _at_end(contig: str, start: Column, end: Column, chroms: list[int] | None, regions: list[Region] | None) -> Column:
    """Whether contigs and (few) regions hold at one end."""
    tests = [F.lit(True)]
    if chroms is not None:
        tests.append(F.col(contig).isin(chroms) if chroms else F.lit(False))
    if regions is not None:
        tests.append(overlaps(regions, F.col(contig), start, end))
    return reduce(lambda a, b: a & b, tests)


def _within(regions: list[Region] | None, chroms: list[int] | None) -> tuple[list[Region] | None, list[int] | None]:
    """Both conditions as one where there are regions: those that lie in one of the contigs."""
    if regions is None or chroms is None:
        return regions, chroms
    return [r for r in regions if r.contig_id in set(chroms)], None


def _by_id(rows: DataFrame, column: str, ids: list | None) -> DataFrame:
    if ids is None:
        return rows
    text = rows.schema[column].dataType.typeName() == "string"
    if any(isinstance(i, str) != text for i in ids):
        raise InvalidInput("read ids are text for pairs and numbers for alignments")
    if len(ids) > MOST_IDS or sum(len(str(i)) for i in ids) > MOST_ID_BYTES:
        raise InvalidInput("too many read ids")
    if len(ids) <= LITERAL_IDS:
        return rows.where(F.col(column).isin(ids) if ids else F.lit(False))
    # the list is bounded above, so it may be broadcast
    wanted = rows.sparkSession.createDataFrame([(i,) for i in set(ids)], f"{column} {rows.schema[column].dataType.simpleString()}")
    return rows.join(F.broadcast(wanted), column, "left_semi")


def subset_pairs(pairs: DataFrame, min_mapq: int = 0, chroms: list[int] | None = None, regions: list[Region] | None = None, read_ids: list[str] | None = None, mode: str = "either") -> DataFrame:
    if mode not in ("either", "both"):
        raise InvalidInput(f"pairs mode is 'either' or 'both', not {mode!r}")
    rows = _by_id(quality(pairs, min_mapq), "read_id", read_ids)
    if chroms is None and regions is None:
        return rows
    regions, chroms = _within(regions, chroms)
    if regions is not None and len(merged(regions)) > LITERAL_REGIONS:
        return filter_pairs(rows, regions, mode)
    one, two = (_at_end(f"chrom{n}_id", F.col(f"pos{n}") - 1, F.col(f"pos{n}"), chroms, regions) for n in (1, 2))
    return rows.where(one | two if mode == "either" else one & two)


def subset_alignments(
    rows: DataFrame, min_mapq: int = 0, chroms: list[int] | None = None, regions: list[Region] | None = None, read_ids: list[int] | None = None, mode: str = "matching_alignments"
) -> DataFrame:
    found = _by_id(quality(rows, min_mapq), "read_idx", read_ids)
    regions, chroms = _within(regions, chroms)
    if regions is not None and len(merged(regions)) > LITERAL_REGIONS:
        found = filter_alignments(found, regions)
    else:
        found = found.where(_at_end("chrom_id", F.col("start_pos"), F.col("end_pos"), chroms, regions))
    if mode == "matching_alignments":
        return found
    if mode != "complete_reads":
        raise InvalidInput(f"no such mode: {mode!r}")
    return rows.join(found.select("read_idx").distinct(), "read_idx", "left_semi")
