"""Region queries on pairs and alignments, ordered limits and query diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.regions import Region, filter_alignments, filter_pairs
from contactloom.schema import InvalidInput


def quality(rows: DataFrame, min_mapq: int) -> DataFrame:
    """Rows of at least this mapping quality. 0 keeps all; positive bounds prune the quality partition."""
    if not 0 <= min_mapq <= 255:
        raise InvalidInput("mapping quality is from 0 to 255")
    column = "mapq" if "mapq" in rows.columns else "mapping_quality"
    if min_mapq and "qbucket" in rows.columns:
        rows = rows.where("qbucket = 1")
    return rows.where(F.col(column) >= min_mapq) if min_mapq else rows


def query_pairs(pairs: DataFrame, regions: list[Region] | None = None, min_mapq: int = 0, mode: str = "either") -> DataFrame:
    """Pairs in the regions (None: everywhere, []: nowhere). Equal rows are all returned."""
    rows = quality(pairs, min_mapq)
    return rows if regions is None else filter_pairs(rows, regions, mode)


def query_alignments(rows: DataFrame, regions: list[Region] | None = None, min_mapq: int = 0, filter_mode: str = "matching_alignments") -> DataFrame:
    """``matching_alignments``: rows in a region with the quality. ``complete_reads``: all rows, of any
    quality, of the reads that have such a row."""
    found = quality(rows, min_mapq)
    found = found if regions is None else filter_alignments(found, regions)
    if filter_mode == "matching_alignments":
        return found
    if filter_mode != "complete_reads":
        raise InvalidInput(f"no such filter mode: {filter_mode!r}")
    if regions is None and not min_mapq:
        return rows
    return rows.join(found.select("read_idx").distinct(), "read_idx", "left_semi")


def head(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows of the dataset's order: one top-n without a full sort."""
    return rows.orderBy(*order).limit(n)


def query_stats(rows: DataFrame, result: DataFrame, min_mapq: int, files_total: int, files_read: int, fallback: str | None = None) -> dict:
    """What a query did: source quality, files of the zone map taken and skipped, rows returned."""
    return {
        "source_quality": "q1" if min_mapq else "q0",
        "index_used": files_read < files_total,
        "fallback_reason": fallback,
        "total_row_groups": files_total,
        "candidate_row_groups": files_read,
        "decoded_row_groups": files_read,
        "skipped_row_groups": files_total - files_read,
        "decoded_rows": rows.count(),
        "returned_rows": result.count(),
        "complete": True,
    }
