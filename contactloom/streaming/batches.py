"""Rows of a dataset in bounded batches, in order, on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row

from contactloom.schema import InvalidInput

MOST_ROWS = (1 << 32) - 1


def batches(rows: DataFrame, batch_rows: int = 65_536, boundary: str = "rows") -> Iterator[list[Row]]:
    """Lists of at most ``batch_rows`` rows. Boundary ``complete_reads``: a read is never split, so a batch ends
    before the read that would pass the bound, and a longer read is alone in its batch."""
    if not 1 <= batch_rows <= MOST_ROWS:
        raise InvalidInput("a batch has at least one row")
    if boundary not in ("rows", "complete_reads"):
        raise InvalidInput(f"no such boundary: {boundary!r}")
    order = [c for c in ("_shard", "_row") if c in rows.columns]
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    out: list[Row] = []
    stream = rows.toLocalIterator(prefetchPartitions=True)
    reads = ([r] for r in stream) if boundary == "rows" else (list(g) for _, g in groupby(stream, key=lambda r: r["read_idx"]))
    for read in reads:
        if out and len(out) + len(read) > batch_rows:
            yield out
            out = []
        out.extend(read)
    if out:
        yield out
