"""Shards along a Hilbert curve over several metadata columns.

Each column is quantised by its own quantiles over all rows, text columns by whole values in their order weighted by their rows, so that hot values take
several levels' worth of rows without starving the others; the levels are the coordinates
of a Hilbert curve, rows are sorted by curve index, and the order is cut into runs of
equal row counts. Neighbours on the curve are near in every column, so a shard spans a
small range of each and files are pruned by any of them.

Only ids, metadata, size and checksum are shuffled, never texts. Ties on the curve are
broken by checksum and id, so copies stay together where a cell allows and no cell, however
hot, has to fit one task. Ranks come from the sorted table's partition sizes: the driver
holds one number for each partition.

Defined results: of a text, however long, only size and checksum leave the row; a null text has size 16 and checksum 0; null metadata takes the lowest
level; repeated rows take a slot each; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import stored
from contactloom.operators.ids import shard_offsets

#: Bits of a coordinate: a column has up to 64 levels.
BITS = 6


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the curve of points with whole coordinates below ``2**bits``, one row each.

    A point is carried down from the largest quadrant: where a coordinate's bit is set the
    lower bits of the first are inverted, else those of both are exchanged; the bits, Gray
    decoded, are the index.
    """
    x = [coordinates[:, d].astype(np.int64) for d in range(coordinates.shape[1])]
    for level in range(bits - 1, 0, -1):
        half, low = 1 << level, (1 << level) - 1
        for d in range(len(x)):
            set_ = (x[d] & half) > 0
            exchanged = (x[0] ^ x[d]) & low
            inverted = np.where(set_, x[0] ^ low, x[0] ^ exchanged)
            if d:
                x[d] = np.where(set_, x[d], x[d] ^ exchanged)
            x[0] = inverted
    bit = [(v >> level) & 1 for level in range(bits - 1, -1, -1) for v in x]
    gray, index = np.zeros_like(x[0]), np.zeros_like(x[0])
    for b in bit:
        gray ^= b
        index = (index << 1) | gray
    return index


def string_cuts(rows: DataFrame, column: str, levels: int) -> list[str]:
    """The first value of each level when the values, in their order and weighted by their rows, are cut into levels.

    Distinct values are counted, range partitioned and summed up partition by partition, so a column may
    have any number of them, of any length; the driver gets a number for each partition and a value for each level.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).repartitionByRange(column).sortWithinPartitions(column)
    counted = stored(counted.withColumn("_at", F.monotonically_increasing_id()), "values").withColumn("_shard", F.shiftright("_at", 33).cast("int"))
    sizes = counted.groupBy("_shard").agg(F.sum("_n").alias("_n"))
    offsets = shard_offsets(sizes, "_n")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.expr(f"(_before + _inner) * {levels} div {max(total, 1)}")
    found = counted.withColumn("_inner", inner).join(F.broadcast(offsets), "_shard").groupBy(level.alias("level")).agg(F.min(column).alias("value")).collect()
    return sorted(r["value"] for r in found)


def hilbert_sharded(rows: DataFrame, dimensions: dict[str, str], shards: int, ties: list[str]) -> DataFrame:
    """``rows`` with curve, shard and slot. ``dimensions``: column names to types ('string' or other)."""
    names = list(dimensions)
    numbers = [c for c in names if dimensions[c] != "string"]
    shares = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    row = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in numbers]).first()
    cuts = {c: np.unique(np.array(row[c] if row[c] is not None else [], dtype=np.float64)) for c in numbers}
    cuts |= {c: np.array(string_cuts(rows, c, 1 << BITS), dtype=object) for c in names if c not in numbers}

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        levels = []
        for c, v in zip(names, columns, strict=True):
            # a value's level is the number of the cut at or before it; nulls take the lowest
            code, values = pd.factorize(v)
            at = np.searchsorted(cuts[c], values.to_numpy() if isinstance(values, pd.Index) else values, side="right" if c not in numbers else "left")
            at = np.maximum(at - 1, 0) if c not in numbers else at
            levels.append(np.where(code < 0, 0, np.append(at, 0)[code]))
        return pd.Series(hilbert_index(np.stack(levels, axis=1), BITS))

    placed = rows.withColumn("curve", curve(*[F.col(c) if c not in numbers else F.col(c).cast("double") for c in names]))
    order = ["curve", *ties]
    # the low 33 bits of this id count the rows of a partition, the others its partition
    placed = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "hilbert")
    part, row_in = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_shard")).agg(F.count("*").alias("_n"))
    offsets = shard_offsets(sizes, "_n")
    total = row["n"]
    ranked = placed.withColumn("_shard", part).join(F.broadcast(offsets), "_shard").withColumn("_rank", F.col("_before") + row_in)
    shard = F.expr(f"_rank * {shards} div {max(total, 1)}")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", F.col("_rank") - first).drop("_shard", "_before", "_rank", "_at")


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shards of documents by source, language and size under the law of equal row counts."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    out = hilbert_sharded(rows, {"source": "string", "lang": "string", "size": "long"}, shards, ["text_crc32", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang")


def pruning_table(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and the range of each column by shard: what a reader prunes files with."""
    ranges = reduce(lambda a, c: [*a, F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")], columns, [])
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ranges)
