"""Running numbers over ordered data without a single-task window.

Order is data: rows carry ``_shard`` and ``_row``. Anything that runs over the whole order
is done in two steps, within shards and then over one number for each shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.session import stored


def shard_offsets(sizes: DataFrame, size: str) -> DataFrame:
    """``_shard`` and ``_before``, the sum of ``size`` over earlier shards. One row for each shard reaches the
    driver, which lists the shards' files anyway."""
    before, total = [], 0
    for shard, n in sorted((r["_shard"], r[size]) for r in sizes.select("_shard", size).collect()):
        before.append((shard, total))
        total += n
    return sizes.sparkSession.createDataFrame(before, "_shard int, _before bigint")


def logical_ids(rows: DataFrame, raw: str = "read_idx") -> DataFrame:
    """``logical_id`` 1, 2, 3, …: a new one at each change of the raw id and at each shard's start, in the
    order of ``_shard`` and ``_row``. To be called before any filter."""
    order = Window.partitionBy("_shard").orderBy("_row")
    change = F.coalesce((F.col(raw) != F.lag(raw).over(order)).cast("bigint"), F.lit(1).cast("bigint"))
    rows = rows.withColumn("_change", change)
    local = rows.withColumn("_local", F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = local.groupBy("_shard").agg(F.max("_local").alias("_n"))
    return local.join(F.broadcast(shard_offsets(sizes, "_n")), "_shard").withColumn("logical_id", F.col("_before") + F.col("_local")).drop("_before", "_local", "_change")


def numbered(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``name`` from 1 in the order of the keys. Range partitions are written once and counted; the driver
    adds up one number for each partition."""
    sort = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = stored(sort.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_shard", F.shiftright("_at", 33).cast("int"))
    offsets = shard_offsets(at.groupBy("_shard").agg(F.count("*").alias("_n")), "_n")
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return at.join(F.broadcast(offsets), "_shard").withColumn(name, number).drop("_at", "_shard", "_before")


def decreasing(rows: DataFrame, raw: str = "read_idx") -> DataFrame:
    """Rows whose raw id is less than that of the row before in the same shard."""
    before = F.lag(raw).over(Window.partitionBy("_shard").orderBy("_row"))
    return rows.withColumn("_previous", before).where(F.col(raw) < F.col("_previous"))
