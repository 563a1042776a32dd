"""Structured Streaming into a dataset: batches of many producers, numbered without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class SequenceGap(ValueError):
    pass


def ingest(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of rows with ``sequence`` and ``row`` to Parquet, one folder for each micro-batch. A batch
    that is run again after a failure replaces its folder, so every row is written once."""

    def append(batch: DataFrame, number: int) -> None:
        q = "mapq" if "mapq" in batch.columns else "mapping_quality"
        rows = batch.withColumn("qbucket", (F.col(q) >= 1).cast("int"))
        rows.write.mode("overwrite").partitionBy("qbucket").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def finish(rows: DataFrame) -> DataFrame:
    """The ingested rows in order of sequence and row, as _shard and _row; a gap in the sequence is an error."""
    seen = rows.agg(F.countDistinct("sequence").alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high")).first()
    if seen["n"] and (seen["low"] != 0 or seen["high"] != seen["n"] - 1):
        raise SequenceGap(f"{seen['n']} batches are numbered from {seen['low']} to {seen['high']}")
    return rows.withColumnsRenamed({"sequence": "_shard", "row": "_row"}).withColumn("_shard", F.col("_shard").cast("int")).drop("batch", "qbucket")
