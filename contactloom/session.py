"""Shared storage for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``. Where it isn't set, a session whose
    executors run in the driver's own process gets a temporary one; a cluster's would be written to folders that no other machine
    sees, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with the writer's ``options``, and return the written table.

    This cuts the lineage: a lost executor costs the tasks that read its shuffle files,
    never the work before this table. The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
