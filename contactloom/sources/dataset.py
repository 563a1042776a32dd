"""Datasets on disk: opening, scanning and atomic writing.

Two layouts are read. In the exchange layout ``q0/`` has all rows and ``q1/`` a second copy
of those with quality; contigs are names, integers unsigned. In the native layout rows lie
once, under ``qbucket=0`` and ``qbucket=1``, with contig numbers and signed integers, so a
quality bound prunes a partition and positions prune row groups; ``_ord`` holds the place of each row in the
dataset's order, which survives the split: the writing task above, the row in it below.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.ids import logical_ids, shard_offsets
from contactloom.operators.query import quality
from contactloom.operators.validate import counts
from contactloom.schema import CONCAT_COLUMNS, CONCAT_DDL, PAIRS_COLUMNS, PAIRS_DDL, InvalidInput, checked
from contactloom.session import stored
from contactloom.sources import metadata as meta
from contactloom.sources.files import Folder, checked_contigs, contig_frame

#: Bits of ``_ord`` that count the rows of a task.
ROW_BITS = 33
#: Columns that give the order of rows that are to be written.
ORDER = ("source", "_shard", "_row")

#: Exchange column names of our columns.
NAMES = {
    "pairs": {"read_idx": "read_id", "chrom1": "chrom1_id", "chrom2": "chrom2_id"},
    "concat": {"chrom": "chrom_id", "start": "start_pos", "end": "end_pos"},
}
CODECS = {"zstd": "zstd", "gzip": "gzip", "snappy": "snappy", "lz4": "lz4_raw", "uncompressed": "uncompressed"}
LEVELS = {"zstd": (1, 22), "gzip": (0, 9)}


@dataclass
class Dataset:
    spark: SparkSession
    path: str
    kind: str
    metadata: dict
    contigs: list[tuple[str, int]]
    native: bool

    @property
    def scope(self) -> str:
        return self.metadata.get("read_idx_scope", "global")

    def contig_table(self) -> DataFrame:
        return contig_frame(self.spark, self.contigs)

    def contig_numbers(self) -> dict[str, tuple[int, int]]:
        return {n: (i, length) for i, (n, length) in enumerate(self.contigs)}

    def shards(self, quality_name: str = "q0") -> list[str]:
        """Files of a quality in their order: numbered ones by number, then the others by name."""
        folder = Folder(self.spark, f"{self.path}/{quality_name}")
        names = [n for n, _ in folder.names() if n.endswith(".parquet")] if folder.exists() else []
        number = lambda n: (0, int(n[:-8]), n) if n[:-8].isdigit() else (1, 0, n)
        return sorted(names, key=number)

    def scan(self, min_mapq: int = 0, complete: bool = False, ordered: bool = False, files: list[str] | None = None, with_file: bool = False) -> DataFrame:
        """Rows with contig numbers; ``ordered`` adds _shard and _row, ``with_file`` the name of the file. ``files``:
        those to read, relative to the dataset. Ids that count within shards become running ids over all rows
        before anything is filtered."""
        local = self.kind == "concat" and self.scope == "shard"
        columns = PAIRS_COLUMNS if self.kind == "pairs" else CONCAT_COLUMNS
        if self.native:
            rows = read_buckets(self.spark, self.path, self.kind, files)
            rows = rows.withColumn("_file", F.col("_metadata.file_name")) if with_file else rows
            rows = rows.withColumns({"_shard": F.shiftright("_ord", ROW_BITS).cast("int"), "_row": F.col("_ord").bitwiseAND((1 << ROW_BITS) - 1)}) if ordered else rows
            return quality(rows, 0 if complete else min_mapq).select(*columns, *(["_shard", "_row"] if ordered else []), *(["_file"] if with_file else []))
        name = "q1" if min_mapq and not complete and not local else "q0"
        shards = self.shards(name)
        taken = shards if files is None else [f.rpartition("/")[2] for f in files]
        if not taken:
            empty = self.spark.createDataFrame([], PAIRS_DDL if self.kind == "pairs" else CONCAT_DDL)
            return empty.withColumns({"_shard": F.lit(0), "_row": F.lit(0).cast("bigint")}) if ordered else empty
        rows = self.spark.read.parquet(*[f"{self.path}/{name}/{f}" for f in taken])
        if with_file:
            rows = rows.withColumn("_file", F.col("_metadata.file_name"))
        for old, new in NAMES[self.kind].items():
            rows = rows.withColumnRenamed(old, new)
        if ordered or local:
            # shards may be many thousands, too many for a list that is searched for each row
            rows = rows.withColumns({"_name": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
            if shards == [f"{i}.parquet" for i in range(len(shards))]:
                rows = rows.withColumn("_shard", F.split_part("_name", F.lit("."), F.lit(1)).cast("int")).drop("_name")
            else:
                places = self.spark.createDataFrame(list(enumerate(shards)), "_shard int, _name string")
                rows = rows.join(F.broadcast(places), "_name").drop("_name")
        numbers = self.contig_table()
        for c in ("chrom1_id", "chrom2_id") if self.kind == "pairs" else ("chrom_id",):
            own = numbers.select(F.col("contig").alias(c), F.col("contig_id").alias("_number"))
            unknown = F.raise_error(F.concat(F.lit("unknown contig: "), F.col(c))).cast("int")
            rows = rows.join(F.broadcast(own), c, "left").withColumn(c, F.coalesce("_number", F.when(F.col(c).isNotNull(), unknown))).drop("_number")
        ddl = PAIRS_DDL if self.kind == "pairs" else CONCAT_DDL
        for field in ddl.split(", "):
            n, t = field.split()
            if n != "read_idx" or self.kind == "concat":
                rows = rows.withColumn(n, F.col(n).cast("decimal(20,0)" if n == "read_idx" else t))
        if local:
            rows = logical_ids(rows).withColumn("read_idx", F.col("logical_id")).drop("logical_id")
        return quality(rows, min_mapq if not complete else 0).select(*columns, *(["_shard", "_row"] if ordered else []), *(["_file"] if with_file else []))


def read_buckets(spark: SparkSession, path: str, kind: str, files: list[str] | None = None) -> DataFrame:
    """Rows of the native layout with ``qbucket``; the folders are named, as the dataset's own files lie beside them."""
    ddl = (PAIRS_DDL if kind == "pairs" else CONCAT_DDL) + ", _ord bigint, qbucket int"
    found = [f"{path}/qbucket={q}" for q in (0, 1) if Folder(spark, f"{path}/qbucket={q}").exists()]
    found = found if files is None else [f"{path}/{f}" for f in files]
    return spark.read.schema(ddl).option("basePath", path).parquet(*found) if found else spark.createDataFrame([], ddl)


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    folder = Folder(spark, path)
    if not folder.is_folder():
        raise FileNotFoundError(path)
    data = meta.checked(meta.parse_literal(folder.read("_metadata")))
    contigs = checked_contigs([(n, int(length)) for n, length in (line.split("\t") for line in folder.read("_contigsizes").decode().splitlines() if line)])
    return Dataset(spark, path, data["format"], data, contigs, not folder.exists("q0"))


def codec(name: str = "zstd", level: int | None = None) -> dict[str, str]:
    """Writer options of a compression. Brotli's class isn't part of Spark."""
    if name not in CODECS:
        raise InvalidInput(f"no such compression: {name!r}")
    if level is not None:
        low, high = LEVELS.get(name, (None, None))
        if low is None or not low <= level <= high:
            raise InvalidInput(f"{name} has no level {level}")
    options = {"compression": CODECS[name]}
    if level is not None:
        options[{"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level"}[name]] = str(level)
    return options


def write_dataset(rows: DataFrame, path: str, kind: str, contigs: list[tuple[str, int]], layout: str = "native", chunk_size: int = 1_000_000, compression: str = "zstd", level: int | None = None, sidecars: dict[str, str] | None = None) -> dict:
    """Check every row and write a dataset that appears whole or not at all; returns its counts.

    Rows keep the order of ``source``, ``_shard`` and ``_row`` where they have such columns, else that in which they
    come. In the exchange layout no shard has more than ``chunk_size`` rows, but for one that a longer read has to itself:
    a read's alignments stay in one shard.
    """
    spark = rows.sparkSession
    checked_contigs(contigs)
    if chunk_size < 1:
        raise InvalidInput("a shard has at least one row")
    target = Folder(spark, path)
    if target.exists():
        raise FileExistsError(path)
    part = Folder(spark, f"{path}.partial-{uuid.uuid4().hex[:8]}")
    columns = PAIRS_COLUMNS if kind == "pairs" else CONCAT_COLUMNS
    order = [c for c in ORDER if c in rows.columns]
    kinds = dict(f.split() for f in (PAIRS_DDL if kind == "pairs" else CONCAT_DDL).split(", "))
    typed = [F.col(c).cast(kinds[c]).alias(c) if c != "read_idx" or layout == "native" else F.col(c) for c in columns]
    rows = checked(rows.select(*typed, *order), contig_frame(spark, contigs))
    try:
        q = "mapq" if kind == "pairs" else "mapping_quality"
        contig_columns = ("chrom1_id", "chrom2_id") if kind == "pairs" else ("chrom_id",)
        if layout == "exchange":
            for c in contig_columns:
                own = contig_frame(spark, contigs).select(F.col("contig_id").alias(c), F.col("contig").alias("_name"))
                rows = rows.join(F.broadcast(own), c).withColumn(c, F.col("_name")).drop("_name")
        # the sort comes last: Spark drops one that has a join behind it
        if kind == "concat" and layout == "exchange":
            rows = in_chunks(rows, chunk_size, order)
        elif kind == "concat":
            rows = rows.repartitionByRange("read_idx").sortWithinPartitions("read_idx", *order)
        elif order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        options = codec(compression, level) | ({"maxRecordsPerFile": str(chunk_size)} if kind == "pairs" or layout == "native" else {})
        if layout == "native":
            rows.drop(*order).withColumns({"_ord": F.monotonically_increasing_id(), "qbucket": (F.col(q) >= 1).cast("int")}).write.options(**options).partitionBy("qbucket").parquet(part.path)
            written = read_buckets(spark, part.path, kind)
        elif layout == "exchange":
            names = {new: old for old, new in NAMES[kind].items()}
            out = rows.select(*[F.col(c).alias(names.get(c, c)) for c in columns], *(["_chunk"] if kind == "concat" else []))
            if kind == "concat":
                out.write.options(**options).partitionBy("_chunk").parquet(f"{part.path}/q0")
            else:
                out.write.options(**options).parquet(f"{part.path}/q0")
            _number_shards(Folder(spark, f"{part.path}/q0"))
            written = spark.read.schema(out.drop("_chunk").schema).parquet(f"{part.path}/q0")
            # the second copy has the order of the first, file by file
            number = F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("int")
            copy = written.withColumns({"_shard": number, "_row": F.col("_metadata.row_index")}).where(F.col(q) >= 1)
            # and its shards: fewer rows each, so none is too large and no read is split
            copy = copy.withColumnRenamed("_shard", "_chunk").repartition("_chunk").sortWithinPartitions("_chunk", "_row").drop("_row")
            copy.write.options(**options).partitionBy("_chunk").parquet(f"{part.path}/q1")
            _number_shards(Folder(spark, f"{part.path}/q1"))
        else:
            raise InvalidInput(f"no such layout: {layout!r}")
        found = {k: int(v or 0) for k, v in counts(written).first().asDict().items()}
        names = {"q0_reads": "q0_concats", "q1_reads": "q1_concats"}
        part.write("_contigsizes", "".join(f"{n}\t{length}\n" for n, length in contigs))
        part.write("_metadata", meta.literal(_describe(kind, chunk_size)))
        part.write("_metadata_counts", "".join(f"{names.get(k, k)}\t{v}\n" for k, v in found.items()))
        part.write("_readme", "All records; those with MAPQ >= 1 lie under qbucket=1 or q1.\n")
        for name, text in (sidecars or {}).items():
            part.write(name, text)
        part.move_to(path)
    except BaseException:
        part.remove()
        raise
    return found


def in_chunks(rows: DataFrame, chunk_size: int, order: list[str]) -> DataFrame:
    """Alignments with ``_chunk``, numbers of shards in the order of the reads, one task and file for each. Reads are
    counted and cut into chunks within range partitions; the driver adds up one number for each of these."""
    reads = rows.groupBy("read_idx").agg(F.count("*").alias("_n")).repartitionByRange("read_idx").sortWithinPartitions("read_idx")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk, used = TaskContext.get().partitionId(), 0, 0
        for frame in frames:
            ends, at = np.cumsum(frame["_n"].to_numpy()), 0
            chunks, begun = np.empty(len(ends), dtype=np.int64), -used
            while at < len(ends):
                start = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, begun + chunk_size, side="right"))
                if to <= at and begun < start:
                    # the open chunk has rows and none of the reads left fits
                    chunk, begun = chunk + 1, start
                    continue
                to = max(to, at + 1)
                chunks[at:to] = chunk
                at = to
            used = int(ends[-1] - begun) if len(ends) else used
            yield pd.DataFrame({"read_idx": frame["read_idx"], "_shard": part, "_local": chunks})

    kind = rows.schema["read_idx"].dataType.simpleString()
    found = stored(reads.mapInPandas(cut, f"read_idx {kind}, _shard int, _local bigint"), "chunks")
    offsets = shard_offsets(found.groupBy("_shard").agg((F.max("_local") + 1).alias("_n")), "_n")
    found = found.join(F.broadcast(offsets), "_shard").select("read_idx", (F.col("_before") + F.col("_local")).alias("_chunk"))
    return rows.join(found, "read_idx").repartition("_chunk").sortWithinPartitions("_chunk", "read_idx", *order)


def _number_shards(folder: Folder) -> None:
    """Parts, or those of folders ``_chunk=…``, become ``0.parquet``, ``1.parquet``, … in their order."""
    chunks = sorted(int(n.removeprefix("_chunk=")) for n, _ in folder.names() if n.startswith("_chunk="))
    parts = [f"_chunk={c}/{n}" for c in chunks for n, _ in folder.names(f"_chunk={c}") if n.startswith("part-")] or sorted(n for n, _ in folder.names() if re.match(r"part-\d+", n))
    for i, n in enumerate(parts):
        folder.rename(n, f"{i}.parquet")
    for n, _ in folder.names():
        if n.startswith(("_SUCCESS", ".", "_chunk=")):
            folder.remove(n)


#: Columns of each kind in the exchange layout, with the class of their type.
DECLARED = {
    "pairs": {"read_idx": "String", "chrom1": "Categorical", "pos1": "Int64", "chrom2": "Categorical", "pos2": "Int64", "strand1": "Categorical", "strand2": "Categorical", "mapq": "Int16"},
    "concat": {
        "read_idx": "Int64", "read_length": "Int64", "read_start": "Int64", "read_end": "Int64", "strand": "Categorical", "chrom": "Categorical",
        "start": "Int64", "end": "Int64", "mapping_quality": "Int16", "identity": "Float32", "filter_reason": "Categorical",
    },
}


def _describe(kind: str, chunk_size: int) -> dict:
    out = {"format-version": meta.VERSIONS[kind], "creation_time": datetime.datetime.now(datetime.UTC).isoformat(), "format": kind, "chunksize": chunk_size, "is_with_mapq": True, "columns": list(DECLARED[kind]), "schema": DECLARED[kind]}
    return out | ({"read_idx_scope": "global", "complete_groups": True, "q1_min_mapq": 1} if kind == "concat" else {})
