"""Registered queries on files: the contact views are written in each format, read back and compared with the SQL.

Files go to a folder of their own in the shared folder, which goes with the driver's JVM.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from argparse import Namespace
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import cli
from contactloom.functions.text import plain_number
from contactloom.operators import copynum, imports, index, inspect, merge, query, stats, validate
from contactloom.operators.ids import decreasing
from contactloom.operators.regions import parse_region
from contactloom.plans import views
from contactloom.plans.catalogue import END1, END2, HIT, REASON, TARGET, _import_sql, _pixels_sql, query_of
from contactloom.schema import CONCAT_COLUMNS, PAIRS_COLUMNS
from contactloom.session import shared_dir
from contactloom.sources import dataset, export, paf
from contactloom.sources.bam import FIXED, created, read_bam
from contactloom.sources.files import Folder
from contactloom.streaming.batches import batches
from contactloom.streaming.ingest import finish, ingest

CHUNK = 4_000


def place(spark: SparkSession, name: str) -> str:
    """A path that isn't taken, which is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def contig_list(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [(r["contig"], r["length"]) for r in views.contigs(spark, sf_dir).orderBy("contig_id").collect()]


def written(spark: SparkSession, sf_dir: str, kind: str, layout: str, rows: DataFrame | None = None) -> dataset.Dataset:
    rows = rows if rows is not None else (views.pairs if kind == "pairs" else views.alignments)(spark, sf_dir)
    path = place(spark, f"{kind}-{layout}")
    dataset.write_dataset(rows, path, kind, contig_list(spark, sf_dir), layout, CHUNK)
    return dataset.open_dataset(spark, path)


def converted(spark: SparkSession, mode: str, path: str, **options) -> str:
    """What the command line's convert does."""
    out = place(spark, mode)
    plain = {"path": path, "output": out, "min_mapq": 0, "min_order": None, "max_order": None, "include_secondary": False, "five_prime": False, "contigsizes": None, "bin_size": None}
    cli.convert(spark, Namespace(**plain | options), mode)
    return out


def percent(rows: DataFrame) -> DataFrame:
    """Alignments with their identity as a whole number."""
    return rows.select(*[c for c in CONCAT_COLUMNS if c != "identity"], F.round(F.col("identity") * 100).cast("bigint").alias("identity_percent"))


CONCAT_SQL = f"""SELECT {', '.join(c for c in CONCAT_COLUMNS if c != 'identity')}, CAST(round("identity" * 100) AS BIGINT) AS identity_percent FROM alignments"""


@query_of("dataset_pairs_native", "SELECT * FROM pairs WHERE mapq >= 1")
def dataset_pairs_native(spark, sf_dir):
    return written(spark, sf_dir, "pairs", "native").scan(1)


@query_of("dataset_pairs_exchange", "SELECT * FROM pairs WHERE mapq >= 1")
def dataset_pairs_exchange(spark, sf_dir):
    return written(spark, sf_dir, "pairs", "exchange").scan(1).select(*PAIRS_COLUMNS)


@query_of("dataset_concat_native", f"{CONCAT_SQL} WHERE mapping_quality >= 30")
def dataset_concat_native(spark, sf_dir):
    return percent(written(spark, sf_dir, "concat", "native").scan(30))


@query_of("dataset_concat_exchange", CONCAT_SQL)
def dataset_concat_exchange(spark, sf_dir):
    rows = written(spark, sf_dir, "concat", "exchange").scan()
    return percent(rows.withColumn("read_idx", F.col("read_idx").cast("bigint")))


@query_of("dataset_order", "SELECT row_number() OVER (ORDER BY mapq, chrom1_id, pos2) AS place, mapq, chrom1_id, pos2 FROM pairs ORDER BY place LIMIT 5000")
def dataset_order(spark, sf_dir):
    """The first rows of a dataset that was written in an order of its own; equal rows may stand for one another."""
    rows = views.pairs(spark, sf_dir).withColumns({"_shard": F.col("mapq").cast("int"), "_row": F.col("chrom1_id").cast("bigint") * 1_000_000 + F.col("pos2")})
    data = written(spark, sf_dir, "pairs", "native", rows.repartition(5))
    first = query.head(data.scan(ordered=True), 5000, ["_shard", "_row"])
    ranked = imports.Window.orderBy("_shard", "_row")
    return first.select(F.row_number().over(ranked).cast("bigint").alias("place"), "mapq", "chrom1_id", "pos2")


@query_of("dataset_shards", "SELECT count(*) AS n_rows, count(DISTINCT read_idx) AS n_reads, CAST(0 AS BIGINT) AS split_reads, CAST(0 AS BIGINT) AS large_shards FROM alignments")
def dataset_shards(spark, sf_dir):
    data = written(spark, sf_dir, "concat", "exchange")
    per = data.scan(with_file=True).groupBy("_file", "read_idx").agg(F.count("*").alias("n"))
    reads = per.groupBy("read_idx").agg(F.count("*").alias("shards"), F.sum("n").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_reads"), F.count(F.when(F.col("shards") > 1, 1)).alias("split_reads"))
    large = per.groupBy("_file").agg(F.sum("n").alias("n")).agg(F.count(F.when(F.col("n") > CHUNK, 1)).alias("large_shards"))
    return reads.join(F.broadcast(large), F.lit(True))


@query_of("index_query", f"SELECT * FROM pairs WHERE ({END1} OR {END2}) AND mapq >= 30")
def index_query(spark, sf_dir):
    """``auto`` builds the index of q1 and reads the files that it leaves."""
    return index.region_query(written(spark, sf_dir, "pairs", "native"), TARGET, 30)[0]


@query_of("index_status", "SELECT * FROM (VALUES ('before', 'missing', false), ('first query', 'valid', true), ('whole reads', 'valid', false)) AS v(step, status, used)")
def index_status(spark, sf_dir):
    data = written(spark, sf_dir, "concat", "native")
    steps = [("before", index.status(data)["status"], False)]
    for step, mode in (("first query", "matching_alignments"), ("whole reads", "complete_reads")):
        did = index.region_query(data, TARGET, filter_mode=mode)[1]
        steps.append((step, index.status(data)["status"], did["index_used"]))
    return spark.createDataFrame(steps, "step string, status string, used boolean")


@query_of("index_concat_query", f"SELECT read_idx, read_start, chrom_id, start_pos, end_pos, mapping_quality FROM alignments WHERE {HIT}")
def index_concat_query(spark, sf_dir):
    rows = index.region_query(written(spark, sf_dir, "concat", "exchange"), TARGET)[0]
    return rows.select(F.col("read_idx").cast("bigint").alias("read_idx"), "read_start", "chrom_id", "start_pos", "end_pos", "mapping_quality")


NAMED = "SELECT p.*, a.contig AS c1, b.contig AS c2 FROM pairs p JOIN contigs a ON chrom1_id = a.contig_id JOIN contigs b ON chrom2_id = b.contig_id"


@query_of("export_pairs", f"SELECT concat_ws(chr(9), read_id, c1, pos1, c2, pos2, strand1, strand2, mapq) AS line FROM ({NAMED}) WHERE mapq >= 20")
def export_pairs(spark, sf_dir):
    path = place(spark, "text") + ".pairs.gz"
    export.export(written(spark, sf_dir, "pairs", "native").scan(20, ordered=True), path, "pairs", contig_list(spark, sf_dir))
    return spark.read.text(path).where("value not like '#%'").withColumnRenamed("value", "line")


@query_of("export_tsv", "SELECT concat_ws(chr(9), read_idx, contig, start_pos, CASE WHEN \"identity\" = 1 THEN '1' ELSE regexp_replace(CAST(\"identity\" AS VARCHAR), '0+$', '') END) AS line FROM alignments JOIN contigs ON chrom_id = contig_id UNION ALL SELECT concat_ws(chr(9), 'read_idx', 'chrom', 'start', 'identity')")
def export_tsv(spark, sf_dir):
    path = place(spark, "table")
    export.export(written(spark, sf_dir, "concat", "exchange").scan(ordered=True), path, "concat", contig_list(spark, sf_dir), "tsv", ["read_idx", "chrom", "start", "identity"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@query_of("pairs_text", "SELECT read_id, chrom1_id, pos1, chrom2_id, pos2, strand1, strand2, mapq, CASE WHEN mapq < 10 THEN 'mapq' END AS skip FROM pairs")
def pairs_text(spark, sf_dir):
    """Gzipped text whose name doesn't say so."""
    packed, path = place(spark, "text") + ".gz", place(spark, "bare")
    export.export(views.pairs(spark, sf_dir), packed, "pairs", contig_list(spark, sf_dir))
    parent, _, name = path.rpartition("/")
    Folder(spark, parent).rename(packed.rpartition("/")[2], name)
    return paf.read_pairs_text(spark, path, min_mapq=10)[0]


@query_of(
    "cool_from_text",
    _pixels_sql(10) + """ SELECT (SELECT count(*) FROM pixels) AS nnz, (SELECT CAST(sum("count") AS BIGINT) FROM pixels) AS "sum", (SELECT CAST(count(*) + count(*) FILTER (mapq % 5 = 0) AS BIGINT) FROM pairs) AS input_records,
    (SELECT count(*) FROM pairs WHERE mapq < 10) AS skipped_mapq, (SELECT count(*) FROM pairs WHERE mapq % 5 = 0) AS skipped_unmapped""",
)
def cool_from_text(spark, sf_dir):
    """A matrix from pairs text that holds unmapped pairs as well; the report's counters."""
    from contactloom.operators import binning

    path, contigs = place(spark, "mixed"), contig_list(spark, sf_dir)
    lines, columns = export.text_lines(views.pairs(spark, sf_dir), "pairs", contigs)
    dead = views.pairs(spark, sf_dir).where("mapq % 5 = 0").select(F.concat_ws("\t", "read_id", F.lit("!\t0\t!\t0\t+\t+\t60")).alias("value"))
    head = spark.createDataFrame([(line,) for line in export.header_lines("pairs", columns, contigs)], "value string").coalesce(1)
    head.unionByName(lines).unionByName(dead).write.text(path)
    pairs, named = paf.read_pairs_text(spark, path, min_mapq=10)
    table = spark.createDataFrame([(k, n, size) for k, (n, size) in enumerate(named)], "contig_id int, contig string, length bigint")
    return binning.cool_summary(pairs, table, 10_000, 10).select("nnz", "sum", "input_records", "skipped_mapq", "skipped_unmapped")


@query_of("cool_tables", _pixels_sql(5) + " SELECT * FROM pixels")
def cool_tables(spark, sf_dir):
    out = converted(spark, "pairs2cool", written(spark, sf_dir, "pairs", "native").path, min_mapq=5, bin_size="10k")
    return spark.read.parquet(f"{out}/pixels")


def paf_text(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The import records as PAF text with one tag in three marked secondary, and a file of sizes."""
    path, sizes = place(spark, "paf"), place(spark, "sizes")
    rows = views.import_records(spark, sf_dir).where("flag & 1540 = 0").join(F.broadcast(views.contigs(spark, sf_dir)), F.col("chrom_id") == F.col("contig_id"))
    size = F.col("end_pos") - F.col("start_pos")
    fields = ["name", F.lit(1000), "read_start", F.col("read_start") + size, "strand", "contig", "length", "start_pos", "end_pos", F.greatest(size - 1, F.lit(0)), size, "mapping_quality"]
    tag = F.when(F.col("flag") == 256, "tp:A:S").otherwise("tp:A:P")
    rows.select(F.concat_ws("\t", *fields, F.lit("NM:i:1"), tag)).write.text(path)
    Folder(spark, sizes.rpartition("/")[0]).write(sizes.rpartition("/")[2], "".join(f"{n}\t{size}\t0\n" for n, size in contig_list(spark, sf_dir)))
    return path, sizes


@query_of("paf_records", """SELECT name, flag, read_start, read_start + end_pos - start_pos AS read_end, strand, chrom_id, start_pos, end_pos, mapping_quality,
    CAST(round(100 * greatest(end_pos - start_pos - 1, 0) / CAST(end_pos - start_pos AS DOUBLE)) AS BIGINT) AS identity_percent FROM import_records WHERE flag & 1540 = 0""")
def paf_records(spark, sf_dir):
    records, _ = paf.read_paf(spark, *paf_text(spark, sf_dir))
    return records.select("name", "flag", "read_start", "read_end", "strand", "chrom_id", "start_pos", "end_pos", "mapping_quality", F.round(F.col("identity").cast("double") * 100).cast("bigint").alias("identity_percent"))


@query_of("paf_to_concat", f"""+ own AS (SELECT * FROM import_records WHERE {REASON.format(q=10)} = 'selected'), reads AS (SELECT name, row_number() OVER (ORDER BY name) AS read_idx FROM own GROUP BY name HAVING count(*) >= 2)
    SELECT read_idx, read_start, strand, chrom_id, start_pos, mapping_quality FROM own JOIN reads USING (name)""")
def paf_to_concat(spark, sf_dir):
    path, sizes = paf_text(spark, sf_dir)
    out = converted(spark, "paf2concat", path, contigsizes=sizes, min_mapq=10, min_order=2)
    return dataset.open_dataset(spark, out).scan().select("read_idx", "read_start", "strand", "chrom_id", "start_pos", "mapping_quality")


def bam_file(spark: SparkSession, sf_dir: str) -> str:
    """The import records as one BAM file: matches of the alignment's length, one of them wrong, between soft clips. Each
    task writes blocks of its own, which are joined in the rows' order; a task that runs twice leaves a part that nobody names."""
    path, parts, contigs = place(spark, "bam"), place(spark, "blocks"), contig_list(spark, sf_dir)

    def packed(part: bytes) -> bytes:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = squeeze.compress(part) + squeeze.flush()
        return b"".join((b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0", struct.pack("<H", len(body) + 25), body, struct.pack("<II", zlib.crc32(part), len(part))))

    def records(frame: pd.DataFrame) -> Iterator[bytes]:
        """Blocks of 36 records, the fields of which are laid out for all at once."""
        n, bases = len(frame), b"\x11" * 500 + b"\xff" * 1000
        names, tags = [x.encode() + b"\0" for x in frame["name"].tolist()], [b"NMC\1RGZ" + x.encode() + b"\0" for x in frame["rg"].tolist()]
        reverse, start, size = (frame["strand"] == "-").to_numpy(), frame["read_start"].to_numpy(), (frame["end_pos"] - frame["start_pos"]).to_numpy()
        rest = 1000 - start - size
        ops = np.stack([np.where(reverse, rest, start) << 4 | 4, size << 4, np.where(reverse, start, rest) << 4 | 4], axis=1).astype("<u4")
        there = ops >> 4 > 0
        ends = 4 * np.cumsum(there.sum(axis=1))
        cigars = ops[there].tobytes()
        head = np.zeros(n, FIXED)
        head["n_ops"], head["contig"], head["pos"], head["quality"], head["name_size"] = there.sum(axis=1), frame["chrom_id"], frame["start_pos"], frame["mapping_quality"], [len(x) for x in names]
        head["flag"] = frame["flag"].to_numpy() | 1 | np.where(frame["mate"] == 1, 64, 128) | np.where(reverse, 16, 0)
        head["n_bases"], head["next_contig"], head["next_pos"] = 1000, -1, -1
        head["size"] = 32 + len(bases) + head["name_size"].astype("int32") + 4 * head["n_ops"] + np.array([len(x) for x in tags], dtype="int32")
        heads, parts, at = head.tobytes(), [], 0
        for k, (name, tag, end) in enumerate(zip(names, tags, ends.tolist(), strict=True)):
            parts += (heads[36 * k : 36 * k + 36], name, cigars[at:end], bases, tag)
            at = end
            if len(parts) == 180:
                yield b"".join(parts)
                parts = []
        if parts:
            yield b"".join(parts)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        with created(f"{parts}/{name}") as out:
            for frame in frames:
                for block in records(frame):
                    out.write(packed(block))
        yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "name": [name]})

    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    Folder(spark, parts).fs.mkdirs(hadoop.Path(parts))
    # a row makes 1.6 kB, so tasks are many, whatever the table's size; a read's rows stand in the order of their ordinals
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").sortWithinPartitions("l_orderkey", *views.LINE_ORDER.split(", "))
    rows = rows.selectExpr(*[f"{e} AS {n}" for n, e in views.IMPORT_RECORDS.items() if n != "ordinal"])
    names = [r.name for r in rows.mapInPandas(write, "task int, name string").orderBy("task").collect()]
    where, folder = hadoop.Path(path), Folder(spark, parts)
    stream = where.getFileSystem(conf).create(where)
    stream.write(bytearray(packed(b"BAM\1" + struct.pack("<ii", 0, len(contigs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs))))
    for name in names:
        folder.append_to(stream, name)
    stream.write(bytearray.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
    stream.close()
    folder.remove()
    return path


@query_of(
    "bam_records",
    """SELECT rg, name, mate, CASE WHEN flag & 4 <> 0 THEN 0 ELSE read_start END AS read_start, strand, CASE WHEN flag & 4 <> 0 THEN 0 ELSE start_pos END AS start_pos, CASE WHEN flag & 4 <> 0 THEN 0 ELSE end_pos END AS end_pos, mapping_quality,
    CASE WHEN flag & 1540 = 0 THEN CAST(round(1000 * (end_pos - start_pos - 1) / CAST(end_pos - start_pos AS DOUBLE)) AS BIGINT) ELSE 0 END AS identity_permille FROM import_records""",
)
def bam_records(spark, sf_dir):
    records, _ = read_bam(spark, bam_file(spark, sf_dir))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    known = F.when(F.col("flag").bitwiseAND(1540) == 0, F.round(F.col("identity").cast("double") * 1000))
    return records.select("rg", "name", "mate", none(F.col("read_start")).alias("read_start"), "strand", none(F.col("start_pos")).alias("start_pos"), none(F.col("end_pos")).alias("end_pos"), "mapping_quality", none(known).alias("identity_permille"))


@query_of("bam_to_pairs", _import_sql("CASE WHEN strand = '-' THEN end_pos ELSE start_pos + 1 END"))
def bam_to_pairs(spark, sf_dir):
    out = converted(spark, "bam2pairs", bam_file(spark, sf_dir), min_mapq=10, five_prime=True)
    return dataset.open_dataset(spark, out).scan()


@query_of("concat_to_pairs", "SELECT CAST(sum(k * (k - 1) // 2) AS BIGINT) AS n_pairs, count(*) AS n_reads FROM (SELECT read_idx, count(*) AS k FROM alignments WHERE mapping_quality >= 10 GROUP BY read_idx HAVING count(*) >= 2)")
def concat_to_pairs(spark, sf_dir):
    out = converted(spark, "concat2pairs", written(spark, sf_dir, "concat", "native").path, min_mapq=10)
    return dataset.open_dataset(spark, out).scan().agg(F.count("*").alias("n_pairs"), F.countDistinct(F.split_part("read_id", F.lit(":"), F.lit(1))).alias("n_reads"))


@query_of("copy_number_files", "SELECT contig, CAST(CASE WHEN contig_id % 3 = 0 THEN 2 WHEN contig_id = 4 THEN 7 ELSE 1 END AS BIGINT) AS cn, contig_id % 3 = 0 OR contig_id = 4 AS declared FROM contigs")
def copy_number_files(spark, sf_dir):
    """Declared, updated, read back and merged with those of another dataset."""
    names, path, other = [n for n, _ in contig_list(spark, sf_dir)], place(spark, "numbers"), place(spark, "numbers")
    for p in (path, other):
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    copynum.replace(spark, path, names, {n: 2 for n in names[::3]})
    copynum.replace(spark, other, names, {names[3]: 2})
    copynum.update(spark, other, names, {names[4]: 7})
    declared = [spark.createDataFrame(sorted(copynum.read(spark, p, names).explicit.items()), "contig string, cn bigint") for p in (path, other)]
    numbers = merge.merge_copy_numbers(declared)
    rows = merge.effective_copy_numbers(views.contigs(spark, sf_dir), numbers)
    return rows.join(numbers.select("contig", F.lit(True).alias("declared")), "contig", "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


@query_of(
    "row_issues",
    """+ broken AS (SELECT CASE WHEN mapq = 7 THEN NULL WHEN mapq = 11 THEN '*' ELSE strand1 END AS strand1, CASE WHEN mapq = 13 THEN 0 ELSE pos1 END AS pos1, CASE WHEN mapq = 17 THEN length + 1 ELSE pos2 END AS pos2, CASE WHEN mapq = 19 THEN 300 ELSE mapq END AS mapq FROM pairs JOIN contigs ON chrom2_id = contig_id)
     SELECT CASE WHEN strand1 IS NULL THEN 'NULL_VALUES' WHEN strand1 = '*' OR mapq = 300 THEN 'INVALID_RECORD_ENCODING' ELSE 'POSITION_OUT_OF_RANGE' END AS code, count(*) AS n FROM broken
     WHERE strand1 IS NULL OR strand1 = '*' OR mapq = 300 OR pos1 = 0 OR pos2 > 100000 GROUP BY 1""",
)
def row_issues(spark, sf_dir):
    contigs = views.contigs(spark, sf_dir)
    q = F.col("mapq")
    rows = views.pairs(spark, sf_dir).join(F.broadcast(contigs.select(F.col("contig_id").alias("chrom2_id"), "length")), "chrom2_id").withColumns(
        {
            "strand1": F.when(q == 7, None).when(q == 11, "*").otherwise(F.col("strand1")), "pos1": F.when(q == 13, 0).otherwise(F.col("pos1")),
            "pos2": F.when(q == 17, F.col("length") + 1).otherwise(F.col("pos2")), "mapq": F.when(q == 19, 300).otherwise(q).cast("smallint"), "_shard": F.lit(0), "_row": F.lit(0).cast("bigint"),
        }
    )
    return validate.row_issues(rows, contigs).groupBy("code").agg(F.count("*").alias("n"))


SHARDED = "placed AS (SELECT read_idx, CASE WHEN source_row = 3 THEN 999 ELSE 1000 END AS read_length, chrom_id AS shard, row_number() OVER (PARTITION BY chrom_id ORDER BY (read_idx * 7919) % 1009, read_idx, source_row) AS r FROM alignments)"


@query_of(
    "read_issues",
    f"""+ {SHARDED}, lagged AS (SELECT *, lag(read_idx) OVER (PARTITION BY shard ORDER BY r) AS before FROM placed)
     SELECT 'READ_ORDER' AS code, count(*) AS n FROM lagged WHERE read_idx < before
     UNION ALL SELECT 'READ_LENGTH_MISMATCH', count(*) FROM (SELECT read_idx FROM placed GROUP BY read_idx HAVING min(read_length) <> max(read_length))""",
)
def read_issues(spark, sf_dir):
    return validate.read_issues(_sharded(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.row_number().over(imports.Window.partitionBy("chrom_id").orderBy(F.expr("(read_idx * 7919) % 1009"), "read_idx", "source_row"))
    length = F.when(F.col("source_row") == 3, 999).otherwise(1000).cast("bigint")
    return views.alignments(spark, sf_dir).select("read_idx", length.alias("read_length"), F.col("chrom_id").alias("_shard"), row.cast("bigint").alias("_row"))


@query_of("order_violations", f"+ {SHARDED}, lagged AS (SELECT *, lag(read_idx) OVER (PARTITION BY shard ORDER BY r) AS before FROM placed) SELECT shard, r AS place, read_idx, before FROM lagged WHERE read_idx < before")
def order_violations(spark, sf_dir):
    return decreasing(_sharded(spark, sf_dir)).select(F.col("_shard").alias("shard"), F.col("_row").alias("place"), "read_idx", F.col("_previous").alias("before"))


@query_of(
    "validation_issues",
    """SELECT * FROM (VALUES ('sound', 'valid', ''), ('counts', 'invalid', 'COUNT_MISMATCH'), ('moved', 'invalid', 'Q1_MAPQ,SCANNED_COUNT_MISMATCH'),
     ('version', 'invalid', 'UNSUPPORTED_FORMAT'), ('no contigs', 'invalid', 'MISSING_COMPONENT'), ('short contigs', 'invalid', 'POSITION_OUT_OF_RANGE')) AS v(step, status, codes)""",
)
def validation_issues(spark, sf_dir):
    """One dataset, sound at first, and what is said after each damage (which is mended before the next)."""
    data = written(spark, sf_dir, "pairs", "exchange")
    folder, steps = Folder(spark, data.path), []

    def look(step: str, level: str = "full") -> None:
        found = inspect.validate(spark, data.path, level)
        codes = {i["code"] for i in found["issues"]}
        steps.append((step, found["status"], ",".join(sorted(codes - {"Q0_Q1_SEQUENCE_MISMATCH"}))))

    def damaged(name: str, old: str, new: str, step: str, level: str = "full") -> None:
        text = folder.read(name).decode()
        folder.write(name, text.replace(old, new, 1))
        look(step, level)
        folder.write(name, text)

    look("sound")
    damaged("_metadata_counts", "q0_records\t", "q0_records\t9", "counts", "quick")
    damaged("_metadata", "'format-version': '", "'format-version': '9", "version")
    whole = folder.read("_contigsizes").decode()
    damaged("_contigsizes", whole, "".join(f"{n}\t50000\n" for n, _ in data.contigs), "short contigs")
    folder.rename("_contigsizes", "_away")
    look("no contigs", "quick")
    folder.rename("_away", "_contigsizes")
    # all rows where those with quality should be
    folder.rename("q1", "q1_away")
    data.spark.read.parquet(f"{data.path}/q0").coalesce(1).write.parquet(f"{data.path}/q1")
    folder.rename("q1/" + next(n for n, _ in folder.names("q1") if n.startswith("part-")), "q1/0.parquet")
    look("moved")
    return spark.createDataFrame(steps, "step string, status string, codes string")


@query_of("dataset_info", "SELECT count(*) AS q0_records, count(*) FILTER (mapq >= 1) AS q1_records, (SELECT count(*) FROM contigs) AS nchroms, count(*) AS scanned_records, count(*) FILTER (mapq = 30) AS mapq_30 FROM pairs")
def dataset_info(spark, sf_dir):
    found = inspect.info(written(spark, sf_dir, "pairs", "native"), True)
    row = {k: found[k] for k in ("q0_records", "q1_records", "nchroms", "scanned_records")} | {"mapq_30": found["mapq_histogram"][30]}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))


@query_of("stats_report", """SELECT count(*) FILTER (mapq >= 10) AS selected, count(*) FILTER (mapq >= 10 AND chrom1_id = chrom2_id) AS cis, count(*) FILTER (mapq >= 10 AND chrom1_id = chrom2_id AND abs(pos1 - pos2) < 1000) AS near,
    count(*) FILTER (mapq >= 10 AND strand1 || strand2 = '+-') AS plus_minus, count(*) FILTER (mapq >= 10 AND chrom1_id = 3) + count(*) FILTER (mapq >= 10 AND chrom2_id = 3) AS ends_3 FROM pairs""")
def stats_report(spark, sf_dir):
    found = stats.report(views.pairs(spark, sf_dir), views.contigs(spark, sf_dir), "pairs", 10)
    row = {"selected": found["selected_records"], "cis": found["cis_records"], "near": found["cis_distance_bp"]["0-999"], "plus_minus": found["strand_pairs"].get("+-", 0), "ends_3": found["per_contig"][3]["count"]}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))


@query_of("batch_sizes", "+ placed AS (SELECT row_number() OVER () - 1 AS r FROM pairs) SELECT r // 7000 AS batch, count(*) AS n FROM placed GROUP BY 1")
def batch_sizes(spark, sf_dir):
    """Batches of a stored dataset, in its order; the driver holds one at a time."""
    sizes = [(k, len(b)) for k, b in enumerate(batches(written(spark, sf_dir, "pairs", "native").scan(ordered=True), 7000))]
    return spark.createDataFrame(sizes, "batch bigint, n bigint")


@query_of("batches_of_reads", "SELECT count(*) AS n_rows, count(DISTINCT read_idx) AS n_reads, CAST(0 AS BIGINT) AS split_reads, CAST(0 AS BIGINT) AS large_batches FROM alignments")
def batches_of_reads(spark, sf_dir):
    rows = reads = split = large = 0
    last = None
    for b in batches(written(spark, sf_dir, "concat", "native").scan(ordered=True), 3000, "complete_reads"):
        own = {r.read_idx for r in b}
        rows, reads, split, large, last = rows + len(b), reads + len(own), split + (last in own), large + (len(b) > 3000), b[-1].read_idx
    return spark.createDataFrame([(rows, reads, split, large)], "n_rows bigint, n_reads bigint, split_reads bigint, large_batches bigint")


@query_of("ordered_ingest", "SELECT read_id, CAST(chrom1_id AS BIGINT) AS producer, row_number() OVER (PARTITION BY chrom1_id ORDER BY read_id, pos2, mapq) AS place FROM pairs")
def ordered_ingest(spark, sf_dir):
    """Rows of producers that come in any order, numbered by producer and place."""
    row = F.row_number().over(imports.Window.partitionBy("chrom1_id").orderBy("read_id", "pos2", "mapq")).cast("bigint")
    rows = views.pairs(spark, sf_dir).withColumns({"sequence": F.col("chrom1_id").cast("bigint"), "row": row})
    source, out = place(spark, "incoming"), place(spark, "ingested")
    rows.repartition(3).write.parquet(source)
    ingest(spark.readStream.schema(rows.schema).parquet(source), out, place(spark, "state")).awaitTermination()
    return finish(spark.read.parquet(out)).select("read_id", F.col("_shard").cast("bigint").alias("producer"), F.col("_row").cast("bigint").alias("place"))


@query_of("plain_numbers", "SELECT DISTINCT l_discount AS x, CASE WHEN l_discount = 0 THEN '0' ELSE regexp_replace(CAST(l_discount AS VARCHAR), '0+$', '') END AS text FROM lineitem")
def plain_numbers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_discount").alias("x")).distinct()
    return rows.withColumn("text", plain_number(F.col("x").cast("double")))


@query_of("region_texts", "SELECT contig_id, contig_id * 10 AS \"start\", length AS \"end\" FROM contigs")
def region_texts(spark, sf_dir):
    contigs = {n: (k, size) for k, (n, size) in enumerate(contig_list(spark, sf_dir))}
    found = [parse_region(f"{n}:{10 * k}-{size}", contigs) for n, (k, size) in contigs.items()]
    return spark.createDataFrame([(r.contig_id, r.start, r.end) for r in found], "contig_id int, start bigint, end bigint")


@query_of(
    "merge_datasets",
    "SELECT read_id, chrom1_id, pos1, mapq FROM pairs WHERE mapq >= 40 UNION ALL SELECT read_id, chrom1_id, pos1, mapq FROM pairs",
)
def merge_datasets(spark, sf_dir):
    sets = [written(spark, sf_dir, "pairs", "native", views.pairs(spark, sf_dir).where("mapq >= 40")), written(spark, sf_dir, "pairs", "exchange")]
    rows = merge.merge_pairs([(d.scan(ordered=True), d.contig_table()) for d in sets])
    return written(spark, sf_dir, "pairs", "native", rows).scan().select("read_id", "chrom1_id", "pos1", "mapq")
