"""Views of the order tables as contact data, for queries that an SQL engine can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTIGS = {
    "contig_id": "CAST(n_nationkey AS INT)",
    "contig": "n_name",
    "length": "CAST(100000 + n_nationkey * 1000 AS BIGINT)",
}
PAIRS = {
    "read_id": "CAST(l_orderkey AS VARCHAR(20)) || '_' || CAST(l_linenumber AS VARCHAR(20))",
    "chrom1_id": "CAST(l_suppkey % 25 AS INT)",
    "pos1": "CAST((l_partkey * 37) % 90000 + 1 AS BIGINT)",
    "chrom2_id": "CAST(CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 25 ELSE l_partkey % 25 END AS INT)",
    "pos2": "CAST((l_orderkey * 53) % 90000 + 1 AS BIGINT)",
    "strand1": "CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END",
    "strand2": "CASE WHEN l_returnflag = 'N' THEN '+' ELSE '-' END",
    "mapq": "CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 61 AS SMALLINT)",
}
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_RANK = f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS BIGINT)"
_PLACE = {
    "strand": "CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END",
    "chrom_id": "CAST(l_suppkey % 25 AS INT)",
    "start_pos": "CAST((l_partkey * 37) % 90000 AS BIGINT)",
    "end_pos": "CAST((l_partkey * 37) % 90000 + CAST(l_quantity AS BIGINT) AS BIGINT)",
    "mapping_quality": "CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 61 AS SMALLINT)",
}
ALIGNMENTS = {
    "read_idx": "l_orderkey",
    "read_length": "CAST(1000 AS BIGINT)",
    "read_start": "CAST((l_linenumber - 1) * 100 AS BIGINT)",
    "read_end": "CAST((l_linenumber - 1) * 100 + CAST(l_quantity AS BIGINT) AS BIGINT)",
    **_PLACE,
    "identity": "CAST(100 - CAST(round(l_tax * 100) AS INT) AS DOUBLE) / 100",
    "filter_reason": "CASE WHEN l_returnflag = 'N' THEN 'pass' WHEN l_returnflag = 'R' THEN 'low_mq' ELSE '' END",
    "source_row": _RANK,
}
IMPORT_RECORDS = {
    "rg": "'rg' || CAST(l_orderkey % 3 AS VARCHAR(20))",
    "name": "'q' || CAST(l_orderkey AS VARCHAR(20))",
    "mate": "CAST(1 + l_linenumber % 2 AS INT)",
    "flag": "CAST(CASE WHEN l_partkey % 50 = 0 THEN 4 WHEN l_partkey % 41 = 0 THEN 1024 WHEN l_partkey % 37 = 0 THEN 256 ELSE 0 END AS INT)",
    "read_start": "CAST((l_linenumber - 1) * 100 AS BIGINT)",
    **_PLACE,
    "ordinal": _RANK,
}


def _sql(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}"


#: The views as common table expressions, to stand before a query.
WITH = ",\n".join(
    f"{name} AS ({_sql(columns, table)})"
    for name, columns, table in (("contigs", CONTIGS, "nation"), ("pairs", PAIRS, "lineitem"), ("alignments", ALIGNMENTS, "lineitem"), ("import_records", IMPORT_RECORDS, "lineitem"))
)


def _view(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "nation", CONTIGS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", PAIRS)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", ALIGNMENTS)


def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", IMPORT_RECORDS)
