"""What a dataset is, and whether it is sound: inspect, info and validate."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from contactloom.operators import copynum, stats
from contactloom.operators.validate import counts, read_issues, row_issues, sequence_mismatches
from contactloom.sources import metadata as meta
from contactloom.sources.dataset import DECLARED, Dataset, open_dataset, read_buckets
from contactloom.sources.files import Folder

COORDINATES = {"pairs": "1-based", "concat": "0-based half-open"}
NEEDED = ("_metadata", "_contigsizes")


def declared_counts(spark: SparkSession, path: str) -> dict[str, int]:
    folder = Folder(spark, path)
    if not folder.exists("_metadata_counts"):
        return {}
    return {k: int(v) for k, v in (line.split("\t") for line in folder.read("_metadata_counts").decode().splitlines() if line)}


def inspect(data: Dataset) -> dict:
    numbers = copynum.read(data.spark, data.path, [n for n, _ in data.contigs])
    shards = {q: data.shards(q) for q in ("q0", "q1")} if not data.native else {}
    seen = {k: int(v or 0) for k, v in counts(data.scan()).first().asDict().items()}
    return {
        "metadata": data.metadata,
        "copy_numbers": numbers.report(),
        "coordinates": COORDINATES[data.kind],
        "read_idx_scope": data.scope,
        "contigs": [{"name": n, "length": length} for n, length in data.contigs],
        "declared_counts": declared_counts(data.spark, data.path),
        "observed": {"shards": shards, "records": {"q0": seen["q0_records"], "q1": seen["q1_records"]}},
        "checks_not_performed": ["row values", "read groups", "q0/q1 sequence"],
    }


def info(data: Dataset, with_stats: bool = False) -> dict:
    declared = declared_counts(data.spark, data.path)
    folders = [q for q in ("q0", "q1", "qbucket=0", "qbucket=1") if Folder(data.spark, f"{data.path}/{q}").exists()]
    files = [(n, size) for q in folders for n, size in Folder(data.spark, f"{data.path}/{q}").names() if n.endswith(".parquet")]
    out = {
        "path": data.path, "format": data.kind, "format_version": data.metadata["format-version"], "coordinates": COORDINATES[data.kind],
        "q0_records": declared.get("q0_records"), "q1_records": declared.get("q1_records"), "nchroms": len(data.contigs),
        "parquet_bytes": sum(s for _, s in files), "shards": len(files), "declared_counts": declared, "stats_scanned": with_stats,
    }
    if with_stats:
        rows = data.scan()
        out["mapq_histogram"] = [r["n"] for r in stats.mapq_histogram(rows).orderBy("mapq").collect()]
        out["scanned_records"] = sum(out["mapq_histogram"])
        if data.kind == "concat":
            out["scanned_reads"] = counts(rows).first()["q0_reads"]
    return out


def type_class(name: str) -> str | None:
    """What a declared type or a Spark type is: text, whole, real or truth."""
    plain = name.rpartition(".")[2].lower()
    if plain in ("string", "categorical", "utf8"):
        return "text"
    if re.fullmatch(r"u?int(?:8|16|32|64)?|tinyint|smallint|bigint|decimal\(\d+,0\)", plain):
        return "whole"
    return {"float32": "real", "float64": "real", "float": "real", "double": "real", "boolean": "truth"}.get(plain)


def schema_issues(data: Dataset) -> list[tuple[str, str]]:
    """code and message of differences between needed, declared and stored columns of the exchange layout."""
    needed = DECLARED[data.kind]
    out, declared = [], data.metadata.get("schema")
    columns = data.metadata.get("columns")
    if columns is not None and (not isinstance(columns, list) or set(columns) != set(needed)):
        out.append(("COLUMNS_MISMATCH", f"columns are {columns}"))
    if declared is None:
        return [*out, ("MISSING_SCHEMA", "the metadata declares no schema")]
    if not isinstance(declared, dict):
        return [*out, ("INVALID_DECLARED_SCHEMA", "the declared schema isn't a dictionary")]
    for c, t in declared.items():
        if not isinstance(t, str) or type_class(t) is None:
            out.append(("INVALID_DECLARED_DTYPE", f"{c}: {t}"))
    out += [("MISSING_DECLARED_FIELD", c) for c in needed if c not in declared]
    if data.native or not data.shards():
        return out
    stored = {f.name: f.dataType.simpleString() for f in data.spark.read.parquet(f"{data.path}/q0/{data.shards()[0]}").schema}
    for c, t in needed.items():
        if c not in stored or type_class(stored[c]) != type_class(t):
            out.append(("SCHEMA_MISMATCH", f"{c}: {stored.get(c)}"))
        elif isinstance(declared.get(c), str) and type_class(declared[c]) not in (None, type_class(stored[c])):
            out.append(("DECLARED_SCHEMA_MISMATCH", f"{c}: {declared[c]} declared, {stored[c]} found"))
    return out


def validate(spark: SparkSession, path: str, level: str = "quick", max_issues: int = 100) -> dict:
    """status valid, invalid or incomplete, and the issues. Once invalid, a report stays so."""
    issues: list[dict] = []
    done: list[str] = []
    total = 0
    status = "valid"

    def issue(code: str, message: str, worst: str = "invalid", file: str | None = None, row: int | None = None, n: int = 1) -> None:
        nonlocal total, status
        total += n
        if len(issues) < max_issues:
            issues.append({"severity": "error", "code": code, "file": file, "row": row, "field": None, "message": message})
        status = status if status == "invalid" else worst

    def report(seen: dict | None = None) -> dict:
        every = ["components", "metadata", "counts", *(["row values", "read groups", "q0/q1 sequence"] if level == "full" else [])]
        return {"status": status, "level": level, "issues": issues, "total_issues": total, "issues_truncated": total > len(issues), "checks_completed": done, "checks_skipped": [c for c in every if c not in done], "inspection": seen}

    folder = Folder(spark, path)
    if not folder.is_folder():
        issue("DATASET_UNAVAILABLE", "there is no such folder", "incomplete")
        return report()
    for name in NEEDED:
        if not folder.exists(name):
            issue("MISSING_COMPONENT", f"{name} is missing", file=name)
    if issues:
        return report()
    done.append("components")
    try:
        data = meta.parse_literal(folder.read("_metadata"))
    except ValueError as e:
        issue("MALFORMED_DATASET", str(e), file="_metadata")
        return report()
    if data.get("format") not in meta.VERSIONS or data.get("format-version") != meta.VERSIONS[data["format"]]:
        issue("UNSUPPORTED_FORMAT", f"{data.get('format')} {data.get('format-version')}", file="_metadata")
    if data.get("read_idx_scope", "global") not in ("global", "shard"):
        issue("UNSUPPORTED_ID_SCOPE", str(data["read_idx_scope"]), file="_metadata")
    if not isinstance(data.get("chunksize", 1), int) or data.get("chunksize", 1) < 1:
        issue("INVALID_CHUNKSIZE", str(data.get("chunksize")), file="_metadata")
    for name, kind in (("creation_time", str), ("is_with_mapq", bool), ("complete_groups", bool), ("q1_min_mapq", int)):
        if name in data and type(data[name]) is not kind:
            issue("INVALID_METADATA_FIELD", f"{name}: {data[name]!r}", file="_metadata")
    if issues:
        return report()
    try:
        opened = open_dataset(spark, path)
    except ValueError as e:
        issue("INVALID_CONTIGS", str(e), file="_contigsizes")
        return report()
    for code, message in schema_issues(opened):
        issue(code, message, file="_metadata")
    if any(i["code"] == "SCHEMA_MISMATCH" for i in issues):
        return report()
    done.append("metadata")
    try:
        copynum.read(spark, path, [n for n, _ in opened.contigs])
    except copynum.CopyNumberError as e:
        issue(e.code, str(e), file=copynum.FILE)
    try:
        declared = declared_counts(spark, path)
    except ValueError as e:
        declared = {}
        issue("INSPECTION_FAILED", f"the counts can't be read: {e}", "incomplete", file="_metadata_counts")
    try:
        seen = {k.replace("_reads", "_concats"): int(v or 0) for k, v in counts(opened.scan()).first().asDict().items()}
    except Exception as e:  # a file that can't be decoded, in whatever way
        issue("PARQUET_DECODE_FAILED", str(e)[:300], "incomplete")
        return report()
    for k, v in seen.items():
        if k not in declared:
            issue("COUNT_NOT_DECLARED", k, file="_metadata_counts")
        elif declared[k] != v:
            issue("COUNT_MISMATCH", f"{k}: {declared[k]} declared, {v} found", file="_metadata_counts")
    done.append("counts")
    if level == "full":
        try:
            full_scan(opened, seen, issue, done, max_issues)
        except Exception as e:  # whatever keeps the rows from being read to their end
            issue("SCAN_FAILED", str(e)[:300], "incomplete")
    return report({"records": seen})


def full_scan(data: Dataset, seen: dict[str, int], issue: Callable, done: list[str], most: int) -> None:
    """What every row says: its values, the order of reads, and the two qualities against each other. Rows are named by
    their file (of the exchange layout) or writing task (of the native one), and by their number in it."""
    rows = data.scan(ordered=True)
    q = "mapq" if data.kind == "pairs" else "mapping_quality"
    files = [] if data.native else data.shards()
    where = lambda r: {"file": f"q0/{files[r['_shard']]}" if files else f"task {r['_shard']}", "row": r["_row"] + 1}
    for what, name, found in (("a row breaks a condition", "row values", row_issues(rows, data.contig_table())), ("reads are out of order or differ in length", "read groups", read_issues(rows) if data.kind == "concat" else None)):
        if found is not None:
            first = found.orderBy("_shard", "_row").limit(most).collect()
            for k, r in enumerate(first):
                # the last one stands for those that aren't shown as well
                issue(r["code"], what, n=found.count() - k if k == most - 1 else 1, **where(r))
        done.append(name)
    if data.native:
        for quality, low in (("qbucket=1", True), ("qbucket=0", False)):
            wrong = read_buckets(data.spark, data.path, data.kind).where((F.col("qbucket") == int(low)) & ((F.col(q) < 1) if low else (F.col(q) >= 1))).count()
            if wrong:
                issue("Q1_MAPQ", f"{wrong} rows lie in {quality}", n=wrong)
    else:
        # the copy as it lies there, before any filter
        second = [f"{data.path}/q1/{f}" for f in data.shards("q1")]
        raw = data.spark.read.parquet(*second) if second else None
        copied, wrong = raw.agg(F.count("*"), F.count(F.when(F.col(q) < 1, 1))).first() if raw is not None else (0, 0)
        if wrong:
            issue("Q1_MAPQ", f"{wrong} rows of q1 have no quality", n=wrong)
        if copied != seen["q1_records"]:
            issue("SCANNED_COUNT_MISMATCH", f"q1 has {copied} rows, q0 {seen['q1_records']} with a quality")
        if data.scope == "global":
            copy = data.scan(1, ordered=True) if second else rows.limit(0)
            wrong = sequence_mismatches(rows.where(F.col(q) >= 1), copy).count()
            if wrong:
                issue("Q0_Q1_SEQUENCE_MISMATCH", f"{wrong} places differ", "incomplete")
    done.append("q0/q1 sequence")
