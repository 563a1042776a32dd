"""Rows as text: pairs, concat or TSV, in dataset order."""

from __future__ import annotations

import gzip
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.text import plain_number
from contactloom.schema import InvalidInput
from contactloom.sources.files import Folder, contig_frame

#: Column names of the text formats, in order. Fixed values.
COLUMNS = {
    "pairs": ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "mapq"],
    "concat": ["read_idx", "read_length", "read_start", "read_end", "strand", "chrom", "start", "end", "mapping_quality", "identity", "filter_reason"],
}
OURS = {"readID": "read_id", "chrom1": "chrom1_id", "chrom2": "chrom2_id", "chrom": "chrom_id", "start": "start_pos", "end": "end_pos"}


def text_lines(rows: DataFrame, kind: str, contigs: list[tuple[str, int]], columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``value``: the fields joined by tabs (and _shard, _row if there), and the columns. A control character in
    a field is an error."""
    columns = columns or COLUMNS[kind]
    if len(set(columns)) < len(columns) or any(c not in COLUMNS[kind] for c in columns):
        raise InvalidInput(f"columns are distinct ones of {COLUMNS[kind]}")
    names = contig_frame(rows.sparkSession, contigs)
    fields = []
    for c in columns:
        own = OURS.get(c, c)
        if c.startswith("chrom"):
            table = names.select(F.col("contig_id").alias(own), F.col("contig").alias(f"_{c}"))
            rows = rows.join(F.broadcast(table), own)
            fields.append(F.col(f"_{c}"))
        else:
            fields.append(plain_number(own) if c == "identity" else F.col(own).cast("string"))
    clean = [F.when(f.rlike(r"\p{Cntrl}"), F.raise_error(F.lit("control character in a field")).cast("string")).otherwise(f) for f in fields]
    order = [c for c in ("_shard", "_row") if c in rows.columns]
    return rows.select(F.concat_ws("\t", *clean).alias("value"), *order), columns


def header_lines(form: str, columns: list[str], contigs: list[tuple[str, int]]) -> list[str]:
    if form == "concat":
        return []
    if form == "tsv":
        return ["\t".join(columns)]
    return ["## pairs format v1.0", "#shape: whole matrix", *[f"#chromsize: {n} {length}" for n, length in contigs], f"#columns: {' '.join(columns)}"]


def export(rows: DataFrame, path: str, kind: str, contigs: list[tuple[str, int]], form: str | None = None, columns: list[str] | None = None, limit: int | None = None, header: bool = True, one_file: bool = True) -> dict:
    """Write text, gzipped if the name ends in .gz. Executors write ordered parts; with ``one_file`` their bytes are then
    joined within the JVM (gzip members make one gzip file), else they stay a folder."""
    form = form or kind
    if form not in ("pairs", "concat", "tsv") or form != "tsv" and form != kind:
        raise InvalidInput(f"{kind} can't be written as {form}")
    spark = rows.sparkSession
    target = Folder(spark, path)
    if target.exists():
        raise FileExistsError(path)
    order = [c for c in ("_shard", "_row") if c in rows.columns]
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit) if order else rows.limit(limit)
    body, columns = text_lines(rows, kind, contigs, columns)
    if order:
        body = body.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    head = header_lines(form, columns, contigs) if header else []
    packed = path.endswith(".gz")
    where = path if not one_file else f"{path}.parts-{uuid.uuid4().hex[:8]}"
    body.write.option("compression", "gzip" if packed else "none").text(where)
    out = {"format": form, "records": spark.read.text(where).count(), "output": path, "columns": columns}
    if not one_file:
        return out
    parts, whole = Folder(spark, where), Folder(spark, f"{path}.partial-{uuid.uuid4().hex[:8]}")
    begin = "".join(f"{line}\n" for line in head).encode()
    try:
        stream = whole.fs.create(whole._at(""), True)
        try:
            stream.write(bytearray(gzip.compress(begin) if packed else begin))
            for name in sorted(n for n, _ in parts.names() if n.startswith("part-")):
                parts.append_to(stream, name)
        finally:
            stream.close()
        whole.move_to(path)
    except BaseException:
        whole.remove()
        raise
    finally:
        parts.remove()
    return out
