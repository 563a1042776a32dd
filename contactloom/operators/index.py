"""Region indexes of datasets: a stored zone map with an inventory of the files it was made of.

An index never changes a result. A missing, stale or broken one is built again (``auto``) or is
an error (``require``).
"""

from __future__ import annotations

import io
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.text import fnv1a, to_json
from contactloom.operators import query
from contactloom.operators.regions import Region
from contactloom.operators.zonemap import candidate_parts, zone_map
from contactloom.schema import InvalidInput
from contactloom.sources.dataset import Dataset
from contactloom.sources.files import Folder

FOLDER, MANIFEST = "_zones", "manifest"


def _files(data: Dataset, quality: str) -> list[str]:
    folders = [quality] if not data.native else (["qbucket=1"] if quality == "q1" else ["qbucket=0", "qbucket=1"])
    return sorted(f"{f}/{n}" for f in folders if Folder(data.spark, f"{data.path}/{f}").exists() for n, _ in Folder(data.spark, f"{data.path}/{f}").names() if n.endswith(".parquet"))


def _inventory(data: Dataset, quality: str) -> dict[str, list[int]]:
    """For each file its size, the checksum of its footer, and its row groups. A footer holds the places and
    statistics of all that is in the file, so a file that is written again under its name is told apart."""
    root = Folder(data.spark, data.path)

    def look(name: str) -> tuple[str, list[int]]:
        footer = root.footer(name)
        try:
            groups = pq.ParquetFile(io.BytesIO(b"PAR1" + footer)).metadata.num_row_groups
        except (OSError, ValueError):
            # what can't be read shows where it is read
            groups = 0
        return name, [root.size(name), fnv1a(footer), groups]

    with ThreadPoolExecutor(16) as pool:
        return dict(pool.map(look, _files(data, quality)))


def _folder(data: Dataset, quality: str) -> Folder:
    if quality not in ("q0", "q1"):
        raise InvalidInput(f"no such quality: {quality!r}")
    return Folder(data.spark, f"{data.path}/{FOLDER}/{quality}")


def status(data: Dataset, quality: str = "q0") -> dict:
    """status valid, missing or invalid, with the reason."""
    return _status(data, quality)[0]


def _status(data: Dataset, quality: str) -> tuple[dict, dict[str, list[int]], str | None]:
    """The status, the files as they are now, and the folder of the zone map if it is valid."""
    folder, now = _folder(data, quality), _inventory(data, quality)
    out = {"quality": quality, "status": "missing", "reason": None, "total_row_groups": sum(x[2] for x in now.values()), "manifest_bytes": None}
    if not folder.exists(MANIFEST):
        return out, now, None
    raw = folder.read(MANIFEST)
    try:
        manifest = json.loads(raw)
        stale, zones = manifest["files"] != now, manifest["zones"]
    except (ValueError, KeyError, TypeError) as e:
        return out | {"status": "invalid", "reason": f"the manifest can't be read: {e}"}, now, None
    if stale or not folder.exists(zones):
        return out | {"status": "invalid", "reason": "the dataset's files have changed" if stale else "the zone map is missing"}, now, None
    return out | {"status": "valid", "manifest_bytes": len(raw)}, now, f"{folder.path}/{zones}"


def build(data: Dataset, quality: str = "q0", rebuild: bool = False) -> dict:
    """Make the index; an existing one is kept unless ``rebuild``. Each build is a generation of its own: the manifest
    names it in one step once it is whole, and what it named before goes afterwards."""
    found, now, _ = _status(data, quality)
    if found["status"] != "missing" and not rebuild:
        return found
    folder = _folder(data, quality)
    name = f"zones-{uuid.uuid4().hex[:12]}"
    zone_map(data.scan(1 if quality == "q1" else 0, with_file=True), F.col("_file")).coalesce(1).write.parquet(f"{folder.path}/{name}")
    folder.write(MANIFEST, to_json({"files": now, "zones": name}))
    for old, _ in folder.names():
        if old.startswith("zones-") and old != name:
            folder.remove(old)
    return status(data, quality)


def region_query(
    data: Dataset, regions: list[Region], min_mapq: int = 0, mode: str = "either", filter_mode: str = "matching_alignments", index: str = "auto", ordered: bool = False
) -> tuple[DataFrame, dict]:
    """Rows in the regions, read from the files that the index leaves, and what was done. ``auto`` builds an index
    that is missing or stale, and reads everything if it can't. Whole reads and ids that count within shards need all files."""
    if index not in ("auto", "off", "require"):
        raise InvalidInput(f"index is auto, off or require, not {index!r}")
    complete = filter_mode == "complete_reads"
    quality = "q1" if min_mapq and not complete else "q0"
    why, files, every = None, None, {}
    if index == "off":
        why = "the index is off"
    elif complete or (data.kind == "concat" and data.scope == "shard"):
        why = "whole reads or shard ids need all rows"
    else:
        found, every, zones = _status(data, quality)
        if zones is None and index == "auto":
            try:
                build(data, quality, rebuild=True)
                found, every, zones = _status(data, quality)
            except Exception as e:  # a dataset that can't be written to, in whatever way
                found["reason"] = f"no index could be built: {e}"[:300]
        if zones is None:
            why = found["reason"] or "there is no index"
        else:
            kept = {r["part"] for r in candidate_parts(data.spark.read.parquet(zones), regions, min_mapq, mode).collect()} if regions else set()
            files = [f for f in every if f.rpartition("/")[2] in kept]
    if why and index == "require":
        raise InvalidInput(why)
    rows = data.scan(min_mapq, complete, ordered, files=files)
    out = query.query_pairs(rows, regions, min_mapq, mode) if data.kind == "pairs" else query.query_alignments(rows, regions, min_mapq, filter_mode)
    total = sum(x[2] for x in every.values()) if every else None
    taken = total if files is None else sum(every[f][2] for f in files)
    skipped = total - taken if total is not None else None
    return out, {"source_quality": quality, "index_used": files is not None, "fallback_reason": why, "total_row_groups": total, "candidate_row_groups": taken, "skipped_row_groups": skipped}
