"""Command line: convert, query, subset, merge, statistics, export and validation.

Exit codes: 0 success, 1 failure, 2 usage or invalid input, 3 validation incomplete.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from contactloom.functions.text import bin_size, to_json
from contactloom.operators import binning, copynum, expand, imports, index, inspect, merge, query, stats, subset
from contactloom.operators.regions import parse_region
from contactloom.schema import InvalidInput
from contactloom.session import stored
from contactloom.sources import dataset, export, paf
from contactloom.sources.bam import read_bam
from contactloom.sources.files import Folder, contig_frame

CONVERSIONS = ("bam2pairs", "bam2concat", "paf2pairs", "paf2concat", "concat2pairs", "pairs2cool")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="contactloom", description=__doc__.splitlines()[0])
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *options: tuple) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        for flags, kw in options:
            p.add_argument(*flags, **kw)
        return p

    path = (("path",), {})
    output = (("-o", "--output"), {"required": True})
    quality = (("--min-mapq",), {"type": int, "default": 0})
    region = (("--region",), {"action": "append"})
    mode = (("--pairs-mode",), {"choices": ["either", "both"], "default": "either"})
    convert = [path, output, quality, (("--min-order",), {"type": int}), (("--max-order",), {"type": int}), (("--contigsizes",), {}), (("--include-secondary",), {"action": "store_true"}), (("--five-prime",), {"action": "store_true"}), (("--bin-size",), {})]
    verb("convert", *convert, (("--mode",), {"choices": CONVERSIONS, "required": True}))
    for name in CONVERSIONS:
        verb(name, *convert)
    for name in ("inspect", "info"):
        verb(name, path, (("--stats",), {"action": "store_true"}))
    verb("validate", path, (("--level",), {"choices": ["quick", "full"], "default": "quick"}), (("--max-issues",), {"type": int, "default": 100}))
    verb("stats", path, quality)
    shown = [path, quality, region, mode, (("--index",), {"choices": ["auto", "off", "require"], "default": "auto"}), (("--columns",), {}), (("--no-header",), {"action": "store_true"})]
    verb("head", *shown, (("-n", "--limit"), {"type": int, "default": 10}))
    verb("view", *shown, (("-n", "--limit"), {"type": int, "default": 100}), (("--all",), {"action": "store_true"}))
    for name in ("export", "query"):
        verb(name, *shown, output, (("-n", "--limit"), {"type": int}), (("--format",), {"choices": ["pairs", "concat", "tsv"]}), (("--filter-mode",), {"choices": ["matching_alignments", "complete_reads"], "default": "matching_alignments"}))
    verb("subset", path, output, quality, region, mode, (("--chrom",), {"action": "append"}), (("--read-id",), {"action": "append"}), (("--mode",), {"choices": ["matching_alignments", "complete_reads"], "default": "matching_alignments"}))
    p = verb("index", (("action",), {"choices": ["build", "status", "rebuild"]}), path)
    p.add_argument("--quality", choices=["q0", "q1"], default="q0")
    verb("merge", (("inputs",), {"nargs": "+"}), output)
    return top


def _shown(spark: SparkSession, a: argparse.Namespace):
    data = dataset.open_dataset(spark, a.path)
    regions = [parse_region(r, data.contig_numbers()) for r in a.region] if a.region else None
    filter_mode = getattr(a, "filter_mode", "matching_alignments")
    if regions:
        return data, index.region_query(data, regions, a.min_mapq, a.pairs_mode, filter_mode, getattr(a, "index", "auto"), ordered=True)[0]
    rows = data.scan(a.min_mapq, filter_mode == "complete_reads", ordered=True)
    return data, query.query_pairs(rows, None, a.min_mapq) if data.kind == "pairs" else query.query_alignments(rows, None, a.min_mapq, filter_mode)


def convert(spark: SparkSession, a: argparse.Namespace, mode: str) -> dict:
    if mode == "pairs2cool":
        if not a.bin_size:
            raise InvalidInput("--bin-size is needed")
        size = bin_size(a.bin_size)
        if Folder(spark, a.path).is_folder():
            data = dataset.open_dataset(spark, a.path)
            contigs, pairs = data.contig_table(), data.scan()
        else:
            pairs, named = paf.read_pairs_text(spark, a.path, a.contigsizes, a.min_mapq)
            contigs = contig_frame(spark, named)
        pixels = binning.pixels(pairs, contigs, size, a.min_mapq)
        tables = {"chroms": contigs.select(F.col("contig").alias("name"), "length"), "bins": binning.bin_table(contigs, size), "pixels": pixels.repartitionByRange("bin1", "bin2").sortWithinPartitions("bin1", "bin2"), "chrom_offset": binning.chrom_offset(contigs, size)}
        for name, table in tables.items():
            table.write.parquet(f"{a.output}/{name}")
        written = spark.read.parquet(f"{a.output}/pixels")
        binning.bin1_offset(written, contigs, size).write.parquet(f"{a.output}/bin1_offset")
        return {"mode": mode, "format": "cool-tables", "output": a.output, "bin_size": size} | binning.cool_summary(pairs, contigs, size, a.min_mapq).first().asDict()
    if mode == "concat2pairs":
        data = dataset.open_dataset(spark, a.path)
        rows = data.scan(complete=True, ordered=True).withColumn("source_row", F.struct("_shard", "_row"))
        pairs, contigs, kind = expand.expand(rows, a.min_mapq, a.min_order or 2, a.max_order), data.contigs, "pairs"
        return {"output": a.output, "mode": mode, "format": kind, "counts": dataset.write_dataset(pairs, a.output, kind, contigs)}
    wants_pairs = mode.endswith("pairs")
    records, contigs = read_bam(spark, a.path, not wants_pairs) if mode.startswith("bam") else paf.read_paf(spark, a.path, a.contigsizes)
    if mode.startswith("bam"):
        # three passes follow, and decoding is the dearest part of them
        records = stored(records, "records")
    problem = imports.group_problems(records).limit(1).collect()
    if problem:
        raise ValueError(f"{problem[0]['name']}: {problem[0]['problem']}")
    low = a.min_order or (2 if wants_pairs else 1)
    if wants_pairs:
        rows = imports.import_pairs(records, a.min_mapq, low, a.max_order, a.include_secondary, a.five_prime)
    else:
        chosen = imports.selected(records, a.min_mapq, a.include_secondary)
        numbers = imports.import_reads(records, a.min_mapq, low, a.max_order, a.include_secondary).drop("n")
        rows = chosen.join(numbers, ["rg", "name", "mate"]).withColumns({"_shard": F.lit(0), "_row": F.col("ordinal")})
    found = dataset.write_dataset(rows, a.output, "pairs" if wants_pairs else "concat", contigs)
    if not wants_pairs:
        names = numbers.select("read_idx", F.col("name").alias("read_name"), F.col("rg").alias("read_group"), F.nullif("mate", F.lit(0)).alias("mate"))
        names.write.json(f"{a.output}/_import_read_names")
    counters = imports.import_statistics(records, a.min_mapq, low, a.max_order, a.include_secondary, not wants_pairs).first().asDict()
    options = {"min_mapq": a.min_mapq, "min_order": low, "max_order": a.max_order, "include_secondary": a.include_secondary, "pair_position": "five_prime" if a.five_prime else "leftmost", "contigsizes": a.contigsizes}
    report = {"source": a.path, "mode": mode, "output": a.output, "format": "pairs" if wants_pairs else "concat", "options": options, "counts": found, "statistics": counters, "read_names": None if wants_pairs else "_import_read_names"}
    Folder(spark, a.output).write("_import.json", to_json(report))
    return report


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.verb in CONVERSIONS or a.verb == "convert":
        print(to_json(convert(spark, a, a.mode if a.verb == "convert" else a.verb)))
    elif a.verb == "inspect":
        print(to_json(inspect.inspect(dataset.open_dataset(spark, a.path))))
    elif a.verb == "info":
        print(to_json(inspect.info(dataset.open_dataset(spark, a.path), a.stats)))
    elif a.verb == "validate":
        found = inspect.validate(spark, a.path, a.level, a.max_issues)
        print(to_json(found))
        return {"valid": 0, "invalid": 1, "incomplete": 3}[found["status"]]
    elif a.verb == "stats":
        data = dataset.open_dataset(spark, a.path)
        print(to_json(stats.report(data.scan(), contig_frame(spark, data.contigs), a.path, a.min_mapq)))
    elif a.verb in ("head", "view"):
        data, rows = _shown(spark, a)
        limit = None if getattr(a, "all", False) else a.limit
        order = [c for c in ("_shard", "_row") if c in rows.columns]
        rows = rows if limit is None else rows.orderBy(*order).limit(limit) if order else rows.limit(limit)
        body, columns = export.text_lines(rows, data.kind, data.contigs, a.columns.split(",") if a.columns else None)
        if not a.no_header:
            print("\t".join(columns))
        for r in (body.orderBy(*order) if order else body).toLocalIterator():
            print(r.value)
    elif a.verb in ("export", "query"):
        data, rows = _shown(spark, a)
        print(to_json(export.export(rows, a.output, data.kind, data.contigs, a.format, a.columns.split(",") if a.columns else None, a.limit, not a.no_header)))
    elif a.verb == "subset":
        data = dataset.open_dataset(spark, a.path)
        numbers = data.contig_numbers()
        unknown = [c for c in a.chrom or [] if c not in numbers]
        if unknown:
            raise InvalidInput(f"unknown contig: {unknown[0]}")
        chroms = [numbers[c][0] for c in a.chrom] if a.chrom else None
        regions = [parse_region(r, numbers) for r in a.region] if a.region else None
        whole = data.kind == "concat" and a.mode == "complete_reads"
        rows = data.scan(0 if whole else a.min_mapq, whole, ordered=True)
        if data.kind == "pairs":
            rows = subset.subset_pairs(rows, a.min_mapq, chroms, regions, a.read_id, a.pairs_mode)
        else:
            rows = subset.subset_alignments(rows, a.min_mapq, chroms, regions, [int(i) for i in a.read_id] if a.read_id else None, a.mode)
        sidecar = {"_subset.json": to_json({"source": a.path, "min_mapq": a.min_mapq, "chroms": a.chrom, "regions": a.region, "read_ids": a.read_id})}
        print(to_json({"output": a.output, "format": data.kind, "counts": dataset.write_dataset(rows, a.output, data.kind, data.contigs, sidecars=sidecar), "full_scan": True, "index_used": False}))
    elif a.verb == "index":
        data = dataset.open_dataset(spark, a.path)
        found = index.status(data, a.quality) if a.action == "status" else index.build(data, a.quality, a.action == "rebuild")
        print(to_json(found))
    elif a.verb == "merge":
        if len(set(a.inputs)) < len(a.inputs):
            raise InvalidInput("an input is named twice")
        sets = [dataset.open_dataset(spark, p) for p in a.inputs]
        if len({d.kind for d in sets}) > 1:
            raise InvalidInput("pairs and concat don't merge")
        union = [(r["contig"], r["length"]) for r in merge.contig_union([d.contig_table() for d in sets]).orderBy("new_id").collect()]
        parts = [(d.scan(complete=True, ordered=True), d.contig_table()) for d in sets]
        rows = merge.merge_pairs(parts) if sets[0].kind == "pairs" else merge.merge_alignments(parts)
        sources = [{"schema_version": 1, "source_index": i, "path_label": d.path, "format_version": d.metadata["format-version"], "input_read_id_scope": d.scope, "input_records": str(parts[i][0].count())} for i, d in enumerate(sets)]
        lines = "".join(to_json(s) + "\n" for s in sources)
        found = dataset.write_dataset(rows, a.output, sets[0].kind, union, sidecars={"_merge_sources.jsonl": lines})
        if sets[0].kind == "concat":
            merge.merged_ids([r for r, _ in parts]).select(F.col("source").alias("source_index"), F.col("new_id").alias("output_read_id"), F.col("old_id").alias("logical_read_id")).write.json(f"{a.output}/_merge_reads")
        numbers = [copynum.read(spark, d.path, [n for n, _ in d.contigs]) for d in sets]
        if any(n.present for n in numbers):
            declared = [spark.createDataFrame(sorted(n.explicit.items()), "contig string, cn decimal(20,0)") for n in numbers if n.present]
            copynum.replace(spark, a.output, [n for n, _ in union], {r["contig"]: int(r["cn"]) for r in merge.merge_copy_numbers(declared).collect()})
        print(to_json({"output": a.output, "format": sets[0].kind, "counts": found, "sources": sources}))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    own = spark or SparkSession.builder.appName("contactloom").getOrCreate()
    try:
        return run(own, a)
    except (InvalidInput, FileNotFoundError, FileExistsError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
