"""Quality statistics of pairs and alignments, and the JSON reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower bounds of the distance classes of pairs within a contig, with their names. Fixed values.
DISTANCES = ((0, "0-999"), (1_000, "1000-9999"), (10_000, "10000-99999"), (100_000, "100000-999999"), (1_000_000, "1000000+"))


def _ratio(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def quality_counts(rows: DataFrame, column: str, min_mapq: int) -> list:
    """scanned, selected, filtered and the fractions over the selected rows, as aggregates."""
    q = F.col(column)
    chosen = F.count(F.when(q >= min_mapq, 1))
    return [
        F.count("*").alias("scanned_records"),
        chosen.alias("selected_records"),
        (F.count("*") - chosen).alias("filtered_records"),
        _ratio(chosen, F.count("*")).alias("selected_fraction"),
        _ratio(F.count(F.when((q >= min_mapq) & (q == 0), 1)), chosen).alias("mapq_zero_fraction"),
        _ratio(F.count(F.when((q >= min_mapq) & (q >= 30), 1)), chosen).alias("mapq_ge30_fraction"),
    ]


def pairs_summary(pairs: DataFrame, min_mapq: int = 0) -> DataFrame:
    """One row of counts and fractions."""
    chosen, cis = F.col("mapq") >= min_mapq, F.col("chrom1_id") == F.col("chrom2_id")
    n, same = F.count(F.when(chosen, 1)), F.count(F.when(chosen & cis, 1))
    other = F.count(F.when(chosen & ~cis, 1))
    return pairs.agg(*quality_counts(pairs, "mapq", min_mapq), same.alias("cis_records"), other.alias("trans_records"), _ratio(same, n).alias("cis_fraction"), _ratio(other, n).alias("trans_fraction"))


def distance_class() -> Column:
    gap = F.abs(F.col("pos1") - F.col("pos2"))
    name = F.lit(DISTANCES[0][1])
    for low, label in DISTANCES[1:]:
        name = F.when(gap >= low, label).otherwise(name)
    return name


def distances(pairs: DataFrame, min_mapq: int = 0) -> DataFrame:
    """bucket and n for all distance classes, empty ones included."""
    found = pairs.where((F.col("mapq") >= min_mapq) & (F.col("chrom1_id") == F.col("chrom2_id"))).groupBy(distance_class().alias("bucket")).agg(F.count("*").alias("_n"))
    names = pairs.sparkSession.createDataFrame([(n,) for _, n in DISTANCES], "bucket string")
    return names.join(found, "bucket", "left").select("bucket", F.coalesce("_n", F.lit(0)).alias("n"))


def strand_pairs(pairs: DataFrame, min_mapq: int = 0) -> DataFrame:
    return pairs.where(F.col("mapq") >= min_mapq).groupBy(F.concat("strand1", "strand2").alias("strands")).agg(F.count("*").alias("n"))


def per_contig(rows: DataFrame, contigs: DataFrame, min_mapq: int = 0) -> DataFrame:
    """contig and n; both ends of a pair count, so a pair within a contig counts twice there. Zeros are kept."""
    if "chrom1_id" in rows.columns:
        ids = rows.where(F.col("mapq") >= min_mapq).select(F.explode(F.array("chrom1_id", "chrom2_id")).alias("contig_id"))
    else:
        ids = rows.where(F.col("mapping_quality") >= min_mapq).select(F.col("chrom_id").alias("contig_id"))
    found = ids.groupBy("contig_id").agg(F.count("*").alias("_n"))
    return contigs.join(found, "contig_id", "left").select("contig", F.coalesce("_n", F.lit(0)).alias("n"))


def mapq_histogram(rows: DataFrame) -> DataFrame:
    """mapq 0 to 255 and n over all rows."""
    column = "mapq" if "mapq" in rows.columns else "mapping_quality"
    found = rows.groupBy(F.col(column).cast("bigint").alias("mapq")).agg(F.count("*").alias("_n"))
    return rows.sparkSession.range(256).select(F.col("id").alias("mapq")).join(found, "mapq", "left").select("mapq", F.coalesce("_n", F.lit(0)).alias("n"))


def _reads(rows: DataFrame, min_mapq: int) -> DataFrame:
    """One row for each read: selected alignments, its length, whether it touches several contigs."""
    chosen = F.col("mapping_quality") >= min_mapq
    only = lambda c: F.when(chosen, F.col(c))
    return rows.groupBy("read_idx").agg(F.count(F.when(chosen, 1)).alias("order"), F.max(only("read_length")).alias("length"), (F.min(only("chrom_id")) != F.max(only("chrom_id"))).alias("multi"))


def concat_summary(rows: DataFrame, min_mapq: int = 0) -> DataFrame:
    """One row. mean_identity adds up finite values in double precision."""
    chosen = F.col("mapping_quality") >= min_mapq
    identity = F.col("identity").cast("double")
    finite = ~F.isnan(identity) & (F.abs(identity) != F.lit(float("inf")))
    own = rows.agg(
        *quality_counts(rows, "mapping_quality", min_mapq),
        F.coalesce(F.sum(F.when(chosen, F.col("end_pos") - F.col("start_pos"))), F.lit(0)).cast("bigint").alias("aligned_reference_bases"),
        F.avg(F.when(chosen & finite, identity)).alias("mean_identity"),
        F.count(F.when(chosen & ~finite, 1)).alias("nonfinite_identity_records"),
    )
    some = F.col("order") > 0
    reads = _reads(rows, min_mapq).agg(
        F.count("*").alias("scanned_reads"),
        F.count(F.when(some, 1)).alias("selected_reads"),
        _ratio(F.sum(F.when(some, F.col("order"))), F.count(F.when(some, 1))).alias("mean_read_order"),
        _ratio(F.sum(F.when(some, F.col("length"))), F.count(F.when(some, 1))).alias("mean_read_length"),
        F.count(F.when(some & F.col("multi"), 1)).alias("multi_contig_reads"),
    )
    return own.join(F.broadcast(reads), F.lit(True))


def read_orders(rows: DataFrame, min_mapq: int = 0) -> DataFrame:
    """order and n: selected alignments of a read, without reads that have none."""
    return _reads(rows, min_mapq).where("order > 0").groupBy("order").agg(F.count("*").alias("n"))


def reasons(rows: DataFrame, min_mapq: int = 0) -> DataFrame:
    return rows.where(F.col("mapping_quality") >= min_mapq).groupBy("filter_reason").agg(F.count("*").alias("n"))


def tagged(rows: DataFrame, min_mapq: int = 0) -> DataFrame:
    """tag, key and n: every histogram of the rows in one pass and one aggregate with sums on the map side. Keys are
    contigs, qualities, reasons, strands and distance classes, so there are few."""
    pairs = "chrom1_id" in rows.columns
    quality = F.col("mapq" if pairs else "mapping_quality")
    entry = lambda tag, key: F.struct(F.lit(tag).alias("tag"), key.cast("string").alias("key"))
    if pairs:
        cis = F.col("chrom1_id") == F.col("chrom2_id")
        chosen = [entry("contig", F.col("chrom1_id")), entry("contig", F.col("chrom2_id")), entry("strands", F.concat("strand1", "strand2")), entry("cis", cis), entry("distance", F.when(cis, distance_class()).otherwise("none"))]
    else:
        chosen = [entry("contig", F.col("chrom_id")), entry("reason", F.col("filter_reason"))]
    entries = F.when(quality >= min_mapq, F.array(entry("mapq", quality), *chosen)).otherwise(F.array(entry("below", F.lit("all"))))
    return rows.select(F.explode(entries).alias("e")).groupBy("e.tag", "e.key").agg(F.count("*").alias("n"))


def report(rows: DataFrame, contigs: DataFrame, path: str, min_mapq: int = 0) -> dict:
    """The whole statistics report: pairs are read once, alignments once more for their reads and once for sums of
    floating numbers. What reaches the driver are counts: contigs, qualities, orders, reasons."""
    pairs = "chrom1_id" in rows.columns
    found: dict[str, dict[str, int]] = {}
    for r in tagged(rows, min_mapq).collect():
        found.setdefault(r["tag"], {})[r["key"]] = r["n"]
    of = lambda tag: dict(sorted(found.get(tag, {}).items()))
    qualities = {int(q): n for q, n in of("mapq").items()}
    chosen, below = sum(qualities.values()), sum(of("below").values())
    part = lambda n, of_all: n / of_all if of_all else None
    out = {
        "path": path, "format": "pairs" if pairs else "concat", "source_quality": "q0", "min_mapq": min_mapq,
        "scanned_records": chosen + below, "selected_records": chosen, "filtered_records": below, "selected_fraction": part(chosen, chosen + below),
        "mapq_zero_fraction": part(qualities.get(0, 0), chosen), "mapq_ge30_fraction": part(sum(n for q, n in qualities.items() if q >= 30), chosen),
        "mapq_histogram": [qualities.get(q, 0) for q in range(256)],
        "per_contig": [{"contig": r["contig"], "count": of("contig").get(str(r["contig_id"]), 0)} for r in contigs.orderBy("contig_id").collect()],
        "per_contig_unit": "endpoints" if pairs else "alignments",
    }
    if pairs:
        same, other = of("cis").get("true", 0), of("cis").get("false", 0)
        out |= {"cis_records": same, "trans_records": other, "cis_fraction": part(same, chosen), "trans_fraction": part(other, chosen)}
        out["cis_distance_bp"] = {name: of("distance").get(name, 0) for _, name in DISTANCES}
        out["strand_pairs"] = of("strands")
        return out
    out |= concat_summary(rows, min_mapq).first().asDict()
    out["read_order_histogram"] = {str(r["order"]): r["n"] for r in sorted(read_orders(rows, min_mapq).collect(), key=lambda r: str(r["order"]))}
    out["filter_reasons"] = of("reason")
    return out
