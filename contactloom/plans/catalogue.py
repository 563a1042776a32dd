"""The registered queries and the SQL that says the same.

Each query runs one operator over the whole contact views of the order tables; the SQL is
written against the same views by hand, not derived from the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import binning, expand, ids, imports, merge, query, regions, stats, subset, zonemap
from contactloom.operators.regions import Region
from contactloom.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TARGET = [Region(3, 10_000, 20_000)]
UNION = [Region(3, 10_000, 20_000), Region(3, 15_000, 30_000), Region(7, 0, 5_000)]
BIN = 10_000
PAIR_COLUMNS = "read_id, chrom1_id, pos1, chrom2_id, pos2, strand1, strand2, mapq"
END1 = "(chrom1_id = 3 AND pos1 - 1 < 20000 AND pos1 > 10000)"
END2 = "(chrom2_id = 3 AND pos2 - 1 < 20000 AND pos2 > 10000)"
HIT = "(chrom_id = 3 AND start_pos < 20000 AND end_pos > 10000)"


def query_of(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {views.WITH}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}"
        return f

    return register


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@query_of("scan_pairs_q1", "SELECT * FROM pairs WHERE mapq >= 1")
def scan_pairs_q1(spark, sf_dir):
    return query.quality(views.pairs(spark, sf_dir), 1)


@query_of("mapq_count", "SELECT count(*) AS n FROM pairs WHERE mapq >= 30")
def mapq_count(spark, sf_dir):
    return query.quality(views.pairs(spark, sf_dir), 30).agg(F.count("*").alias("n"))


@query_of("project_columns", "SELECT chrom2_id, pos2, read_id FROM pairs")
def project_columns(spark, sf_dir):
    return views.pairs(spark, sf_dir).select("chrom2_id", "pos2", "read_id")


@query_of("region_either", f"SELECT * FROM pairs WHERE {END1} OR {END2}")
def region_either(spark, sf_dir):
    return query.query_pairs(views.pairs(spark, sf_dir), TARGET)


@query_of("region_both", f"SELECT * FROM pairs WHERE {END1} AND {END2}")
def region_both(spark, sf_dir):
    return query.query_pairs(views.pairs(spark, sf_dir), TARGET, mode="both")


@query_of("region_mapq", f"SELECT * FROM pairs WHERE ({END1} OR {END2}) AND mapq >= 30")
def region_mapq(spark, sf_dir):
    return query.query_pairs(views.pairs(spark, sf_dir), TARGET, min_mapq=30)


@query_of(
    "region_union",
    """SELECT * FROM pairs WHERE (chrom1_id = 3 AND pos1 BETWEEN 10001 AND 30000) OR (chrom1_id = 7 AND pos1 <= 5000)
       OR (chrom2_id = 3 AND pos2 BETWEEN 10001 AND 30000) OR (chrom2_id = 7 AND pos2 <= 5000)""",
)
def region_union(spark, sf_dir):
    return query.query_pairs(views.pairs(spark, sf_dir), UNION)


@query_of("region_empty", "SELECT * FROM pairs WHERE 1 = 0")
def region_empty(spark, sf_dir):
    return query.query_pairs(views.pairs(spark, sf_dir), [])


@query_of("region_adjacent", "SELECT * FROM pairs WHERE (chrom1_id = 3 AND pos1 BETWEEN 10001 AND 14000) OR (chrom2_id = 3 AND pos2 BETWEEN 10001 AND 14000)")
def region_adjacent(spark, sf_dir):
    """Touching intervals act as one, and an end at a boundary belongs to one side only."""
    return query.query_pairs(views.pairs(spark, sf_dir), [Region(3, 10_000, 12_000), Region(3, 12_000, 14_000)])


@query_of("region_many", "SELECT * FROM pairs WHERE (chrom1_id < 10 AND (pos1 - 1) % 10000 < 500 AND pos1 <= 90000) OR (chrom2_id < 10 AND (pos2 - 1) % 10000 < 500 AND pos2 <= 90000)")
def region_many(spark, sf_dir):
    """Too many intervals for literals: a broadcast semi join."""
    many = [Region(c, s, s + 500) for c in range(10) for s in range(0, 90_000, 10_000)]
    return query.query_pairs(views.pairs(spark, sf_dir), many)


@query_of("concat_region_matching", f"SELECT * FROM alignments WHERE {HIT} AND mapping_quality >= 30")
def concat_region_matching(spark, sf_dir):
    return query.query_alignments(views.alignments(spark, sf_dir), TARGET, 30)


@query_of("concat_region_complete", f"SELECT * FROM alignments WHERE read_idx IN (SELECT read_idx FROM alignments WHERE {HIT} AND mapping_quality >= 30)")
def concat_region_complete(spark, sf_dir):
    return query.query_alignments(views.alignments(spark, sf_dir), TARGET, 30, "complete_reads")


@query_of("subset_chroms_and_region", f"SELECT * FROM pairs WHERE ({END1} AND chrom1_id IN (3, 5)) OR ({END2} AND chrom2_id IN (3, 5))")
def subset_chroms_and_region(spark, sf_dir):
    return subset.subset_pairs(views.pairs(spark, sf_dir), chroms=[3, 5], regions=TARGET)


@query_of("subset_read_ids", "SELECT * FROM alignments WHERE read_idx % 7 = 0 AND read_idx < 3500")
def subset_read_ids(spark, sf_dir):
    return subset.subset_alignments(views.alignments(spark, sf_dir), read_ids=list(range(0, 3500, 7)))


@query_of("subset_pair_ids", "SELECT * FROM pairs WHERE read_id IN ('1_1', '2_1', '3_2', '100_1')")
def subset_pair_ids(spark, sf_dir):
    return subset.subset_pairs(views.pairs(spark, sf_dir), read_ids=["1_1", "2_1", "3_2", "100_1"])


@query_of("subset_both_chroms", "SELECT * FROM pairs WHERE chrom1_id IN (1, 2, 3) AND chrom2_id IN (1, 2, 3)")
def subset_both_chroms(spark, sf_dir):
    return subset.subset_pairs(views.pairs(spark, sf_dir), chroms=[1, 2, 3], mode="both")


@query_of("subset_complete_chrom", "SELECT * FROM alignments WHERE read_idx IN (SELECT read_idx FROM alignments WHERE chrom_id = 4 AND mapping_quality >= 55)")
def subset_complete_chrom(spark, sf_dir):
    return subset.subset_alignments(views.alignments(spark, sf_dir), 55, chroms=[4], mode="complete_reads")


@query_of("limit_ordered", f"SELECT * FROM pairs ORDER BY read_id, pos1, pos2, {PAIR_COLUMNS} LIMIT 100")
def limit_ordered(spark, sf_dir):
    return query.head(views.pairs(spark, sf_dir), 100, ["read_id", "pos1", "pos2", *PAIR_COLUMNS.split(", ")])


@query_of("read_groups", "SELECT read_idx, count(*) AS n, min(read_start) AS first_start FROM alignments GROUP BY read_idx")
def read_groups(spark, sf_dir):
    return views.alignments(spark, sf_dir).groupBy("read_idx").agg(F.count("*").alias("n"), F.min("read_start").alias("first_start"))


@query_of(
    "logical_ids",
    """+ placed AS (SELECT read_idx, chrom_id AS shard, row_number() OVER (PARTITION BY chrom_id ORDER BY read_idx % 97, read_idx, source_row) AS r FROM alignments),
     flagged AS (SELECT *, CASE WHEN lag(read_idx) OVER (PARTITION BY shard ORDER BY r) = read_idx THEN 0 ELSE 1 END AS fresh FROM placed),
     numbered AS (SELECT read_idx, CAST(sum(fresh) OVER (ORDER BY shard, r ROWS UNBOUNDED PRECEDING) AS BIGINT) AS logical_id FROM flagged)
     SELECT DISTINCT read_idx, logical_id FROM numbered""",
)
def logical_ids(spark, sf_dir):
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("chrom_id").orderBy(F.col("read_idx") % 97, "read_idx", "source_row"))
    rows = views.alignments(spark, sf_dir).select("read_idx", F.col("chrom_id").alias("_shard"), row.cast("bigint").alias("_row"))
    return ids.logical_ids(rows).select("read_idx", "logical_id").distinct()


def _expand_sql(source: str, low: int, high: int | None) -> str:
    most = f" AND n < {high}" if high else ""
    return f"""
     chosen AS (SELECT *, CAST(row_number() OVER (PARTITION BY read_idx ORDER BY read_start, source_row) - 1 AS BIGINT) AS i,
                count(*) OVER (PARTITION BY read_idx) AS n FROM {source}),
     fitting AS (SELECT *, start_pos + (end_pos - start_pos) // 2 + 1 AS mid FROM chosen WHERE n >= {low}{most})
     SELECT a.read_idx || ':' || a.i || ':' || b.i AS read_id, a.chrom_id AS chrom1_id, a.mid AS pos1, b.chrom_id AS chrom2_id, b.mid AS pos2,
            a.strand AS strand1, b.strand AS strand2, least(a.mapping_quality, b.mapping_quality) AS mapq
     FROM fitting a JOIN fitting b ON a.read_idx = b.read_idx AND a.i < b.i"""


@query_of("expand_pairs", "+" + _expand_sql("alignments", 2, None))
def expand_pairs(spark, sf_dir):
    return expand.expand(views.alignments(spark, sf_dir))


@query_of("expand_mapq30", "+" + _expand_sql("(SELECT * FROM alignments WHERE mapping_quality >= 30)", 2, None))
def expand_mapq30(spark, sf_dir):
    return expand.expand(views.alignments(spark, sf_dir), 30)


@query_of("expand_order_bounds", "+" + _expand_sql("(SELECT * FROM alignments WHERE mapping_quality >= 30)", 2, 6))
def expand_order_bounds(spark, sf_dir):
    return expand.expand(views.alignments(spark, sf_dir), 30, 2, 6)


@query_of(
    "complete_then_expand",
    "+" + f" complete AS (SELECT * FROM alignments WHERE read_idx IN (SELECT read_idx FROM alignments WHERE {HIT} AND mapping_quality >= 30)),"
    + _expand_sql("(SELECT * FROM complete WHERE mapping_quality >= 10)", 2, None),
)
def complete_then_expand(spark, sf_dir):
    return expand.expand(query.query_alignments(views.alignments(spark, sf_dir), TARGET, 30, "complete_reads"), 10)


REASON = """CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 1536 <> 0 THEN 'duplicate_or_qcfail' WHEN flag & 256 <> 0 THEN 'secondary'
            WHEN mapping_quality < {q} THEN 'mapq' ELSE 'selected' END"""


@query_of("import_filter_reasons", f"SELECT {REASON.format(q=10)} AS reason, count(*) AS n FROM import_records GROUP BY 1")
def import_filter_reasons(spark, sf_dir):
    return imports.filter_reasons(views.import_records(spark, sf_dir), 10)


def _import_sql(position: str) -> str:
    return f"""+ chosen AS (SELECT *, row_number() OVER (PARTITION BY rg, name ORDER BY mate, read_start, ordinal) - 1 AS i, {position} AS pos
         FROM import_records WHERE {REASON.format(q=10)} = 'selected'),
     both_ends AS (SELECT a.name || ':' || a.i || ':' || b.i AS read_id, a.chrom_id AS c1, a.pos AS p1, a.strand AS s1, b.chrom_id AS c2, b.pos AS p2, b.strand AS s2,
         least(a.mapping_quality, b.mapping_quality) AS mapq, a.chrom_id > b.chrom_id OR (a.chrom_id = b.chrom_id AND a.pos > b.pos) AS swap
         FROM chosen a JOIN chosen b ON a.rg = b.rg AND a.name = b.name AND a.i < b.i)
     SELECT read_id, CASE WHEN swap THEN c2 ELSE c1 END AS chrom1_id, CASE WHEN swap THEN p2 ELSE p1 END AS pos1, CASE WHEN swap THEN c1 ELSE c2 END AS chrom2_id,
         CASE WHEN swap THEN p1 ELSE p2 END AS pos2, CASE WHEN swap THEN s2 ELSE s1 END AS strand1, CASE WHEN swap THEN s1 ELSE s2 END AS strand2, mapq FROM both_ends"""


@query_of("import_pairs_leftmost", _import_sql("start_pos + 1"))
def import_pairs_leftmost(spark, sf_dir):
    return imports.import_pairs(views.import_records(spark, sf_dir), 10)


@query_of("import_pairs_five_prime", _import_sql("CASE WHEN strand = '-' THEN end_pos ELSE start_pos + 1 END"))
def import_pairs_five_prime(spark, sf_dir):
    return imports.import_pairs(views.import_records(spark, sf_dir), 10, five_prime=True)


@query_of(
    "import_concat_ids",
    f"""+ reads AS (SELECT rg, name, mate, count(*) AS n FROM import_records WHERE {REASON.format(q=10)} = 'selected' GROUP BY ALL)
     SELECT row_number() OVER (ORDER BY rg, name, mate) AS read_idx, rg, name, mate, n FROM reads""",
)
def import_concat_ids(spark, sf_dir):
    return imports.import_reads(views.import_records(spark, sf_dir), 10).select("read_idx", "rg", "name", "mate", "n")


@query_of(
    "import_statistics",
    f"""+ judged AS (SELECT *, {REASON.format(q=10)} AS reason FROM import_records),
     reads AS (SELECT rg, name, count(*) AS n FROM judged WHERE reason = 'selected' GROUP BY ALL)
     SELECT * FROM (SELECT count(*) AS input_records, count(*) FILTER (reason = 'unmapped') AS skipped_unmapped, count(*) FILTER (reason = 'duplicate_or_qcfail') AS skipped_duplicate_or_qcfail,
         count(*) FILTER (reason = 'secondary') AS skipped_secondary, count(*) FILTER (reason = 'mapq') AS skipped_mapq FROM judged),
       (SELECT count(*) FILTER (n >= 2 AND n < 5) AS selected_read_groups, count(*) FILTER (n < 2 OR n >= 5) AS skipped_order_groups FROM reads)""",
)
def import_statistics(spark, sf_dir):
    return imports.import_statistics(views.import_records(spark, sf_dir), 10, 2, 5, by_mate=False)


@query_of(
    "bin_table",
    """+ sized AS (SELECT contig_id, length, CAST(coalesce(sum((length + 9999) // 10000) OVER (ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first,
       unnest(range((length + 9999) // 10000)) AS k FROM contigs)
     SELECT contig_id, first + k AS bin_id, k * 10000 AS "start", least((k + 1) * 10000, length) AS "end" FROM sized""",
)
def bin_table(spark, sf_dir):
    return binning.bin_table(views.contigs(spark, sf_dir), BIN)


OFFSETS = "offsets AS (SELECT contig_id, CAST(coalesce(sum((length + 9999) // 10000) OVER (ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM contigs)"


@query_of("chrom_offset", f"+ {OFFSETS} SELECT * FROM offsets")
def chrom_offset(spark, sf_dir):
    return binning.chrom_offset(views.contigs(spark, sf_dir), BIN)


def _pixels_sql(q: int) -> str:
    return f"""+ {OFFSETS}, ends AS (SELECT a."offset" + (pos1 - 1) // 10000 AS x, b."offset" + (pos2 - 1) // 10000 AS y FROM pairs
       JOIN offsets a ON chrom1_id = a.contig_id JOIN offsets b ON chrom2_id = b.contig_id WHERE mapq >= {q}),
     pixels AS (SELECT least(x, y) AS bin1, greatest(x, y) AS bin2, count(*) AS "count" FROM ends GROUP BY ALL)"""


@query_of("pixels", _pixels_sql(0) + " SELECT * FROM pixels")
def pixels(spark, sf_dir):
    return binning.pixels(views.pairs(spark, sf_dir), views.contigs(spark, sf_dir), BIN)


@query_of("pixels_mapq", _pixels_sql(30) + " SELECT * FROM pixels")
def pixels_mapq(spark, sf_dir):
    return binning.pixels(views.pairs(spark, sf_dir), views.contigs(spark, sf_dir), BIN, 30)


@query_of(
    "bin1_offset",
    _pixels_sql(1)
    + """, total AS (SELECT CAST(sum((length + 9999) // 10000) AS BIGINT) AS n FROM contigs), bins AS (SELECT unnest(range(n + 1)) AS bin1 FROM total),
     per AS (SELECT bin1, count(*) AS c FROM pixels GROUP BY bin1)
     SELECT bins.bin1, CAST(coalesce(sum(c) OVER (ORDER BY bins.bin1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM bins LEFT JOIN per ON bins.bin1 = per.bin1""",
)
def bin1_offset(spark, sf_dir):
    contigs = views.contigs(spark, sf_dir)
    return binning.bin1_offset(binning.pixels(views.pairs(spark, sf_dir), contigs, BIN, 1), contigs, BIN)


@query_of(
    "cool_summary",
    _pixels_sql(1)
    + """ SELECT (SELECT count(*) FROM pixels) AS nnz, (SELECT CAST(sum("count") AS BIGINT) FROM pixels) AS "sum", (SELECT CAST(sum((length + 9999) // 10000) AS BIGINT) FROM contigs) AS nbins,
     (SELECT count(*) FROM contigs) AS nchroms, (SELECT count(*) FROM pairs) AS input_records, (SELECT count(*) FROM pairs WHERE mapq < 1) AS skipped_mapq, CAST(0 AS BIGINT) AS skipped_unmapped""",
)
def cool_summary(spark, sf_dir):
    return binning.cool_summary(views.pairs(spark, sf_dir), views.contigs(spark, sf_dir), BIN, 1)


COUNTS = """count(*) AS scanned_records, count(*) FILTER ({c} >= 10) AS selected_records, count(*) FILTER ({c} < 10) AS filtered_records,
    count(*) FILTER ({c} >= 10) / CAST(count(*) AS DOUBLE) AS selected_fraction, CAST(0 AS DOUBLE) AS mapq_zero_fraction,
    count(*) FILTER ({c} >= 30) / CAST(count(*) FILTER ({c} >= 10) AS DOUBLE) AS mapq_ge30_fraction"""


@query_of(
    "stats_summary_pairs",
    f"""SELECT {COUNTS.format(c="mapq")}, count(*) FILTER (mapq >= 10 AND chrom1_id = chrom2_id) AS cis_records, count(*) FILTER (mapq >= 10 AND chrom1_id <> chrom2_id) AS trans_records,
     count(*) FILTER (mapq >= 10 AND chrom1_id = chrom2_id) / CAST(count(*) FILTER (mapq >= 10) AS DOUBLE) AS cis_fraction,
     count(*) FILTER (mapq >= 10 AND chrom1_id <> chrom2_id) / CAST(count(*) FILTER (mapq >= 10) AS DOUBLE) AS trans_fraction FROM pairs""",
)
def stats_summary_pairs(spark, sf_dir):
    return stats.pairs_summary(views.pairs(spark, sf_dir), 10)


@query_of(
    "stats_distance",
    """+ gaps AS (SELECT abs(pos1 - pos2) AS d FROM pairs WHERE chrom1_id = chrom2_id AND mapq >= 10),
     classes AS (SELECT * FROM (VALUES ('0-999', 0, 1000), ('1000-9999', 1000, 10000), ('10000-99999', 10000, 100000), ('100000-999999', 100000, 1000000), ('1000000+', 1000000, 9000000000)) AS v(bucket, low, high))
     SELECT bucket, count(d) AS n FROM classes LEFT JOIN gaps ON d >= low AND d < high GROUP BY bucket""",
)
def stats_distance(spark, sf_dir):
    return stats.distances(views.pairs(spark, sf_dir), 10)


@query_of("stats_strands", "SELECT strand1 || strand2 AS strands, count(*) AS n FROM pairs GROUP BY 1")
def stats_strands(spark, sf_dir):
    return stats.strand_pairs(views.pairs(spark, sf_dir))


@query_of(
    "stats_per_contig",
    """+ ends AS (SELECT chrom1_id AS c FROM pairs WHERE mapq >= 58 UNION ALL SELECT chrom2_id FROM pairs WHERE mapq >= 58)
     SELECT contig, count(c) AS n FROM contigs LEFT JOIN ends ON c = contig_id GROUP BY contig""",
)
def stats_per_contig(spark, sf_dir):
    return stats.per_contig(views.pairs(spark, sf_dir), views.contigs(spark, sf_dir), 58)


@query_of("stats_mapq_histogram", "SELECT q.mapq, count(p.mapq) AS n FROM (SELECT unnest(range(256)) AS mapq) q LEFT JOIN pairs p ON p.mapq = q.mapq GROUP BY q.mapq")
def stats_mapq_histogram(spark, sf_dir):
    return stats.mapq_histogram(views.pairs(spark, sf_dir))


@query_of(
    "stats_concat_summary",
    f"""+ chosen AS (SELECT * FROM alignments WHERE mapping_quality >= 10),
     reads AS (SELECT read_idx, count(*) AS k, max(read_length) AS length, count(DISTINCT chrom_id) > 1 AS multi FROM chosen GROUP BY read_idx)
     SELECT * REPLACE (round(mean_identity, 9) AS mean_identity) FROM (SELECT {COUNTS.format(c="mapping_quality")}, CAST(sum(end_pos - start_pos) FILTER (mapping_quality >= 10) AS BIGINT) AS aligned_reference_bases,
       avg("identity") FILTER (mapping_quality >= 10) AS mean_identity, CAST(0 AS BIGINT) AS nonfinite_identity_records FROM alignments),
     (SELECT count(DISTINCT read_idx) AS scanned_reads FROM alignments),
     (SELECT count(*) AS selected_reads, sum(k) / CAST(count(*) AS DOUBLE) AS mean_read_order, sum(length) / CAST(count(*) AS DOUBLE) AS mean_read_length, count(*) FILTER (multi) AS multi_contig_reads FROM reads)""",
)
def stats_concat_summary(spark, sf_dir):
    """The mean is rounded: sums of floating numbers depend on their order."""
    return stats.concat_summary(views.alignments(spark, sf_dir), 10).withColumn("mean_identity", F.round("mean_identity", 9))


@query_of("stats_read_order", 'SELECT k AS "order", count(*) AS n FROM (SELECT count(*) AS k FROM alignments WHERE mapping_quality >= 10 GROUP BY read_idx) GROUP BY k')
def stats_read_order(spark, sf_dir):
    return stats.read_orders(views.alignments(spark, sf_dir), 10)


@query_of("stats_filter_reasons", "SELECT filter_reason, count(*) AS n FROM alignments GROUP BY filter_reason")
def stats_filter_reasons(spark, sf_dir):
    return stats.reasons(views.alignments(spark, sf_dir))


def _second_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dictionary in the reverse order, with other names for the upper half."""
    name = F.when(F.col("contig_id") >= 12, F.concat(F.lit("x"), "contig")).otherwise(F.col("contig"))
    return views.contigs(spark, sf_dir).select((24 - F.col("contig_id")).alias("contig_id"), name.alias("contig"), "length")


SECOND = """second AS (SELECT 24 - contig_id AS contig_id, CASE WHEN contig_id >= 12 THEN 'x' || contig ELSE contig END AS contig, length FROM contigs),
  firsts AS (SELECT contig, min(s * 1000 + contig_id) AS place, min(length) AS length FROM (SELECT 0 AS s, * FROM contigs UNION ALL SELECT 1, * FROM second) GROUP BY contig),
  joined_contigs AS (SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INT) AS new_id, contig, length FROM firsts)"""


@query_of("contig_union", f"+ {SECOND} SELECT * FROM joined_contigs")
def contig_union(spark, sf_dir):
    return merge.contig_union([views.contigs(spark, sf_dir), _second_contigs(spark, sf_dir)])


@query_of(
    "merge_pairs",
    f"""+ {SECOND}, m0 AS (SELECT contig_id, new_id FROM contigs JOIN joined_contigs USING (contig)), m1 AS (SELECT contig_id, new_id FROM second JOIN joined_contigs USING (contig))
     SELECT read_id, a.new_id AS chrom1_id, pos1, b.new_id AS chrom2_id, pos2, strand1, strand2, mapq, 0 AS source FROM pairs JOIN m0 a ON chrom1_id = a.contig_id JOIN m0 b ON chrom2_id = b.contig_id
     UNION ALL SELECT read_id, a.new_id, pos1, b.new_id, pos2, strand1, strand2, mapq, 1 FROM pairs JOIN m1 a ON chrom1_id = a.contig_id JOIN m1 b ON chrom2_id = b.contig_id WHERE mapq >= 40""",
)
def merge_pairs(spark, sf_dir):
    pairs = views.pairs(spark, sf_dir)
    return merge.merge_pairs([(pairs, views.contigs(spark, sf_dir)), (pairs.where("mapq >= 40"), _second_contigs(spark, sf_dir))])


@query_of(
    "merge_concat_reid",
    """+ old AS (SELECT DISTINCT 0 AS source, read_idx AS old_id FROM alignments UNION ALL SELECT DISTINCT 1, read_idx FROM alignments WHERE mapping_quality >= 40)
     SELECT source, old_id, row_number() OVER (ORDER BY source, old_id) AS new_id FROM old""",
)
def merge_concat_reid(spark, sf_dir):
    rows = views.alignments(spark, sf_dir)
    return merge.merged_ids([rows, rows.where("mapping_quality >= 40")])


@query_of("copy_number_effective", "SELECT contig, CAST(CASE WHEN contig_id % 4 = 0 THEN contig_id + 1 ELSE 1 END AS BIGINT) AS cn FROM contigs")
def copy_number_effective(spark, sf_dir):
    contigs = views.contigs(spark, sf_dir)
    declared = contigs.where("contig_id % 4 = 0").select("contig", (F.col("contig_id") + 1).cast("bigint").alias("cn"))
    return merge.effective_copy_numbers(contigs, declared)


@query_of(
    "zone_map",
    """SELECT pos1 // 30000 AS part, contig_id, endpoint, min(s) AS min_start, max(e) AS max_end, max(mapq) AS max_mapq FROM
     (SELECT pos1, mapq, 1 AS endpoint, chrom1_id AS contig_id, pos1 - 1 AS s, pos1 AS e FROM pairs UNION ALL SELECT pos1, mapq, 2, chrom2_id, pos2 - 1, pos2 FROM pairs) GROUP BY ALL""",
)
def zone_map(spark, sf_dir):
    return zonemap.zone_map(views.pairs(spark, sf_dir), F.expr("pos1 div 30000"))


@query_of("zone_candidates", f"SELECT pos1 // 30000 AS part FROM pairs GROUP BY 1 HAVING max(CASE WHEN chrom1_id = 3 THEN pos1 END) > 10000 AND min(CASE WHEN chrom1_id = 3 THEN pos1 END) <= 20000 AND max(CASE WHEN chrom2_id = 3 THEN pos2 END) > 10000 AND min(CASE WHEN chrom2_id = 3 THEN pos2 END) <= 20000")
def zone_candidates(spark, sf_dir):
    zones = zonemap.zone_map(views.pairs(spark, sf_dir), F.expr("pos1 div 30000"))
    return zonemap.candidate_parts(zones, TARGET, mode="both")


@query_of(
    "q1_consistency",
    """+ ranked AS (SELECT *, row_number() OVER (PARTITION BY chrom1_id ORDER BY read_id, pos1, pos2, mapq) AS r FROM pairs WHERE mapq >= 1),
     damaged AS (SELECT read_id, CASE WHEN mapq = 33 THEN pos1 + 1 ELSE pos1 END AS pos1, mapq, chrom1_id, CASE WHEN r = 4 THEN 5 WHEN r = 5 THEN 4 ELSE r END AS r FROM ranked WHERE NOT (chrom1_id = 24 AND r > 20)),
     a AS (SELECT row_number() OVER (ORDER BY chrom1_id, r) AS place, read_id, pos1 FROM ranked), b AS (SELECT row_number() OVER (ORDER BY chrom1_id, r) AS place, read_id, pos1 FROM damaged)
     SELECT place FROM a FULL JOIN b USING (place) WHERE a.read_id IS DISTINCT FROM b.read_id OR a.pos1 IS DISTINCT FROM b.pos1""",
)
def q1_consistency(spark, sf_dir):
    """Places at which a damaged copy differs: positions changed, rows exchanged, and the last ones gone."""
    from pyspark.sql import Window

    from contactloom.operators.validate import sequence_mismatches

    row = F.row_number().over(Window.partitionBy("chrom1_id").orderBy("read_id", "pos1", "pos2", "mapq")).cast("bigint")
    rows = query.quality(views.pairs(spark, sf_dir), 1).withColumns({"_shard": F.col("chrom1_id"), "_row": row}).select("read_id", "pos1", "mapq", "_shard", "_row")
    copy = rows.where("not (_shard = 24 and _row > 20)").withColumns({"pos1": F.expr("case when mapq = 33 then pos1 + 1 else pos1 end"), "_row": F.expr("case _row when 4 then 5L when 5 then 4L else _row end")})
    return sequence_mismatches(rows, copy).select(F.col("_place").cast("bigint").alias("place"))


@query_of(
    "interval_merge",
    """+ spans AS (SELECT chrom_id AS contig_id, start_pos AS s, end_pos + 20 AS e FROM alignments WHERE mapping_quality >= 58),
     flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY contig_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
     islands AS (SELECT *, sum(fresh) OVER (PARTITION BY contig_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged)
     SELECT contig_id, min(s) AS "start", max(e) AS "end" FROM islands GROUP BY contig_id, island""",
)
def interval_merge(spark, sf_dir):
    spans = views.alignments(spark, sf_dir).where("mapping_quality >= 58").select(F.col("chrom_id").alias("contig_id"), F.col("start_pos").alias("start"), (F.col("end_pos") + 20).alias("end"))
    return regions.merge_intervals(spans)


@query_of("dataset_counts", "SELECT count(*) AS q0_records, count(*) FILTER (mapping_quality >= 1) AS q1_records, count(DISTINCT read_idx) AS q0_reads, count(DISTINCT CASE WHEN mapping_quality >= 1 THEN read_idx END) AS q1_reads FROM alignments")
def dataset_counts(spark, sf_dir):
    from contactloom.operators.validate import counts

    return counts(views.alignments(spark, sf_dir))
