"""Literal fixtures with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from contactloom.operators import binning, expand, imports, merge, query, regions, stats, subset, zonemap
from contactloom.operators.ids import logical_ids
from contactloom.operators.regions import Region
from contactloom.schema import CONCAT_DDL, PAIRS_DDL, InvalidInput, checked

BIG = 1 << 33


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, PAIRS_DDL)


def concat_of(spark, rows):
    return spark.createDataFrame(rows, CONCAT_DDL + ", source_row bigint")


def contigs_of(spark, *contigs):
    return spark.createDataFrame([(i, n, length) for i, (n, length) in enumerate(contigs)], "contig_id int, contig string, length bigint")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_region_parsing_and_merging():
    contigs = {"chr1": (0, 1000), "a:b": (1, 50)}
    assert regions.parse_region("a:b:0-50", contigs) == Region(1, 0, 50)
    for bad in ("chr1", "chr1:5-5", "chr1:0-1001", "x:0-1"):
        with pytest.raises(InvalidInput):
            regions.parse_region(bad, contigs)
    assert regions.merged([Region(0, 10, 20), Region(0, 0, 10), Region(1, 5, 6), Region(0, 30, 40)]) == [Region(0, 0, 20), Region(0, 30, 40), Region(1, 5, 6)]


@pytest.fixture
def contacts(spark):
    rows = [
        ("a", 0, 1, 0, 11, "+", "-", 0),
        ("b", 0, 10, 1, 5, "+", "+", 20),
        ("b", 0, 10, 1, 5, "+", "+", 20),
        ("c", 0, BIG - 1, 0, BIG, "-", "-", 30),
        ("d", 1, 10, 0, 11, "-", "+", 60),
        ("e", 1, 20, 1, 21, "-", "+", 60),
    ]
    return pairs_of(spark, rows)


def test_region_boundaries_duplicates_and_modes(contacts):
    hit = lambda *r, **k: sorted(x.read_id for x in query.query_pairs(contacts, [Region(*x) for x in r], **k).collect())
    assert hit((0, 0, 10)) == ["a", "b", "b"]
    assert hit((0, 10, 11)) == ["a", "d"]
    assert hit((0, 0, 11), mode="both") == ["a"]
    assert hit((0, 0, 11), (1, 0, 30), mode="both") == ["a", "b", "b", "d", "e"]
    assert hit((0, BIG - 1, BIG)) == ["c"]
    assert hit(min_mapq=0) == []
    assert query.query_pairs(contacts, None, 30).count() == 3


def test_region_lists_of_any_length(spark):
    rng = random.Random(408)
    places = [(f"p{k}", *(v for _ in range(2) for v in (rng.choice([0, 1, 4]), rng.randint(1, 3000))), "+", "+", 7) for k in range(150)]
    rows = pairs_of(spark, places)
    for count in (2, 70, 200):
        own = [Region(rng.choice([0, 4]), at, at + rng.choice([1, 5, 12])) for at in (rng.randrange(2900) for _ in range(count))]
        covered = {(r.contig_id, p) for r in own for p in range(r.start + 1, r.end + 1)}
        ends = {name: [(c, p) in covered for c, p in ((a, b), (d, e))] for name, a, b, d, e, *_ in places}
        for mode, holds in (("either", any), ("both", all)):
            want = sorted(name for name, hit in ends.items() if holds(hit))
            assert sorted(r.read_id for r in query.query_pairs(rows, own, 0, mode).collect()) == want
            assert sorted(r.read_id for r in subset.subset_pairs(rows, regions=own, mode=mode).collect()) == want
            within = {name: [h and c == 4 for h, c in zip(ends[name], (a, d), strict=True)] for name, a, _, d, *_ in places}
            assert sorted(r.read_id for r in subset.subset_pairs(rows, chroms=[4], regions=own, mode=mode).collect()) == sorted(n for n, hit in within.items() if holds(hit))


def test_complete_reads_keep_low_quality_rows(spark):
    quality = [(1, 0), (1, 60), (2, 0), (2, 0), (3, 60), (3, 0), (3, 0), (3, 0), (3, 0), (4, 60)]
    rows = concat_of(spark, [(i, 100, k, k + 10, "+", 0, k * 10, k * 10 + 10, q, 0.9, "", k) for k, (i, q) in enumerate(quality)])
    assert [r.read_idx for r in query.query_alignments(rows, None, 1).orderBy("read_idx").collect()] == [1, 3, 4]
    assert [r.read_idx for r in query.query_alignments(rows, None, 1, "complete_reads").orderBy("read_idx").collect()] == [1, 1, 3, 3, 3, 3, 3, 4]
    # region and quality have to hold on one alignment
    assert query.query_alignments(rows, [Region(0, 0, 10)], 1, "complete_reads").count() == 0


def test_subset_conditions(contacts, spark):
    n = lambda **k: subset.subset_pairs(contacts, **k).count()
    assert n() == 6 and n(chroms=[]) == 0 and n(read_ids=[]) == 0 and n(regions=[]) == 0
    assert n(chroms=[0], regions=[Region(1, 0, 30)]) == 0
    assert n(chroms=[1], mode="both") == 1 and n(read_ids=["b", "zz"]) == 2 and n(read_ids=["b"], min_mapq=30) == 0
    assert n(read_ids=[f"x{i}" for i in range(500)] + ["d"]) == 1
    with pytest.raises(InvalidInput):
        n(read_ids=[1])


def random_alignments(rng, reads, contigs, longest):
    """Rows of reads with one to six alignments, some at the same place in the read."""
    rows = []
    for read in range(1, reads + 1):
        for _ in range(rng.randint(1, 6)):
            contig, at, size = rng.randrange(contigs), rng.randrange(longest), rng.randint(1, 90)
            begin = 50 * rng.randrange(4)
            rows.append((read, 1000, begin, begin + 40, rng.choice("+-"), contig, at, at + size, rng.choice([0, 5, 20, 44]), 0.75, "pass", len(rows)))
    return rows


def test_expansion_equals_a_double_loop(spark):
    alignments = random_alignments(random.Random(77), 40, 3, BIG)
    rows = concat_of(spark, alignments)

    def plain(min_mapq=0, min_order=2, max_order=None):
        out = []
        for read in sorted({r[0] for r in alignments}):
            own = sorted((r for r in alignments if r[0] == read and r[8] >= min_mapq), key=lambda r: (r[2], r[11]))
            if len(own) >= max(min_order, 2) and (max_order is None or len(own) < max_order):
                middle = [(r[6] + r[7]) // 2 + 1 if (r[7] - r[6]) % 2 == 0 else r[6] + (r[7] - r[6]) // 2 + 1 for r in own]
                out += [(f"{read}:{i}:{j}", own[i][5], middle[i], own[j][5], middle[j], own[i][4], own[j][4], min(own[i][8], own[j][8])) for i in range(len(own)) for j in range(i + 1, len(own))]
        return sorted(out)

    columns = ("read_id", "chrom1_id", "pos1", "chrom2_id", "pos2", "strand1", "strand2", "mapq")
    for options in ({}, {"min_mapq": 20}, {"min_order": 3, "max_order": 5}, {"min_mapq": 5, "max_order": 3}, {"min_mapq": 45}):
        assert got(expand.expand(rows.repartition(4), **options), *columns) == plain(**options)


def test_matrices_equal_a_plain_count(spark):
    rng, sizes, width = random.Random(31), [("x", 47), ("nil", 8), ("y", 130), ("z", 9)], 8
    contigs = contigs_of(spark, *sizes)
    ends = lambda: (lambda c: (c, rng.randint(1, sizes[c][1])))(rng.choice([0, 2, 3]))
    rows = [(f"m{k}", *ends(), *ends(), "-", "+", rng.randrange(40)) for k in range(300)]
    bins = [(c, a) for c, (_, n) in enumerate(sizes) for a in range(0, n, width)]
    number = {b: k for k, b in enumerate(bins)}
    for q in (0, 15):
        want: dict = {}
        for _, c, p, d, r, _, _, m in rows:
            if m >= q:
                key = tuple(sorted((number[c, (p - 1) // width * width], number[d, (r - 1) // width * width])))
                want[key] = want.get(key, 0) + 1
        pixels = binning.pixels(pairs_of(spark, rows), contigs, width, q)
        assert got(pixels, "bin1", "bin2", "count") == sorted((*k, n) for k, n in want.items())
        before = [sum(k[0] < b for k in want) for b in range(len(bins) + 1)]
        assert got(binning.bin1_offset(pixels, contigs, width), "bin1", "offset") == list(enumerate(before))
        s = binning.cool_summary(pairs_of(spark, rows), contigs, width, q).first().asDict()
        low = sum(r[7] < q for r in rows)
        assert s == {"nnz": len(want), "sum": 300 - low, "input_records": 300, "skipped_mapq": low, "skipped_unmapped": 0, "nbins": len(bins), "nchroms": 4}
    assert got(binning.chrom_offset(contigs, width), "contig_id", "offset") == [(c, number[c, 0]) for c in range(4)]
    outside = pairs_of(spark, [("m", 1, 9, 0, 1, "+", "+", 9)])
    with pytest.raises(Exception, match="outside its contig"):
        binning.pixels(outside, contigs, width).collect()
    assert binning.pixels(outside, contigs, width, 10).count() == 0


def test_pair_statistics_equal_a_plain_count(spark):
    rng = random.Random(64)
    contigs = contigs_of(spark, ("long", 9_000_000), ("short", 5_000), ("none", 10))
    top = (9_000_000, 5_000)
    rows = []
    for k in range(400):
        a = rng.randrange(2)
        b = a if rng.random() < 0.7 else 1 - a
        p = rng.randint(1, top[a])
        r = min(top[a], p + rng.choice([0, 999, 1000, 20_000, 99_999, 100_000, 999_999, 1_000_000])) if a == b else rng.randint(1, top[b])
        rows.append((f"s{k}", a, p, b, r, rng.choice("+-"), rng.choice("+-"), rng.choice([0, 12, 29, 30, 41])))
    frame = pairs_of(spark, rows)
    for q in (0, 12, 42):
        own = [r for r in rows if r[7] >= q]
        cis = [abs(r[4] - r[2]) for r in own if r[1] == r[3]]
        part = lambda n, own=own: n / len(own) if own else None
        bounds = [0, 1_000, 10_000, 100_000, 1_000_000, 1 << 60]
        classes = [sum(low <= d < high for d in cis) for low, high in zip(bounds, bounds[1:], strict=False)]
        s = stats.pairs_summary(frame, q).first()
        assert (s.scanned_records, s.selected_records, s.filtered_records, s.cis_records, s.trans_records) == (400, len(own), 400 - len(own), len(cis), len(own) - len(cis))
        assert (s.cis_fraction, s.mapq_zero_fraction, s.mapq_ge30_fraction) == (part(len(cis)), part(sum(r[7] == 0 for r in own)), part(sum(r[7] >= 30 for r in own)))
        found = {r.bucket: r.n for r in stats.distances(frame, q).collect()}
        assert [found[name] for _, name in stats.DISTANCES] == classes
        ends = [sum(r[1] == c for r in own) + sum(r[3] == c for r in own) for c in range(3)]
        assert got(stats.per_contig(frame, contigs, q), "contig", "n") == sorted(zip(("long", "short", "none"), ends, strict=True))
        report = stats.report(frame, contigs, "x", q)
        assert {k: report[k] for k in s.asDict()} == s.asDict() and sum(report["mapq_histogram"]) == len(own)
        assert [r["count"] for r in report["per_contig"]] == ends and list(report["cis_distance_bp"].values()) == classes
        assert sum(report["strand_pairs"].values()) == len(own) and report["strand_pairs"].get("+-", 0) == sum(r[5:7] == ("+", "-") for r in own)


def test_concat_statistics(spark):
    rows = concat_of(spark, [(7, 100, 0, 10, "+", 0, 0, 10, 30, 0.5, "pass", 0), (7, 100, 10, 20, "+", 1, 0, 10, 30, 1.0, "", 1), (7, 100, 20, 30, "+", 0, 0, 10, 0, 1.0, "", 2), (9, 200, 0, 10, "+", 0, 0, 10, 0, float("nan"), "low_mq", 3)])
    s = stats.concat_summary(rows).first()
    assert (s.mean_read_length, s.multi_contig_reads, s.aligned_reference_bases, s.scanned_reads, s.nonfinite_identity_records) == (150, 1, 40, 2, 1)
    s = stats.concat_summary(rows, 30).first()
    assert (s.selected_reads, s.aligned_reference_bases, s.scanned_reads) == (1, 20, 2)
    assert got(stats.read_orders(rows, 30), "order", "n") == [(2, 1)]


def test_logical_ids(spark):
    raw = [[7, 7, 8], [8, 8, 9], [9, 7]]
    rows = spark.createDataFrame([(s, r, i) for s, own in enumerate(raw) for r, i in enumerate(own)], "_shard int, _row bigint, read_idx bigint")
    found = logical_ids(rows.repartition(5)).orderBy("_shard", "_row").collect()
    assert [r.logical_id for r in found] == [1, 1, 2, 3, 3, 4, 5, 6]


def test_imports_equal_a_double_loop(spark):
    rng = random.Random(90)
    ddl = "rg string, name string, mate int, flag int, read_start bigint, strand string, chrom_id int, start_pos bigint, end_pos bigint, mapping_quality smallint, ordinal bigint"
    rows = []
    for k in range(160):
        at = rng.randrange(500)
        rows.append((rng.choice(["", "lane"]), f"n{rng.randrange(30)}", rng.choice([1, 2]), rng.choice([0, 0, 0, 256, 512, 4]), 10 * rng.randrange(3), rng.choice("+-"), rng.randrange(3), at, at + rng.randint(1, 60), rng.choice([3, 17, 50]), k))
    records = spark.createDataFrame(rows, ddl).repartition(3)
    for q, five in ((0, False), (10, True)):
        groups: dict = {}
        for r in rows:
            if r[3] == 0 and r[9] >= q:
                groups.setdefault((r[0], r[1]), []).append(r)
        want = []
        for (_, name), own in groups.items():
            own = sorted(own, key=lambda r: (r[2], r[4], r[10]))
            ends = [(r[6], r[8] if five and r[5] == "-" else r[7] + 1, r[5], r[9]) for r in own]
            for i, a in enumerate(ends):
                for j, b in enumerate(ends[i + 1 :], i + 1):
                    x, y = (b, a) if a[:2] > b[:2] else (a, b)
                    want.append((f"{name}:{i}:{j}", x[0], x[1], y[0], y[1], x[2], y[2], min(a[3], b[3])))
        columns = ("read_id", "chrom1_id", "pos1", "chrom2_id", "pos2", "strand1", "strand2", "mapq")
        assert got(imports.import_pairs(records, q, five_prime=five), *columns) == sorted(want)
        s = imports.import_statistics(records, q, min_order=3, by_mate=False).first()
        assert (s.input_records, s.selected_read_groups, s.skipped_order_groups) == (160, sum(len(g) > 2 for g in groups.values()), sum(len(g) < 3 for g in groups.values()))
        reads = sorted({(r[0], r[1], r[2]) for g in groups.values() for r in g})
        found = imports.import_reads(records, q).orderBy("read_idx").collect()
        assert [(r.read_idx, r.rg, r.name, r.mate) for r in found] == [(k, *x) for k, x in enumerate(reads, 1)]
    mixed = spark.createDataFrame([("", "u", mate, 0, 0, "-", 0, 3, 4, 8, mate) for mate in (0, 2)], ddl)
    assert imports.group_problems(mixed).count() == 1 and imports.group_problems(records).count() == 0


def test_filter_reasons_are_ordered(spark):
    rows = spark.createDataFrame([(4 | 1024, 0), (1024 | 256, 0), (256, 0), (0, 5), (0, 50)], "flag int, mapping_quality int")
    assert {r.reason: r.n for r in imports.filter_reasons(rows, 10).collect()} == {"unmapped": 1, "duplicate_or_qcfail": 1, "secondary": 1, "mapq": 1, "selected": 1}


def test_merge(spark):
    one, two = contigs_of(spark, ("a", 10), ("b", 20)), contigs_of(spark, ("b", 20), ("c", 30))
    assert got(merge.contig_union([one, two]), "new_id", "contig", "length") == [(0, "a", 10), (1, "b", 20), (2, "c", 30)]
    p = pairs_of(spark, [("r", 0, 1, 1, 1, "+", "+", 1), ("r", 0, 1, 1, 1, "+", "+", 1)])
    assert got(merge.merge_pairs([(p, one), (p, two)]), "source", "chrom1_id", "chrom2_id") == [(0, 0, 1)] * 2 + [(1, 1, 2)] * 2
    with pytest.raises(Exception, match="lengths differ"):
        merge.contig_union([one, contigs_of(spark, ("a", 11))]).collect()
    cn = lambda *rows: spark.createDataFrame(list(rows), "contig string, cn bigint")
    assert got(merge.merge_copy_numbers([cn(("a", 2)), cn(("a", 2), ("b", 3))]), "contig", "cn") == [("a", 2), ("b", 3)]
    with pytest.raises(Exception, match="copy numbers differ"):
        merge.merge_copy_numbers([cn(("a", 1)), cn(("a", 2))]).collect()
    assert got(merge.effective_copy_numbers(one, cn(("b", 3))), "contig", "cn") == [("a", 1), ("b", 3)]


def test_zone_map_keeps_every_hit(contacts):
    part = F.col("chrom1_id").cast("string")
    zones = zonemap.zone_map(contacts, part)
    for mode in ("either", "both"):
        r = [Region(0, 0, 11)]
        need = {x.p for x in query.query_pairs(contacts, r, 0, mode).select(part.alias("p")).distinct().collect()}
        assert need <= {x.part for x in zonemap.candidate_parts(zones, r, 0, mode).collect()}


def test_invalid_rows_stop_the_write(spark):
    contigs = contigs_of(spark, ("a", 10))
    good = pairs_of(spark, [("r", 0, 1, 0, 10, "+", "-", 1)])
    assert checked(good, contigs).count() == 1 and checked(good, contigs).collect() == good.collect()
    for bad, code in ((("r", 0, 0, 0, 10, "+", "-", 1), "POSITION"), (("r", 0, 1, 0, 11, "+", "-", 1), "POSITION"), (("r", 0, 1, 0, 1, "x", "-", 1), "ENCODING"), (("r", 5, 1, 0, 1, "+", "-", 1), "POSITION"), (("r", 0, None, 0, 1, "+", "-", 1), "NULL")):
        with pytest.raises(Exception, match=code):
            checked(pairs_of(spark, [bad]), contigs).collect()
