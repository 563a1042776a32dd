"""PAF and ``.pairs`` text to records, parsed in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.sources.files import contig_sizes, lines

#: The twelve fixed fields of PAF.
FIELDS = ("name", "read_length", "read_start", "read_end", "strand", "contig", "length", "start_pos", "end_pos", "matches", "block", "mapping_quality")
WHOLE = [f for f in FIELDS if f not in ("name", "strand", "contig")]


def _or_error(good: Column, value: Column, kind: str, what: str) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{what} in line "), F.col("value"))).cast(kind))


def read_paf(spark: SparkSession, path: str, sizes: str | None = None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Records for imports (rg empty, mate 0, flag 256 for secondary ones) and the contigs: those of the sizes file,
    then those of the records, filtered or not, in order of appearance."""
    rows = lines(spark, path).where("trim(value) <> '' and value not like '#%'").withColumn("_f", F.split("value", "\t"))
    rows = rows.withColumn("_f", _or_error(F.size("_f") >= 12, F.col("_f"), "array<string>", "fewer than 12 fields"))
    rows = rows.select("ordinal", "value", *[F.get("_f", i).alias(c) for i, c in enumerate(FIELDS)], F.slice("_f", 13, 1000).alias("_tags"))
    for c in WHOLE:
        rows = rows.withColumn(c, _or_error(F.col(c).rlike(r"^\d{1,18}$"), F.expr(f"try_cast({c} as bigint)"), "bigint", f"bad {c}"))
    good = (F.col("read_start") < F.col("read_end")) & (F.col("read_end") <= F.col("read_length")) & (F.col("start_pos") < F.col("end_pos")) & (F.col("end_pos") <= F.col("length")) & (F.col("block") > 0) & (F.col("matches") <= F.col("block")) & (F.col("mapping_quality") <= 255)
    rows = rows.withColumn("strand", _or_error(F.col("strand").isin("+", "-") & good, F.col("strand"), "string", "bad interval, strand or quality"))
    tag = F.forall("_tags", lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:.*$"))
    rows = rows.withColumn("name", _or_error(tag & (F.length("name") > 0), F.col("name"), "string", "bad tag or name"))
    secondary = F.exists("_tags", lambda t: t == "tp:A:S")
    contigs = contig_sizes(spark, sizes) if sizes else []
    known = dict(contigs)
    # one row for each contig reaches the driver: the dictionary, which is broadcast everywhere
    for r in rows.groupBy("contig").agg(F.min("ordinal").alias("at"), F.min("length").alias("low"), F.max("length").alias("high")).orderBy("at").collect():
        if r["low"] != r["high"] or known.get(r["contig"], r["low"]) != r["low"]:
            raise ValueError(f"lengths differ for contig {r['contig']}")
        if r["contig"] not in known:
            known[r["contig"]] = r["low"]
            contigs.append((r["contig"], r["low"]))
    number = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(contigs)], "contig string, chrom_id int")
    rows = rows.join(F.broadcast(number), "contig")
    identity = (F.col("matches").cast("double") / F.col("block")).cast("float")
    out = rows.select(
        F.lit("").alias("rg"), "name", F.lit(0).alias("mate"), F.when(secondary, 256).otherwise(0).alias("flag"), "read_length", "read_start", "read_end", "strand",
        "chrom_id", "start_pos", "end_pos", F.col("mapping_quality").cast("smallint").alias("mapping_quality"), identity.alias("identity"), F.lit("").alias("filter_reason"), "ordinal",
    )
    return out, contigs


PAIR_FIELDS = ("readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "mapq")


def read_pairs_text(spark: SparkSession, path: str, sizes: str | None = None, min_mapq: int = 0) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Pairs of a ``.pairs`` text with ``skip`` ('unmapped', 'mapq' or null), and the contigs of the sizes file or the header."""
    rows = lines(spark, path)
    header = [r["value"] for r in rows.where("value like '#%'").orderBy("ordinal").select("value").collect()]
    contigs = contig_sizes(spark, sizes) if sizes else [(f[1], int(f[2])) for f in (h.split() for h in header) if f[0] == "#chromsize:"]
    named = next((h.split()[1:] for h in header if h.startswith("#columns:")), None)
    body = rows.where("value not like '#%' and value <> ''").withColumn("_f", F.split("value", r"\s+" if named is None else "\t"))
    at = {c: i for i, c in enumerate(named or PAIR_FIELDS)}
    if not {"chrom1", "pos1", "chrom2", "pos2"} <= set(at):
        raise ValueError("columns chrom1, pos1, chrom2 and pos2 are needed")
    field = lambda c: F.get("_f", at[c])
    dead = field("chrom1").isin("!", "*") | field("chrom2").isin("!", "*")
    number = lambda c: F.expr(f"try_cast(_f[{at[c]}] as bigint)")
    wide = F.get("_f", at.get("mapq", 7))
    if "mapq1" in at and "mapq2" in at:
        q = F.least(number("mapq1"), number("mapq2"))
    elif named is None or "mapq" in at:
        q = wide.try_cast("bigint") if hasattr(wide, "try_cast") else F.expr(f"try_cast(get(_f, {at.get('mapq', 7)}) as bigint)")
    else:
        q = F.lit(None).cast("bigint")
    if min_mapq:
        q = F.when(dead, q).otherwise(F.coalesce(q, F.raise_error(F.lit("a quality bound needs quality columns")).cast("bigint")))
    numbers = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(contigs)], "name string, number int")
    out = body.select(
        (field("readID") if "readID" in at else F.lit(".")).alias("read_id"), field("chrom1").alias("_c1"), number("pos1").alias("pos1"), field("chrom2").alias("_c2"), number("pos2").alias("pos2"),
        (field("strand1") if "strand1" in at else F.lit("+")).alias("strand1"), (field("strand2") if "strand2" in at else F.lit("+")).alias("strand2"),
        F.coalesce(q, F.lit(0)).cast("smallint").alias("mapq"), F.when(dead, "unmapped").when(q < min_mapq, "mapq").alias("skip"),
    )
    for n in (1, 2):
        own = numbers.select(F.col("name").alias(f"_c{n}"), F.col("number").alias(f"chrom{n}_id"))
        out = out.join(F.broadcast(own), f"_c{n}", "left")
        lost = F.col("skip").isNull() & F.col(f"chrom{n}_id").isNull()
        out = out.withColumn(f"chrom{n}_id", F.when(lost, F.raise_error(F.concat(F.lit("unknown contig: "), f"_c{n}")).cast("int")).otherwise(F.col(f"chrom{n}_id")))
    return out.select("read_id", "chrom1_id", "pos1", "chrom2_id", "pos2", "strand1", "strand2", "mapq", "skip"), contigs
