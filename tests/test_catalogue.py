"""Every registered query with SQL, against DuckDB on the smallest tables, and the known totals."""

import os

import duckdb
import pytest

from contactloom.operators import expand, query
from contactloom.plans import catalogue, files, views  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def table(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind in "iu":
            df = df.assign(**{c: df[c].astype("int64")})
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, database, name):
    assert table(catalogue.QUERIES[name](spark, SF).toPandas()) == table(database.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_known_totals(spark):
    sf = "/root/testdata/sf0.01"
    pairs, rows = views.pairs(spark, sf), views.alignments(spark, sf)
    assert [query.quality(pairs, q).count() for q in (0, 1, 30)] == [60_000, 59_014, 30_334]
    assert query.query_pairs(pairs, catalogue.TARGET).count() == 544
    assert query.query_alignments(rows, catalogue.TARGET, 30, "complete_reads").count() == 688
    total = expand.expand(rows, 30, 2, 6).selectExpr("count(*) n", "sum(mapq) q", "sum(pos1) p").first()
    assert tuple(total) == (25_720, 1_022_660, 905_291_433)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["mapq_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey" not in plan
    binned = catalogue.QUERIES["pixels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in binned and "SortMergeJoin" not in binned and "l_extendedprice" not in binned
