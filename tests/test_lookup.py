"""Look-up pages: clamped, pruned, searched; and windows beside those before them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockflow.operators import lookup as L
from stockflow.plans import full as X


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('lookup')}/t"
    df = spark.range(10_000).select((F.xxhash64("id") % 97).alias("a"), "id", F.concat(F.lit("Name "), F.col("id") % 50).alias("name"), F.when(F.col("id") % 3 > 0, "x").alias("code"))
    L.build(df, ["a", "id"], path, rows_per_file=700)
    return path, [tuple(r) for r in df.sort("a", "id").collect()]


def got(df):
    return [tuple(r)[:4] for r in sorted(df.collect(), key=lambda r: r.place)]


@pytest.mark.parametrize(("asked", "page"), [(1, 1), (0, 1), (-7, 1), (3, 3), (200, 200), (201, 200), (10**12, 200)])
def test_pages_in_order_and_clamped(spark, table, asked, page):
    path, want = table
    df = L.page(spark, path, asked, 50)
    assert got(df) == want[(page - 1) * 50 : page * 50] and {(r.page, r.pages, r.total) for r in df.collect()} == {(page, 200, 10_000)}


def test_a_page_reads_only_its_files(spark, table):
    path, _ = table
    files = spark.read.parquet(f"{path}/rows").inputFiles()
    assert len(files) >= 14 and len(L.page(spark, path, 5, 50).inputFiles()) <= 2
    assert len(L.page(spark, path, 1, 20, L.contains("name 7", "name")).inputFiles()) <= 3


@pytest.mark.parametrize("asked", [1, 2, 9, 99])
def test_searches_give_rows(spark, table, asked):
    path, want = table
    hits = [r for r in want if "name 7" in r[2].lower()]
    page = min(asked, -(-len(hits) // 30))
    df = L.page(spark, path, asked, 30, L.contains(" NAME 7 ", "name", "code"))
    assert got(df) == hits[(page - 1) * 30 : page * 30] and df.first().total == len(hits)


def test_no_hits_nulls_and_empty_terms(spark, table):
    path, want = table
    none = L.page(spark, path, 4, 30, L.contains("nowhere", "name", "code"))
    assert none.count() == 0 and none.columns == L.page(spark, path, 1).columns
    assert got(L.page(spark, path, 2, 10, L.contains("  ", "code"))) == want[10:20]
    assert L.page(spark, path, 1, 10, L.contains("x", "code")).where("code IS NULL").count() == 0
    L.build(spark.createDataFrame([], "a int, b string"), ["a"], f"{path}-empty")
    assert L.page(spark, f"{path}-empty", 3).count() == 0


@pytest.mark.parametrize("down", [True, False])
def test_rows_alike_in_the_order_go_by_their_other_columns(spark, tmp_path, down):
    df = spark.range(90).select((F.col("id") / 30).cast("int").alias("a"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"), F.create_map(F.lit("k"), "id").alias("m"), "id")
    L.build(df.coalesce(1).sortWithinPartitions(F.desc("id") if down else F.asc("id")), ["a"], f"{tmp_path}/t", rows_per_file=20)
    pages = [L.page(spark, f"{tmp_path}/t", n, 25).drop("m") for n in (1, 2, 3, 4)]
    assert [(r.a, r.name, r.id) for p in pages for r in sorted(p.collect(), key=lambda r: r.place)] == [tuple(r) for r in df.drop("m").sort("a", "name", "id").collect()]


def test_display_names(spark):
    df = spark.createDataFrame([("A",), ("Z",), (None,)], "c string")
    assert [r[0] for r in df.select(L.displayed(F.col("c"), {"A": "Accepted"})).collect()] == ["Accepted", "Z", None]


def test_windows_beside_those_before(spark):
    rows = [("fy", "FY2000", 1), ("fy", "FY2001", 2), ("fy", "FY2003", 4), ("t12", "2000-02", 5), ("t12", "2001-02", 6), ("t12", "2001-03", 7), ("era", "e1", 8), ("era", "e2", 9)]
    df = spark.createDataFrame([("k", *r) for r in rows], "key string, grain string, period string, n int")
    out = {(r.grain, r.period): r.n_before for r in X.beside_before(df, ["key"], {"n": F.col("n")}).collect()}
    assert out == {("fy", "FY2000"): None, ("fy", "FY2001"): 1, ("fy", "FY2003"): None, ("t12", "2000-02"): None, ("t12", "2001-02"): 5, ("t12", "2001-03"): None, ("era", "e1"): None, ("era", "e2"): None}
    assert [r[0] for r in df.where("grain <> 'era'").select(X.period_before(F.col("grain"), F.col("period"))).collect()] == ["FY1999", "FY2000", "FY2002", "1999-02", "2000-02", "2000-03"]
