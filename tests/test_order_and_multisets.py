"""Stored order over several files, and multisets by month."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.operators import checks as K
from stockflow.operators import order as O


def rows(spark, n):
    return spark.range(n).select((F.xxhash64("id") % 1000).alias("a"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % 13)).alias("b"), "id")


def test_read_order_is_that_of_the_sort_over_several_files(spark, tmp_path):
    df, by, path = rows(spark, 30_000), ["a", "b", "id"], f"{tmp_path}/out"
    O.write_ordered(df, by, path, rows_per_group=1000, rows_per_file=4000)
    files = sorted(glob.glob(f"{path}/*.parquet"))
    groups = [pq.ParquetFile(x).metadata for x in files]
    assert len(files) >= 8 and all(m.row_group(i).num_rows <= 1000 for m in groups for i in range(m.num_row_groups)) and all(m.num_rows <= 4000 for m in groups)
    want = [tuple(r) for r in df.sort(*by).collect()]
    got = [tuple(r)[:3] for r in sorted(O.read_ordered(spark, path).collect(), key=lambda r: r.place)]
    assert got == want and O.order_violations(spark, path, by).count() == 0


def test_planted_disorder_is_found(spark, tmp_path):
    inside, across = f"{tmp_path}/inside", f"{tmp_path}/across"
    spark.range(100).coalesce(1).select(F.when(F.col("id") == 40, 99).otherwise(F.col("id")).alias("a")).write.parquet(inside)
    assert [(r.file, r.row) for r in O.order_violations(spark, inside, ["a"]).collect()] == [("0-0", 41)]
    spark.range(0, 100, 1, 4).select((-F.col("id").cast("int") / 25).cast("int").alias("a")).write.parquet(across)  # each file alone is in order
    found = O.order_violations(spark, across, ["a"]).collect()
    assert {r.row for r in found} >= {0} and len(found) >= 3


def test_row_groups_of_100000_by_default(spark, tmp_path):
    O.write_ordered(rows(spark, 250_000).coalesce(1), ["a", "id"], f"{tmp_path}/out")
    sizes = [m.row_group(i).num_rows for x in glob.glob(f"{tmp_path}/out/*.parquet") for m in [pq.ParquetFile(x).metadata] for i in range(m.num_row_groups)]
    assert max(sizes) <= 100_000 and sum(sizes) == 250_000


COLUMNS = ["k", "v", "w"]


@pytest.fixture(scope="module")
def source(spark):
    return spark.range(600).select(F.expr("add_months(date'2000-01-01', cast(id % 6 as int))").alias("month"), F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id") % 4)).alias("v"), F.when(F.col("id") % 9 == 0, "REDACTED").alias("w"))


def test_planted_changed_doubled_and_lost_rows(spark, source):
    other = source.withColumn("v", F.when(F.col("k") == 7, "other").otherwise(F.col("v"))).where("k <> 100").unionByName(source.where("k = 201"))
    got = sorted((r.k, r.v, r.problem) for r in K.multisets_by_month(source, other, "month", COLUMNS).collect())
    assert got == sorted([(7, "t3", "missing"), (7, "other", "extra"), (100, None, "missing"), (201, "t1", "extra")])
    months = {(r.month.month, r.column) for r in K.differing_months(source, other, "month", COLUMNS).collect()}
    assert months == {(2, "*"), (2, "v"), *((m, c) for m in (4, 5) for c in ("*", *COLUMNS))}
    by = {(r.month.month, r.column): r for r in K.differing_months(source, other, "month", COLUMNS).collect()}
    assert (by[5, "v"].n, by[5, "v"].n_other, by[5, "v"].missing - by[5, "v"].missing_other) == (100, 99, 1)


def test_more_rows_make_more_tasks_of_the_comparison(spark, source, monkeypatch):
    monkeypatch.setattr(K, "ROWS_PER_TASK", 20, raising=False)
    other = source.where("k <> 100").unionByName(source.where("k = 201"))
    df = K.multisets_by_month(source, other, "month", COLUMNS)
    assert sorted((r.k, r.problem) for r in df.collect()) == [(100, "missing"), (201, "extra")]
    assert df.rdd.getNumPartitions() == 20  # for the 400 rows of the two months that differ


def test_swapped_values_and_nulls_are_seen(spark, source):
    swapped = source.select("month", "k", F.col("w").alias("v"), F.col("v").alias("w"))
    assert K.multisets_by_month(source, swapped, "month", COLUMNS).count() > 0
    hidden = source.withColumn("w", F.when(F.col("k") != 9, F.col("w")))
    r = K.differing_months(source, hidden, "month", COLUMNS).where("column = 'w'").collect()
    assert [(x.redacted - x.redacted_other, x.missing_other - x.missing) for x in r] == [(1, 1)]
    lost_month = source.where("month < '2000-06-01'")
    assert K.multisets_by_month(source, lost_month, "month", COLUMNS).count() == 100


def test_equal_frames_are_not_compared_row_by_row(spark, source, monkeypatch):
    def never(self, other):
        raise AssertionError("exceptAll")

    monkeypatch.setattr(DataFrame, "exceptAll", never)
    monkeypatch.setattr(type(source), "exceptAll", never)
    assert K.multisets_by_month(source, source.repartition(5, "v").sort("w"), "month", COLUMNS).count() == 0
    with pytest.raises(AssertionError):
        K.multisets_by_month(source, source.where("k <> 3"), "month", COLUMNS)
