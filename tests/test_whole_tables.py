"""The registered queries of orders, unions and sinks have all rows of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_whole_tables(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("part", "orders", "lineitem")}
    q = lambda name: QUERIES[name](spark, SF)
    assert sorted(r.place for r in q("total_order").select("place").collect()) == list(range(1, n["part"] + 1))
    assert q("union_by_name").count() == n["orders"] + n["lineitem"]
    assert q("partitioned_sink").select("entity").distinct().count() == q("monthly_base").select("entity").distinct().count() > 1


def test_places_over_several_ranges(spark):
    from stockflow.operators.order import placed

    rows = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"))
    got = placed(rows.repartition(7), ["v"])
    assert [r.v for r in got.orderBy("place").collect()] == sorted(i * 7919 % 100_003 for i in range(100_000))
    assert got.agg(F.min("place"), F.max("place")).first() == (1, 100_000)
