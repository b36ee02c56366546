"""Rules for nulls, refusals and grids on tiny frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockflow.functions import calendar as C
from stockflow.functions import rules as R
from stockflow.operators import algebra as A
from stockflow.operators import base as B
from stockflow.operators import rollup as U
from stockflow.sources import files as S


def month(i):
    return dt.date(2000 + (i - 1) // 12, (i - 1) % 12 + 1, 1)


def test_trailing_needs_all_months(spark):
    base = spark.createDataFrame([("A", month(i), 10, i) for i in range(1, 15)], "entity string, month date, stock long, outflow long")
    t = {r.month: (r.t_flow, r.t_mean) for r in U.trailing(base, "outflow").collect()}
    assert t[month(11)] == (None, None) and t[month(12)] == (78, 10.0) and t[month(14)] == (sum(range(3, 15)), 10.0)


def test_entity_that_ends_and_one_that_goes_on(spark):
    base = spark.createDataFrame([(e, month(i), 5 if i <= last else 0) for e, last in (("A", 14), ("B", 8), ("C", 8)) for i in range(1, 15)], "entity string, month date, stock long")
    n = {r.entity: r["count"] for r in B.within_life(base, ["C"]).groupBy("entity").count().collect()}
    assert n == {"A": 14, "B": 8, "C": 14}


def test_zero_stock_has_no_rate_and_small_base_is_strict(spark):
    df = spark.createDataFrame([(5, 0.0), (5, 29.99), (5, 30.0)], "flow long, mean double").select("mean", *U.guarded(F.col("flow"), F.col("mean")))
    got = {r["mean"]: (r.rate, r.small_base) for r in df.collect()}
    assert got == {0.0: (None, None), 29.99: (0.1667, True), 30.0: (0.1667, False)}


def test_redaction_is_kept_apart(spark):
    df = spark.createDataFrame([("12",), (None,), ("REDACTED",), ("junk",)], "v string").select("v", R.typed(F.col("v"), "int").alias("t"), R.redacted(F.col("v")).alias("r"))
    assert {(x.v, x.t, x.r) for x in df.collect()} == {("12", 12, False), (None, None, False), ("REDACTED", None, True), ("junk", None, False)}


def test_unknown_comes_first_and_unmapped_last(spark):
    rules = [R.Rule("low", "range", 0, 10), R.Rule("Unknown", "unknown", codes=("7",))]
    df = spark.createDataFrame([(0.0,), (7.0,), (10.0,), (None,)], "v double").select("v", R.assigned(rules, F.col("v"), issue=F.col("v") == 0).alias("g"))
    assert {r.v: r.g for r in df.collect()} == {0.0: "Unknown", 7.0: "low", 10.0: "__unmapped__", None: "Unknown"}


def test_guarded_sums_refuse(spark):
    df = spark.createDataFrame([("ALL", "fy", "FY2000", 9), ("A", "fy", "FY2000", 4), ("B", "fy", "FY2000", 5), ("A", "fy", "FY2001", None), ("B", "fy", "FY2001", 5)], "entity string, grain string, period string, n long")
    got = {r.period: (r.value, r.refused) for r in A.sum_entities(df, "n", ["A", "B"]).collect()}
    assert got == {"FY2000": (9, None), "FY2001": (None, None)}
    assert {r.refused for r in A.sum_entities(df.where("period = 'FY2000'"), "n", ["ALL", "A"]).collect()} == {"total and part"}
    assert {r.refused for r in A.sum_entities(df.where("period = 'FY2000'"), "n", ["A", "C"]).collect()} == {"missing"}


def test_only_flows_add_over_time_and_gaps_are_null(spark):
    df = spark.createDataFrame([("A", month(1), 1), ("A", month(2), 2), ("B", month(1), 1), ("B", month(3), 2)], "entity string, last_month date, n long")
    got = {r.entity: r.value for r in A.sum_periods(A.kinds(df, n="flow"), "n", ["entity"]).collect()}
    assert got == {"A": 3, "B": None}
    with pytest.raises(ValueError):
        A.sum_periods(A.kinds(df, n="stock"), "n", ["entity"])


def test_components_add_up_to_the_total(spark):
    df = spark.createDataFrame([("A", month(1), 1), ("B", month(1), 2), ("B", month(2), 3)], "entity string, month date, n long")
    got = {(r.entity, r.month): r.s for r in B.with_total(df, "month", [], [F.sum("n").alias("s")]).collect()}
    assert got == {("A", month(1)): 1, ("B", month(1)): 2, ("B", month(2)): 3, ("ALL", month(1)): 3, ("ALL", month(2)): 3}


def test_period_bounds(spark):
    df = spark.createDataFrame([("2000-02",), ("FY2000Q1",), ("FY2000",)], "k string").select("k", C.bounds_of(F.col("k")).alias("b"))
    got = {r.k: (r.b.first_month, r.b.last_month) for r in df.collect()}
    assert got == {"2000-02": (dt.date(2000, 2, 1),) * 2, "FY2000Q1": (dt.date(1999, 10, 1), dt.date(1999, 12, 1)), "FY2000": (dt.date(1999, 10, 1), dt.date(2000, 9, 1))}


def test_publication(spark, tmp_path):
    df, store = spark.createDataFrame([(1,), (-1,)], "n long"), f"{tmp_path}/store"
    negative = lambda staged: [staged.where("n < 0")]
    assert S.publish(df, negative, store, "t", "1") == "refused: a check finds something" and S.history(spark, store).count() == 0
    assert S.publish(df, lambda x: [x.where("n > 5")], store, "t", "1") == "published" and S.published(spark, store, "t").count() == 2
    assert S.publish(df.repartition(3), lambda x: [], store, "t", "1") == "unchanged" and S.history(spark, store).count() == 1
    assert S.publish(df.where("n > 0"), negative, store, "t", "2", complete=False) == "refused: it is incomplete"
    assert S.publish(df.where("n > 0"), negative, store, "t", "2") == "published" and S.published(spark, store, "t").count() == 1
    assert S.publish(df, lambda x: [], store, "t", "1") == "refused: its source is older" and S.published(spark, store, "t").count() == 1
    assert [(r.source, r.rows) for r in S.history(spark, store).collect()] == [("1", 2), ("2", 1)]
    assert S.publish(df.where("n > 0"), negative, store, "other", "1") == "published"


def test_repeated_months_are_no_consecutive_ones(spark):
    df = spark.createDataFrame([("A", month(1), 1), ("A", month(1), 1), ("A", month(3), 2)], "entity string, last_month date, n long")
    assert A.sum_periods(A.kinds(df, n="flow"), "n", ["entity"]).first().value is None


def test_ends_are_refused(spark):
    rows = [("A", month(1), 5, 0, 0), ("A", month(2), 0, 1, 0), ("B", month(1), 5, 0, 0), ("B", month(2), 0, 0, 0), ("C", month(1), 0, 0, 0), ("D", month(1), 5, 0, 0), ("D", month(2), 0, 1, 0)]
    base = spark.createDataFrame(rows, "entity string, month date, stock long, inflow long, outflow long")
    assert {(r.entity, r.why) for r in B.refused_ends(base, {"D": "2000-01-01"}).collect()} == {("A", "flows after its end"), ("C", "never in stock")}
    assert {(r.entity, r.why) for r in B.refused_ends(base, {"D": "2000-02-01", "A": "2000-01-01"}).collect()} == {("C", "never in stock"), ("D", "goes on after another month")}
    assert {(r.entity, r.month) for r in B.alive(base, ["D"]).collect()} == {("A", month(1)), ("B", month(1)), ("D", month(1)), ("D", month(2))}
