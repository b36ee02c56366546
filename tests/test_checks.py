"""Each check finds a planted violation, and nothing where there is none."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockflow.demo import FLOWS, Frames
from stockflow.functions import calendar as C
from stockflow.operators import base as B
from stockflow.operators import checks as K
from stockflow.queries import cubes as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def f(spark):
    return Frames(spark, SF)


@pytest.fixture(scope="module")
def base(f, tmp_path_factory):
    out = f"{tmp_path_factory.mktemp('checks')}/base"
    f.base_all_groups.write.parquet(out)
    return f.spark.read.parquet(out)


@pytest.fixture(scope="module")
def core(f, tmp_path_factory):
    out = f"{tmp_path_factory.mktemp('checks')}/core"
    Q.cube_core(f).write.parquet(out)
    return f.spark.read.parquet(out)


def at_asia():
    return (F.col("entity") == "ASIA") & (F.col("month") == F.lit("1998-03-01").cast("date"))


def planted(df, column, at, value=None):
    return df.withColumn(column, F.when(at, F.col(column) + 1 if value is None else value).otherwise(F.col(column)))


def test_partitions(base):
    parts = {"outflow": ["out_a", "out_n", "out_r"]}
    assert K.partition(base, parts, ["entity", "month"]).count() == 0
    found = K.partition(planted(base, "out_n", at_asia() & (F.col("group_code") == "all")), parts, ["entity", "month"]).collect()
    assert [(r.entity, r.month) for r in found] == [("ASIA", dt.date(1998, 3, 1))]


def test_sums_of_groups(base):
    whole, groups = base.where("group_code = 'all'"), base.where("group_code <> 'all'")
    assert K.sums(whole, groups, ["entity", "month"], ["stock", *FLOWS]).count() == 0
    for wrong in (planted(groups, "inflow", at_asia() & (F.col("group_code") == "other")), groups.where(~(at_asia() & (F.col("inflow") > 0)))):
        found = K.sums(whole, wrong, ["entity", "month"], ["stock", *FLOWS]).collect()
        assert {(r.entity, r.month) for r in found} == {("ASIA", dt.date(1998, 3, 1))} and "inflow" in {r.measure for r in found}


def test_key_sets_and_multisets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert sorted(map(tuple, K.row_sets(a, b, ["k"]).collect())) == [(1, "missing"), (3, "extra")]
    assert sorted(map(tuple, K.multisets(a, b).collect())) == [(1, "missing"), (2, "missing"), (3, "extra"), (3, "extra")]
    assert K.row_sets(a, a, ["k"]).count() == K.multisets(a, a).count() == 0


def test_jumps(spark):
    rows = [(dt.date(2000, m, 1), n) for m, n in ((1, 1000), (2, 1019), (3, 1060), (4, 900))]
    df = spark.createDataFrame(rows, "month date, stock long")
    assert [r.month.month for r in K.jumps(df, "stock", 0.02, ["2000-04-01"]).collect()] == [3]


@pytest.mark.parametrize("column,value,problem", [("months", 13, "too many months"), ("partial", True, "partial flag"), ("grain", "quarter", "key of another grain"), ("files", "1997-10 v1", "files"), ("first_month", dt.date(1997, 9, 1), "gap"), ("net_flow", 10**6, "net flow")])
def test_period_rows(core, column, value, problem):
    assert K.period_rows(core, C.grain_of(F.col("period"))).count() == 0
    at = (F.col("entity") == "ASIA") & (F.col("period") == "FY1998")
    found = K.period_rows(planted(core, column, at, F.lit(value)), C.grain_of(F.col("period"))).collect()
    assert [(r.entity, r.period, r.problem) for r in found] == [("ASIA", "FY1998", problem)]


def test_eras(f, base, tmp_path):
    Q.cube_era(f).write.parquet(f"{tmp_path}/era")
    era, alive = f.spark.read.parquet(f"{tmp_path}/era"), B.alive(base)
    assert K.eras(era, alive, Q._ERA_FLOWS).count() == 0
    at = (F.col("entity") == "ASIA") & (F.col("group_code") == "all") & (F.col("era") == "e1") & (F.col("n") == 7)
    assert {r.problem for r in K.eras(planted(era, "stock_n", at), alive, Q._ERA_FLOWS).collect()} == {"stock"}
    found = K.eras(planted(era, "run_out_a", at), alive, Q._ERA_FLOWS).collect()
    assert {(r.n, r.problem) for r in found} == {(7, "flow"), (8, "flow"), (7, "groups: run_out_a")}
    assert {r.problem for r in K.eras(era.where(~at), alive, Q._ERA_FLOWS).collect()} >= {"months in era"}


def test_small_bases(core):
    keys = ["entity", "period"]
    assert K.small_bases(core, "rate_c_den", "rate_c_small", keys).count() == 0
    at = (F.col("entity") == "ASIA") & (F.col("period") == "FY1998")
    assert [tuple(r) for r in K.small_bases(planted(core, "rate_c_small", at, ~F.col("rate_c_small")), "rate_c_den", "rate_c_small", keys).collect()] == [("ASIA", "FY1998")]


def test_unknown_and_missing_values_are_no_sum(spark):
    from stockflow.operators import algebra as A

    df = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("A", "Unknown", 3), ("B", "x", 1), ("B", "x", 1), ("B", "y", None)], "entity string, value string, n long")
    got = lambda values: {r.entity: (r.total, r.refused) for r in A.sum_values(df, "n", values, ["entity"]).collect()}
    assert got(["x", "y"]) == {"A": (3, None), "B": (None, "repeated")}
    assert got(["x", "Unknown"])["A"] == (None, "unknown value") and got(["x", "z"])["A"] == (None, "missing")


def test_gaps(spark):
    months = [dt.date(2000, m, 1) for m in (1, 2, 4, 5, 9)]
    df = spark.createDataFrame([(m,) for m in months], "month date")
    assert [r.month.month for r in K.gaps(df).collect()] == [4, 9] and K.gaps(df.where("month < '2000-03-01'")).count() == 0


def test_issue_balance(base):
    parts = {"outflow": ["years_known", "years_issue"]}
    assert K.partition(base, parts, ["entity", "month"]).count() == 0
    found = K.partition(planted(base, "years_issue", at_asia() & (F.col("group_code") == "all")), parts, ["entity", "month"]).collect()
    assert [(r.entity, r.month) for r in found] == [("ASIA", dt.date(1998, 3, 1))]


def test_share_sums(f, tmp_path):
    Q.cube_inflow_breakdown(f).write.parquet(f"{tmp_path}/in")
    cube, keys = f.spark.read.parquet(f"{tmp_path}/in"), ["entity", "grain", "period", "dimension"]
    assert K.share_sums(cube, keys).count() == 0
    at = (F.col("entity") == "ASIA") & (F.col("grain") == "fy") & (F.col("period") == "FY1996") & (F.col("dimension") == "status")
    for wrong in (planted(cube, "flow", at & (F.col("value") == "done")), cube.where(~(at & (F.col("value") == "open"))), planted(cube, "share_den", at & (F.col("value") == "done"))):
        assert [tuple(r) for r in K.share_sums(wrong, keys).collect()] == [("ASIA", "fy", "FY1996", "status")]


def test_breakdown_recomputation_joins_entities_with_counts_only(spark):
    from stockflow.queries import QUERIES

    def rows(node):
        """Whether lines come up to a node uncounted."""
        below = [node.children().apply(i) for i in range(node.children().size())]
        return node.nodeName() != "Aggregate" and (any(map(rows, below)) if below else "l_orderkey" in node.toString())

    def by_entity(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        own = [any(map(rows, below))] if node.nodeName() == "Join" and "entity#" in node.toString().split("\n")[0] else []
        return own + [x for n in below for x in by_entity(n)]

    found = by_entity(QUERIES["breakdown_recomputation"](spark, SF)._jdf.queryExecution().optimizedPlan())
    assert len(found) >= 2 and not any(found)  # a few entities deal out whatever is joined by them


def test_plain_cells_count_rows_by_each_dimension(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 1, "x", "q"), ("a", 2, "y", "q")], "entity string, m int, c string, d string")
    got = {tuple(r) for r in K.plain_cells(df, "m", {"c": F.col("c"), "d": F.coalesce("d", F.lit("none"))}).collect()}
    assert got == {("a", 1, "c", "x", 2), ("a", 2, "c", "y", 1), ("a", 1, "d", "none", 1), ("a", 1, "d", "q", 1), ("a", 2, "d", "q", 1)}
