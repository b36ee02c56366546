"""The issue table: ranges, codes, overlaps, nulls, refusals, and problems of the table itself."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from stockflow.operators import issues as I

D = datetime.date
ROWS = [
    ("wide", "d", "x", D(2000, 1, 15), D(2000, 3, 1), 5.0, None, None, "unknown"),
    ("narrow", "d", "x", D(2000, 2, 1), D(2000, 2, 1), 7.0, 9.0, None, "unknown"),
    ("codes", "d", "y", D(2000, 2, 1), D(2000, 4, 1), None, None, "a|b", "unknown"),
    ("whole", "d", "z", D(2000, 2, 1), D(2000, 2, 1), None, None, None, "unknown"),
    ("lost", "e", "x", D(2000, 1, 1), D(2000, 1, 1), None, None, None, "unusable"),
]


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame(ROWS, I.SCHEMA)


def plain(month, field, value):
    hits = []
    for name, d, f, first, last, low, high, codes, how in ROWS:
        if d == "d" and f == field and how == "unknown" and first.replace(day=1) <= month <= last and value is not None:
            number = float(value) if isinstance(value, int) else None
            if (low is None or number is not None and number >= low) and (high is None or number is not None and number <= high) and (codes is None or str(value) in codes.split("|")):
                hits.append(name)
    return min(hits, default=None)


def test_every_row_once_with_the_first_issue_that_hits(spark, issues):
    rows = [(i, D(2000, 1 + i % 5, 1), x, y, z) for i, (x, y, z) in enumerate((x, y, z) for x in (None, 4, 5, 8, 10) for y in (None, "a", "c") for z in (None, 1) for _ in range(5))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "i int, file_month date, x int, y string, z int, month string").repartition(3)
    for threshold in ("-1", "10485760"):  # without and with a broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = I.named(df, issues, "d", ["x", "y", "z"]).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.x_issue, r.y_issue, r.z_issue) == tuple(plain(r.file_month, c, r[c]) for c in "xyz")
    named = I.named(df, issues, "d", ["x", "y"])
    assert "Cartesian" not in named._jdf.queryExecution().toString() and "NestedLoop" not in named._jdf.queryExecution().toString()
    counts = {(r.field, r.issue): r.n for r in I.applied(named, ["x", "y"], []).collect()}
    assert sum(n for (f, _), n in counts.items() if f == "x") == sum(r[2] is not None for r in rows) and counts[("x", "narrow")] > 0
    usable = I.usable(named, ["x"])
    assert usable.where("x_issue IS NOT NULL AND x IS NOT NULL").count() == 0 and usable.where(F.col("x").isNull()).count() > df.where("x IS NULL").count()


def test_unusable_fields_refuse_the_job(spark, issues):
    df = spark.createDataFrame([(D(2000, 1, 1), 1)], "file_month date, x int")
    with pytest.raises(I.Refused, match="e.x is unusable: lost"):
        I.named(df, issues, "e", ["x"])
    I.require(issues, "e", "y")
    assert I.named(df, issues.where("false"), "e", ["x"]).first().x_issue is None
    assert I.named(df.where("false"), issues, "d", ["x"]).count() == 0


def test_problems_of_the_table(spark, issues):
    assert I.problems(issues).count() == 0
    bad = [(None, "d", "x", D(2000, 1, 1), D(2000, 1, 1), None, None, None, "unknown"), ("back", "d", "x", D(2000, 2, 1), D(2000, 1, 1), None, None, None, "unknown"), ("ends", "d", "x", D(2000, 1, 1), D(2000, 1, 1), 2.0, 1.0, None, "unknown"), ("what", "d", "x", D(2000, 1, 1), D(2000, 1, 1), None, None, None, "ignore"), ("wide", "d", "x", D(2000, 1, 1), D(2000, 1, 1), None, None, None, "unknown")]
    got = {(r.name, r.problem) for r in I.problems(issues.unionByName(spark.createDataFrame(bad, I.SCHEMA))).collect()}
    assert got == {(None, "no name"), ("back", "months"), ("ends", "ends"), ("what", "treatment"), ("wide", "listed twice")}
