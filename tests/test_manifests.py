"""Reissue marks over refreshes."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from stockflow.sources import manifests as M


def manifest(spark, **files):
    """month=(version, size)"""
    rows = [("d", datetime.date(2000, int(m[1:]), 1), f"{m}_{v}", v, s) for m, (v, s) in files.items()]
    return spark.createDataFrame(rows, M.ENTRY)


def marks(spark, path, **more):
    return {r.month.month for r in M.flags(spark, path, "d", **more).collect() if r.reissued}


def test_a_mark_appears_stays_and_goes(spark, tmp_path):
    path = f"{tmp_path}/state"
    assert M.newest(spark, path) == 0 and M.state(spark, path).count() == 0
    first = manifest(spark, m1=(1, 10), m2=(1, 20), m3=(1, 30))
    assert M.record(first, path) == 1 and marks(spark, path) == set()
    second = manifest(spark, m1=(1, 10), m2=(2, 25), m4=(1, 5))
    assert M.record(second, path) == 2 and marks(spark, path) == {2}
    assert {(r.month.month, r.change) for r in M.changes(spark, path).collect() if r.change} == {(2, "reissued"), (3, "withdrawn"), (4, "new")}
    assert M.record(second.repartition(3), path) == 2 and marks(spark, path) == {2}  # nothing new: the mark stays
    assert M.record(manifest(spark, m1=(1, 11), m2=(2, 25), m4=(1, 5)), path) == 3 and marks(spark, path) == {1}  # a size alone
    assert marks(spark, path, refresh=2) == {2} and marks(spark, path, refresh=1) == set()
    assert M.record(manifest(spark, m1=(1, 11), m2=(2, 25), m3=(1, 30), m4=(1, 5)), path) == 4 and marks(spark, path) == set()


def test_a_repeated_refresh_replaces_what_it_left(spark, tmp_path):
    path = f"{tmp_path}/state"
    M.record(manifest(spark, m1=(1, 10)), path)
    M.record(manifest(spark, m1=(2, 10)), path)
    assert M.record(manifest(spark, m1=(3, 12)), path, refresh=2) == 2 and M.state(spark, path).where("refresh = 2").count() == 1
    for wrong in (1, 4):
        with pytest.raises(ValueError, match="does not follow"):
            M.record(manifest(spark, m1=(3, 12)), path, refresh=wrong)
    with pytest.raises(ValueError, match="two files"):
        M.record(manifest(spark, m1=(1, 1)).unionByName(manifest(spark, m1=(2, 1))), path)


def test_published_flags_and_tags_are_compared(spark, tmp_path):
    path = f"{tmp_path}/state"
    M.record(manifest(spark, m1=(1, 10), m2=(1, 20), m3=(1, 1)), path)
    M.record(manifest(spark, m1=(1, 10), m2=(2, 25), m3=(1, 1)), path)
    right = M.flags(spark, path, "d")
    assert M.wrong_flags(right, M.flags(spark, path, "d")).count() == 0
    wrong = right.where("month <> '2000-03-01'").withColumn("reissued", F.lit(True)).withColumn("tag", F.when(F.month("month") == 2, "2000-02 v9").otherwise(F.col("tag"))).unionByName(spark.createDataFrame([(datetime.date(2001, 1, 1), False, "x")], "month date, reissued boolean, tag string"))
    assert {(str(r.month), r.problem) for r in M.wrong_flags(wrong, right).collect()} == {("2000-01-01", "flag"), ("2000-02-01", "tag"), ("2000-03-01", "not published"), ("2001-01-01", "not in the state")}
