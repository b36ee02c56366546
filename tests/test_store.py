"""The stored table with a kept ledger: replayed batches, lost checkpoints, superseded and removed files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from stockflow.sources import store as T
from stockflow.streaming.loader import load_into

SCHEMA = "k long, v string"


def deliver(spark, src, name, n, first=0):
    spark.range(first, first + n).select(F.col("id").alias("k"), F.lit(name).alias("v")).coalesce(1).write.mode("overwrite").parquet(f"{src}/{name}")


def run(spark, top, mark="mark", **more):
    # a folder a file: its name is the file's
    return load_into(spark, f"{top}/src/*", SCHEMA, f"{top}/store", f"{top}/{mark}", lambda: F.regexp_extract("_metadata.file_path", "src/([^/]*)/", 1), **more)


def stored(spark, top):
    return sorted((r.source_file, r["count"]) for r in T.rows(spark, f"{top}/store").groupBy("source_file").count().collect())


def files(top):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(f"{top}/store/rows") for x in names if x.endswith(".parquet")}


def test_three_runs_with_a_replayed_batch_and_a_lost_checkpoint(spark, tmp_path):
    deliver(spark, f"{tmp_path}/src", "a", 5)
    assert run(spark, tmp_path) == ["loaded"] and stored(spark, tmp_path) == [("a", 5)]
    deliver(spark, f"{tmp_path}/src", "b", 7)

    def fail():
        raise RuntimeError("lost between rows and ledger")

    with pytest.raises(Exception, match="lost between rows and ledger"):
        run(spark, tmp_path, between=fail)
    assert stored(spark, tmp_path) == [("a", 5)]  # rows are there, the ledger does not name them
    assert len({os.path.dirname(x) for x in files(tmp_path)}) == 2
    assert run(spark, tmp_path) == ["loaded"] and stored(spark, tmp_path) == [("a", 5), ("b", 7)]
    assert len({os.path.dirname(x) for x in files(tmp_path)}) == 2  # replaced, not added
    before = files(tmp_path)
    assert run(spark, tmp_path) == [] and files(tmp_path) == before
    entries = T.ledger(spark, f"{tmp_path}/store").collect()
    assert sorted((r.source_file, r.rows, r.action, r.load[-12:]) for r in entries) == [("a", 5, "loaded", "0" * 12), ("b", 7, "loaded", "0" * 11 + "1")]
    # a new checkpoint lists all files again: old ones add nothing, a new one is loaded
    deliver(spark, f"{tmp_path}/src", "c", 2)
    assert run(spark, tmp_path, "other-mark") == ["loaded"] and stored(spark, tmp_path) == [("a", 5), ("b", 7), ("c", 2)]
    assert {x: t for x, t in files(tmp_path).items() if x in before} == before


def frames(spark, **sizes):
    """Rows of files, and their list: a file's size says which delivery it is of."""
    df = spark.createDataFrame([(i, name) for name, (n, _) in sizes.items() for i in range(n)], "k long, source_file string")
    listed = spark.createDataFrame([(name, size) for name, (_, size) in sizes.items()], "source_file string, size long").withColumn("modified", F.lit("2001-01-01").cast("timestamp"))
    return df, listed


def test_supersede_touches_only_its_files(spark, tmp_path):
    store = f"{tmp_path}/store"
    df, listed = frames(spark, a=(3, 1), b=(4, 1), c=(5, 1), empty=(0, 1))
    assert T.add(df, listed, store, "one") == "loaded" and T.add(df, listed, store, "one") == "already loaded" and T.add(df, listed, store, "two") == "nothing new"
    assert {r.source_file: r.rows for r in T.current(spark, store).collect()} == {"a": 3, "b": 4, "c": 5, "empty": 0}
    before = files(tmp_path)
    again, manifest = frames(spark, a=(3, 1), b=(9, 2))
    wanted = T.supersede(spark, manifest, store, "three")
    assert [r.source_file for r in wanted.collect()] == ["b"] and stored(spark, tmp_path) == [("a", 3), ("b", 4)]  # the old b until the new one is whole
    with pytest.raises(RuntimeError):
        T.add(again, wanted, store, "four", lambda: (_ for _ in ()).throw(RuntimeError()))
    assert stored(spark, tmp_path) == [("a", 3), ("b", 4)]
    assert T.add(again, wanted, store, "four") == "loaded" and stored(spark, tmp_path) == [("a", 3), ("b", 9)]
    kept = {x: t for x, t in before.items() if "source_file=a" in x}
    assert {x: t for x, t in files(tmp_path).items() if x in before} == before
    assert T.sweep(spark, store) == 2 and T.sweep(spark, store) == 0
    left = files(tmp_path)
    assert {x: t for x, t in left.items() if x in before} == kept and not any("source_file=c" in x for x in left) and stored(spark, tmp_path) == [("a", 3), ("b", 9)]
    # a file that comes back is loaded again
    back, manifest = frames(spark, a=(3, 1), b=(9, 2), c=(5, 1))
    assert T.add(back, T.supersede(spark, manifest, store, "five"), store, "six") == "loaded" and stored(spark, tmp_path) == [("a", 3), ("b", 9), ("c", 5)]


def test_odd_names_and_no_files(spark, tmp_path):
    store = f"{tmp_path}/store"
    df, listed = frames(spark, **{"2001-02": (2, 1), "007": (1, 1), "x=y / é %": (3, 1)})
    assert T.ledger(spark, store).count() == 0 and T.add(df.where("false"), listed.where("false"), store, "none") == "nothing new"
    assert T.add(df, listed, store, "01") == "loaded" and stored(spark, tmp_path) == [("007", 1), ("2001-02", 2), ("x=y / é %", 3)]
    gone, manifest = frames(spark, **{"007": (1, 1)})
    T.supersede(spark, manifest, store, "02")
    assert T.sweep(spark, store) == 2 and stored(spark, tmp_path) == [("007", 1)]
