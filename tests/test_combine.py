"""Combination planned from stored cubes: what the files carry, sums against the totals, and what is refused."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockflow.demo import Frames
from stockflow.operators import algebra as A
from stockflow.operators import combine as C
from stockflow.queries import cubes as Q

SF = "/root/testdata/sf0.001"
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
CUBES = ["cube_core", "cube_core_by_group", "cube_era", "cube_outflow_breakdown", "cube_outflow_breakdown_by_group", "cube_inflow_breakdown", "cube_inflow_breakdown_by_group", "cube_overlapping_groups"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    top, f = tmp_path_factory.mktemp("cubes"), Frames(spark, SF)
    found = {}
    for name in CUBES:
        getattr(Q, name)(f).write.parquet(f"{top}/{name}")
        found[name] = spark.read.parquet(f"{top}/{name}")
    return found


@pytest.mark.parametrize("name", CUBES)
def test_all_entities_combined_are_the_total(stored, name):
    cube = stored[name]
    kinds = C.dictionary_of(cube.schema)
    assert set(kinds) == set(cube.columns)
    all_ = C.combine(cube, REGIONS, whole=True)
    assert set(C.dictionary_of(all_.schema)) == set(all_.columns) - {"entities"}
    keys = [c for c, x in kinds.items() if x["kind"] == "key"]
    alike = [c for c, x in kinds.items() if x["kind"] in ("stock", "flow", "first", "last", "most", "same", "coverage", "known") and not c.startswith("rate_")]
    total = {tuple(r[k] for k in keys): r for r in cube.where("entity = 'ALL'").collect()}
    rows = all_.where("NOT partial").collect()  # an entity that ends sooner has no rows for later flows, which the total has
    assert len(rows) > 20 and len(rows) == len({tuple(r[k] for k in keys) for r in rows})
    for r in rows:
        t = total[tuple(r[k] for k in keys)]
        assert {c: r[c] for c in alike} == {c: t[c] for c in alike}
        for c, x in kinds.items():
            if x["kind"] == "ratio" and r[c] is not None:
                assert abs(r[c] - round(r[x["num"]] / r[x["den"]], 4)) < 2e-4


def test_a_stock_is_not_added_over_time_from_the_file_alone(stored):
    months = stored["cube_core"].where("grain = 'month'")
    assert A.sum_periods(months, "outflow", ["entity"]).count() == 6
    assert A.sum_periods(months, "stock_change", ["entity"]).count() == 6
    for c in ("stock", "rate_a_den", "coverage", "provisional", "files"):
        with pytest.raises(ValueError, match="over time"):
            A.sum_periods(months, c, ["entity"])


def test_refusals(spark, stored):
    cube = stored["cube_core"]
    for entities, why in ((["ALL", "ASIA"], "total"), (["ASIA", "ASIA"], "twice")):
        with pytest.raises(ValueError, match=why):
            C.combine(cube, entities)
    with pytest.raises(ValueError, match="no kind for more"):
        C.combine(cube.withColumn("more", F.lit(1)), ["ASIA", "AFRICA"])
    with pytest.raises(ValueError, match="outflow, which the cube lacks"):
        C.plan(cube.drop("outflow").schema)
    with pytest.raises(ValueError, match="no entities"):
        C.plan(cube.drop("entity").schema)
    with pytest.raises(ValueError, match="no kind for grain"):
        C.described(cube.select("entity", "grain"), C.kinds("entity", "entity"))


DICTIONARY = C.kinds("entity", "entity") | C.kinds("key", "k") | C.kinds("stock", "stock") | C.kinds("flow", "flow") | C.kinds("flag", "partial") | C.kinds("numerator", "num", of="den") | C.kinds("denominator", "den") | C.kinds("small", "small", of="den") | C.kinds("all", "na") | C.kinds("same", "same") | C.kinds("ratio", "share", num="flow", den="stock", least=30)


def test_each_kind(spark):
    rows = [("A", 1, 5, 2, False, 4, 10.0, True, False, "x", None), ("B", 1, 0, 1, True, None, None, None, True, "x", None), ("C", 1, 25, 1, False, 6, 15.0, True, False, "x", None), ("A", 2, 5, None, False, 4, 10.0, True, True, "x", None), ("B", 2, 5, 1, False, 4, 30.0, True, True, "y", None), ("A", 3, 1, 1, False, 1, 1.0, True, True, "z", None), ("A", 3, 1, 1, False, 1, 1.0, True, True, "z", None)]
    df = spark.createDataFrame(rows, "entity string, k int, stock long, flow long, partial boolean, num long, den double, small boolean, na boolean, same string, share double")
    got = {r.k: r.asDict() for r in C.combine(C.described(df, DICTIONARY), ["A", "B", "C"]).collect()}
    assert got[1] == {"k": 1, "stock": 30, "flow": 4, "partial": True, "num": 10, "den": 25.0, "small": True, "na": False, "same": "x", "share": 0.1333, "entities": 3}
    assert got[2] == {"k": 2, "stock": 10, "flow": None, "partial": False, "num": 8, "den": 40.0, "small": False, "na": True, "same": None, "share": None, "entities": 2}
    assert got[3] == {"k": 3, "stock": None, "flow": None, "partial": False, "num": None, "den": None, "small": None, "na": True, "same": "z", "share": None, "entities": 1}  # twice the same row
    assert [r.k for r in C.combine(C.described(df, DICTIONARY), ["A", "B", "C"], whole=True).collect()] == [1]


def test_coverage_is_made_anew_within_each_dimension(stored):
    cube = stored["cube_outflow_breakdown"]
    two = C.combine(cube, ["ASIA", "EUROPE"]).where("grain = 'fy' AND dimension = 'years'")
    parts = cube.where("entity IN ('ASIA', 'EUROPE') AND grain = 'fy' AND dimension = 'years'").groupBy("period").agg(F.round(F.sum(F.when(~F.col("is_unknown"), F.col("flow"))) / F.sum("flow"), 4).alias("c"))
    assert two.select("period", "coverage").distinct().exceptAll(parts).count() == 0 and two.where("coverage < 1").count() > 0


def test_routes(stored):
    cube = stored["cube_core"]
    none, one, several = (C.route(cube, x) for x in ([], ["ASIA"], ["ASIA", "EUROPE"]))
    assert none.columns == one.columns == several.columns
    assert none.drop("entities").exceptAll(cube.where("entity = 'ALL'").drop("entity")).count() == 0
    assert one.drop("entities").exceptAll(cube.where("entity = 'ASIA'").drop("entity")).count() == 0
    assert {r.entities for r in several.select("entities").distinct().collect()} == {1, 2}  # one of them ends sooner
