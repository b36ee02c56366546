"""Hierarchies: closure against a walk, planted problems, and proofs of parents by their children."""

from __future__ import annotations

import random

import pytest

from stockflow.operators import hierarchy as H


def frame(spark, links):
    return spark.createDataFrame(links, "node string, parent string")


@pytest.mark.parametrize("seed", range(2))
def test_closure_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(60)] + [(f"c{i}", f"c{i - 1}" if i else "n3") for i in range(40)]
    up = dict(links)
    want = set()
    for node in up:
        at, d = up[node], 1
        while at is not None:
            want.add((node, at, d))
            at, d = up[at], d + 1
    assert {tuple(r) for r in H.closure(frame(spark, links)).collect()} == want
    roots = {n for n, p in links if p is None}
    got = {r.node: r.level for r in H.levels(frame(spark, links)).collect()}
    assert got == {n: max((d for x, a, d in want if x == n and a in roots), default=0) for n in up}


def test_closure_ends_on_cycles(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None), ("s", "s")]
    got = {(r.node, r.ancestor): r.distance for r in H.closure(frame(spark, links)).collect()}
    assert got[("a", "a")] == 3 and got[("d", "c")] == 3 and got[("s", "s")] == 1 and len(got) == 13
    assert {r.node: r.level for r in H.levels(frame(spark, links)).collect()} == {"a": None, "b": None, "c": None, "d": None, "e": 0, "s": None}


def test_each_planted_problem_is_reported(spark):
    links = [("all", None), ("x", "all"), ("x1", "x"), ("x2", "x"), ("y", "all")]
    codes = spark.createDataFrame([("1", "x1"), ("2", "y")], "code string, node string")
    report = lambda more, c=codes: sorted(tuple(r) for r in H.problems(frame(spark, links + more), c).collect())
    assert report([]) == []
    assert report([("p", "q"), ("q", "p")]) == [("p", "cycle"), ("q", "cycle")]
    assert report([("z", "nowhere")]) == [("z", "orphan")]
    assert report([("x1", "y")]) == [("x1", "two parents")] and report([("y", "all")]) == [("y", "listed twice")]
    assert report([], spark.createDataFrame([("3", "gone")], "code string, node string")) == [("gone", "no such node")]


def test_membership_counts_a_code_once_in_each_node(spark):
    links = frame(spark, [("all", None), ("a", "all"), ("b", "all"), ("both", "a"), ("both", "b")])
    codes = spark.createDataFrame([("1", "both"), ("2", "a")], "code string, node string")
    assert sorted(tuple(r) for r in H.membership(codes, links).collect()) == [("1", "a"), ("1", "all"), ("1", "b"), ("1", "both"), ("2", "a"), ("2", "all")]


def test_children_prove_their_parent_level_by_level(spark):
    links = frame(spark, [("all", None), ("x", "all"), ("x1", "x"), ("x2", "x"), ("y", "all")])
    rows = [(m, n, v) for m in (1, 2) for n, v in (("all", 10), ("x", 7), ("x1", 3), ("x2", 4), ("y", 3))]
    check = lambda rows: sorted(tuple(r) for r in H.partition(spark.createDataFrame(rows, "m int, node string, n long"), links, ["m"], ["n"]).collect())
    assert check(rows) == []
    assert check([r for r in rows if r[:2] != (2, "x2")]) == [(2, "x", 1, "n", 7, 3)]  # a missing child
    assert check([(m, n, v + (m == 1 and n == "x")) for m, n, v in rows]) == [(1, "all", 0, "n", 10, 11), (1, "x", 1, "n", 8, 7)]
    assert check([r for r in rows if r[:2] != (1, "all")]) == [(1, "all", 0, "n", 0, 10)]  # a missing parent
