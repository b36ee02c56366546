"""Periodic runs against brute force over all periods, and the registered query's digests."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockflow.llm import runs
from stockflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(words, shortest=12):
    """Every maximal stretch of every period, the smallest period of each."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(shortest, 2 * q):
                out.setdefault((s, i + q - s), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def found(docs):
    w = np.concatenate([np.asarray(d, np.int64) for d in docs]) if docs else np.zeros(0, np.int64)
    first = np.cumsum([0, *map(len, docs)])
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    out = [[] for _ in docs]
    for s, e, q in zip(*(x.tolist() for x in runs.runs_of(w, doc)), strict=True):
        out[doc[s]].append((s - int(first[doc[s]]), e - s, q))
    return out


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def structured(rng):
    """Blocks repeated, cut, nested and changed in places: many runs of many periods."""
    x = rng.integers(0, 3, rng.integers(1, 8)).tolist()
    for _ in range(rng.integers(1, 6)):
        kind = rng.integers(0, 4)
        if kind == 0:
            x = x * int(rng.integers(2, 5))
        elif kind == 1:
            x = x + rng.integers(0, 2, rng.integers(1, 9)).tolist() + x
        elif kind == 2:
            x = x[int(rng.integers(0, len(x))) :] + x
        else:
            x[int(rng.integers(0, len(x)))] = int(rng.integers(0, 3))
        x = x[-400:]
    return x


@pytest.mark.parametrize("seed", range(6))
def test_brute_force(seed):
    rng = np.random.default_rng(seed)
    docs = [structured(rng) for _ in range(250)] + [rng.integers(0, 2, rng.integers(0, 120)).tolist() for _ in range(100)]
    got = found(docs)
    assert got == [plain(d) for d in docs] and sum(map(len, got)) > 300


@pytest.mark.parametrize("size", [0, 1, 5, 11, 12, 13, 23, 24, 48, 97, 300])
def test_shapes(size):
    ab = [i % 2 for i in range(size)]
    docs = [[0] * size, ab, ab + [1] + ab, ab + ab[::-1], [0] * size + [1] + [0] * size, fibonacci(size), [0] * size + [1] * size + [0] * size, list(range(size)) * 2, list(range(size)) * 3 + [0], [*[0, 0, 1] * (size // 3), *[0, 1] * (size // 2)] * 2]
    assert found(docs) == [plain(d) for d in docs]


def test_seeds_that_make_no_run():
    rng = np.random.default_rng(9)
    short = [[*range(q), *range(6), q] for q in range(7, 12)] + [[*range(q), *range(k), q] for k, q in ((12, 15), (24, 40), (50, 90))]
    docs = short + [structured(rng)[: int(rng.integers(0, 30))] for _ in range(300)]
    assert found(short) == [[]] * len(short)
    assert [found([d]) for d in docs] == [[plain(d)] for d in docs]


def test_operator_on_a_text_of_seeds_without_runs(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h a b c d e f x")], "doc_id long, text string")
    assert [(r.doc_id, r.runs, r.collapsed) for r in runs.periodic_runs(df).collect()] == [(1, [], "a b c d e f g h a b c d e f x")]


def test_ids_beside_a_null_id_stay_whole(spark):
    ids = [None, 2**53 + 1, 2**63 - 1, -(2**63)]
    got = runs.periodic_runs(spark.createDataFrame([(i, "a " * 12) for i in ids], "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id for r in got} == set(ids) and all([tuple(x) for x in r.runs] == [(0, 12, 1)] for r in got)


@pytest.mark.parametrize("period", [1, 7])
def test_memory_of_a_long_run(period):
    n = 200_000
    w, doc = np.arange(n) % period, np.zeros(n, np.int64)
    tracemalloc.start()
    got = runs.runs_of(w, doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.tolist() for x in got] == [[0], [n], [period]] and peak < 300 * n


def test_neighbouring_documents_stay_apart():
    docs = [[1, 2, 3] * 3, [1, 2, 3] * 3, [], [7] * 6, [7] * 6, [7] * 12]
    assert found(docs) == [[], [], [], [], [], [(0, 12, 1)]]


def test_seeds_grow_with_the_words_not_with_a_grams_places():
    for make in (lambda n: [0] * n, lambda n: [i % 2 for i in range(n)] + [1], fibonacci, lambda n: ([0] * 50 + [1]) * (n // 51)):
        x = np.array(make(20_000), np.int64)
        names = runs.ladder(x, np.zeros(len(x), np.int64))
        for k in [k for k in names if k >= 12]:
            p = np.flatnonzero(names[k] >= 0)
            if len(p):
                o = np.argsort(names[k][p], kind="stable")
                assert len(runs._chain_pairs(names[k][p][o], p[o], k)[0]) <= 6 * len(x)


def test_operator_on_odd_rows(spark):
    long = " ".join(["x", "y", "z"] * 60_000)
    rows = [(1, None), (2, ""), (3, " \t\r\n\v\f "), (None, "a " * 12), (4, "a b\x1c c d " * 7), (4, "a b\x1c c d " * 7), (5, long), (6, "ü " * 11), (7, "A a " * 6)]
    df = spark.createDataFrame([(*r, 1, "s", [1]) for r in rows], "doc_id long, text string, start int, collapsed string, runs array<int>")
    got = runs.periodic_runs(df.repartition(2)).collect()
    assert len(got) == len(rows) and all(r.collapsed is not None for r in got)
    by = {(r.doc_id): ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by[1] == by[2] == by[3] == ([], "") and by[None] == ([(0, 12, 1)], "a")
    assert by[4] == ([(0, 14, 2)], "a b\x1c c d") and by[6] == ([], " ".join("ü" * 11))
    assert by[5] == ([(0, 180_000, 3)], "x y z") and by[7] == ([(0, 12, 2)], "A a")
    assert runs.periodic_runs(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(3, np.int64), np.zeros(3, np.int64), 6)


def of_contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    own = plain(w)
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(own), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in own)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_registered_query(spark, tmp_path):
    short = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "  ", "a", "a b " * 30, "é è\t" * 20] * 8, 9_000_000)] + [(None, "a " * 40)], "doc_id long, text string")
    short.unionByName(odd, allowMissingColumns=True).withColumn("length", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op12_seed_extend_runs"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0])
    want = sorted((of_contract(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()), key=key)
    assert sorted((tuple(r) for r in df.collect()), key=key) == want and sum(r[1] > 0 for r in want) > 15
