"""Vector search: recall and work on the given vectors, proofs, ties, repeated ids and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockflow.llm import ann, impact
from stockflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def given(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None)
    return np.array([i for i, _ in rows]), np.array([e for _, e in rows], np.float64)


def test_nearest_query_scores_a_tenth_with_nine_tenths_recall(spark, given):
    ids, v = given
    got = QUERIES["op7_hash_prefix_forest"](spark, SF).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    place, hits, wanted = {int(i): p for p, i in enumerate(ids)}, 0, 0
    for q in ids[ids % 50 == 0].tolist():
        s = u @ u[place[q]]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and all(abs(r[2] - s[place[r[1]]]) < 1e-12 for r in own)
        want = [int(ids[x]) for x in np.lexsort((ids, -s)) if ids[x] != q][:5]
        hits, wanted = hits + len(set(want) & {r[1] for r in own}), wanted + 5
    assert hits / wanted >= 0.9
    index, strings = ann.forest({"vector": v}, ann.TREES, 7), ann.hash_strings(v[:100], ann.TREES, 7)
    most = int(ann.SCORED * len(v))
    assert max(len(c) for c in ann.candidates(index, strings, ann.ENTRIES, most)) <= most <= 0.1 * len(v)
    # of the rows met, those met most often: not just any of them
    assert len(ann.candidates(index, strings[:, :1], ann.ENTRIES, len(v))[0]) > most


def test_descent_ends_at_the_longest_prefix():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 32))
    v[10] = v[11] + 1e-9
    index, strings = ann.forest({"vector": v}, 64, 3), ann.hash_strings(v[11:12], 64, 3)
    assert {10, 11} <= set(ann.candidates(index, strings, 0.01, 3000)[0].tolist())
    assert len(ann.candidates(index, strings, 0.01, 3000)[0]) < 100 < len(ann.candidates(index, strings, 1.0, 3000)[0])


def test_top_k_stops_before_the_last_segment(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    read = impact.postings_read(e, e.where("vec_id % 20 = 0")).collect()
    assert np.mean([r.postings_read < r.postings for r in read]) > 0.9
    assert np.mean([r.postings_read / r.postings for r in read]) < 0.8 and np.mean([r.rows_scored for r in read]) < 0.1 * 2000


def test_segments_hold_each_posting_once_by_descending_impact():
    v = np.random.default_rng(2).integers(-9, 10, (50, 7)).astype(float)
    index = impact.impact_index({"vec_id": np.arange(50), "vector": v})
    again, at, least = np.zeros_like(v), 0, np.inf
    for s in range(len(index["bounds"])):
        seen = []
        for d in range(7):
            last = index["ends"][s * 7 + d]
            again[index["rows"][at:last], d] += index["values"][at:last]
            seen += np.abs(index["values"][at:last]).tolist()
            at = last
        assert max(seen) < least and min(seen) >= index["bounds"][s]
        least = index["bounds"][s]
    assert (again == v).all()


@pytest.mark.parametrize("dim", [1, 3, 70])
def test_top_k_of_any_shape(dim):
    rng = np.random.default_rng(dim)
    v, w = rng.integers(-40, 40, (300, dim)).astype(float), rng.integers(-40, 40, (20, dim)).astype(float)
    v[50:90] = v[0]
    v[100:110] = 0
    w[0] = 0
    ids = rng.permutation(300)
    parts, _ = impact.best_of_shard(impact.impact_index({"vec_id": ids, "vector": v}), {"query_id": np.arange(20), "query_key": np.arange(20), "vector": w}, 15)
    for i, (_, _, found, score) in enumerate(parts):
        s = v @ w[i]
        want = [x for x in np.lexsort((ids, -s)) if ids[x] != i][:15]
        assert found.tolist() == ids[want].tolist() and score.tolist() == s[want].astype(int).tolist()


@pytest.mark.parametrize("op", [ann.nearest, impact.top_k])
def test_several_vectors_of_an_id_and_clashing_columns(spark, op):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    rows = [(i // 2, v[i].tolist(), "x", 1, 2.0) for i in range(60)] + [(3, v[6].tolist(), "x", 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class string, query_id int, score double").repartition(3)
    got = op(df, df.where(F.col("vec_id") == 3), k=59, rows_per_shard=25).collect()
    assert len(got) == 2 * 58 and {r.query_id for r in got} == {3} and 3 not in {r.vec_id for r in got}  # both queries, both vectors of each other id
    assert sorted(r.vec_id for r in got) == sorted(4 * [i for i in range(30) if i != 3])
