"""Hard negatives: brute force on odd rows, ties and several rows of an id, and what the thresholds leave out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockflow.llm import negatives
from stockflow.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, best string"


def plain(rows, anchors, positives=5, k=3, least=50, most=95, scale=256):
    """The contract word by word."""
    v = sorted({(i, lab, tuple(int(np.floor(scale * float(np.float32(x)))) for x in e)) for i, e, lab in rows if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, lab, e in v:
        if i not in anchors:
            continue
        others = sorted((-dot(e, f), j, m) for j, m, f in v if j != i and len(f) == len(e))
        for s, p, _ in [x for x in others if x[2] == lab][:positives]:
            inside = [(n, -t) for t, n, m in others if m != lab and -least * s <= -100 * t <= -most * s]
            out += [(i, p, r, n, -s, t) for r, (n, t) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, df.where(F.col("vec_id").isin(list(anchors))), **more).collect())


@pytest.mark.parametrize("shard", [7, 40, 4096])
def test_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    rows = [(i, rng.standard_normal(6).round(1).tolist(), int(rng.integers(0, 4))) for i in range(120)]
    rows += [(i, rows[5][1], i % 3) for i in range(200, 230)]  # ties
    rows += [(300, [0.0] * 6, 0), (301, [-1.0] * 6, 17), (302, [1.0] * 6, 17)]  # a zero vector; a label of two opposite rows
    rows += [(400 + i, [0.5, float(i), 1.0], i % 2) for i in range(9)]  # other length
    rows += [(3, rows[3][1], rows[3][2]), (500, rows[0][1], 1), (500, rows[0][1], 1)]  # repeated
    rows += [(None, rows[0][1], 1), (600, None, 1), (601, [], 1), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (603, [float("nan")] * 6, 1), (604, [float("inf")] * 6, 1), (605, rows[0][1], None)]
    anchors = {*range(0, 120, 4), 200, 204, 300, 301, 400, 402, 500, 601, 605}
    got = mined(spark, rows, anchors, rows_per_shard=shard, queries_per_block=9)
    assert got == plain(rows, anchors) and len(got) > 100


def test_several_vectors_and_labels_of_an_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i // 2, rng.standard_normal(4).tolist(), i % 3) for i in range(80)]
    assert mined(spark, rows, {4, 7}, rows_per_shard=20) == plain(rows, {4, 7})


def test_no_rows(spark):
    assert mined(spark, [], {1}) == [] and mined(spark, [(1, [1.0], 1)], {1}) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)], {1}) == []  # no other label
    assert mined(spark, [(1, [-1.0], 1), (2, [1.0], 1), (3, [1.0], 2)], {1}) == []  # a negative positive score has no window


def test_far_outliers_and_large_components():
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (300, 9)).astype(float)
    v[7] *= 10_000
    v[8] *= 3_000_000_000
    arrays = {"vec_id": rng.permutation(300), "label": rng.integers(0, 40, 300), "vector": v}
    index = negatives.threshold_index(arrays)
    q = {"query_id": arrays["vec_id"][:30], "query_key": np.zeros(30, np.int64), "label": arrays["label"][:30], "vector": v[:30]}
    exact = v.astype(object) @ v.astype(object).T
    for i, (_, _, ids, s) in zip(np.argsort(q["label"] % negatives.GROUPS, kind="stable"), negatives.positives_of_shard(index, q, 5), strict=True):
        same = [j for j in range(300) if arrays["label"][j] == arrays["label"][i] and j != i]
        want = sorted(same, key=lambda j: (-exact[i, j], arrays["vec_id"][j]))[:5]
        if abs(exact[i, want]).max(initial=0) < 2**62 and 8 not in [i, *want]:
            assert ids.tolist() == [arrays["vec_id"][j] for j in want] and s.tolist() == [int(exact[i, j]) for j in want]


def test_levels_hold_each_posting_once_and_bounds_cover_the_rest():
    rng = np.random.default_rng(5)
    v = np.round(rng.standard_normal((500, 16)) * 100)
    v[3] = 0
    x = negatives.threshold_index({"vec_id": np.arange(500), "label": rng.integers(0, 9, 500), "vector": v})
    assert x["ends"][-1] == len(x["rows"]) == np.count_nonzero(v)
    whole = negatives._suffix_lengths(x["vector"])
    for level, t in enumerate(x["steps"]):
        cut = x["cut"][:, level]
        assert (whole[np.arange(500), cut] < t).all() or t == 0
        assert (whole[np.arange(500)[cut > 0], cut[cut > 0] - 1] >= t).all()  # no posting that the bound covers


def test_thresholds_save_work(spark):
    """Alike vectors: most postings are never read and few pairs scored; given (random) ones: some."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((40, 64)) * np.geomspace(1, 0.05, 64)
    v = np.round(256 * (centre[np.arange(4000) % 40] + 0.1 * rng.standard_normal((4000, 64)) * np.geomspace(1, 0.05, 64)))
    label = (np.arange(4000) % 40 + (np.arange(4000) % 11 == 0)) % 40
    x = negatives.threshold_index({"vec_id": np.arange(4000), "label": label, "vector": v})
    s = v[:50] @ v.T
    top = np.array([np.sort(s[i][(label == label[i]) & (np.arange(4000) != i)])[-1] for i in range(50)])
    q = {"query_id": np.arange(50), "query_key": np.arange(50), "label": label[:50], "vector": v[:50], "lo0": np.ceil(top * 0.5).astype(int), "hi0": (top * 0.95).astype(int)}
    work: list = []
    got = negatives.negatives_of_shard(x, q, 3, 1, work)
    pairs, postings, read, scored = np.sum(work, axis=0)
    assert read < 0.5 * postings and scored < 0.2 * pairs
    for i, (_, _, _, ids, t) in enumerate(got):
        inside = [j for j in np.lexsort((np.arange(4000), -s[i])) if label[j] != label[i] and q["lo0"][i] <= s[i, j] <= q["hi0"][i]][:3]
        assert ids.tolist() == inside and t.tolist() == s[i, inside].astype(int).tolist()


def test_registered_columns(spark):
    assert QUERIES["op11_threshold_join_negatives"](spark, "/root/testdata/sf0.001").columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
