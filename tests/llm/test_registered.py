"""The registered queries' columns on whole small tables, models against plain versions, and the pipeline on odd rows."""

from __future__ import annotations

import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockflow.llm import quality, toxicity, words
from stockflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return {d: tk.encode(t, add_special_tokens=False).ids for d, t in docs.items()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_op1(spark, ids):
    df = QUERIES["op1_grouping_genetic_packing"](spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(df.columns)
    pieces, places = {}, {}
    for r in df.collect():
        own = [*ids[r.doc_id], 0][r.start : r.start + r.length]
        assert len(own) == r.length <= 2048 and crc(own) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        own.sort()
        assert [p for p, *_ in own] == list(range(len(own))) and [s for _, s, _ in own] == np.cumsum([0, *(n for *_, n in own)])[:-1].tolist() and sum(n for *_, n in own) == len(ids[d]) + 1
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(places) <= 1 + math.ceil(sum(len(x) + 1 for x in ids.values()) / 2048) * 1.01


def test_op2(spark, ids):
    start = 0
    got = {r.doc_id: r for r in QUERIES["op2_rans_ids"](spark, SF).collect()}
    assert set(got) == set(ids)
    for d in sorted(ids):
        own = [*ids[d], 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(own), crc(own))
        start += len(own)


def test_op3(spark, docs):
    import tiktoken

    from stockflow.llm.bpe import ranks_of

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_distinct_word_bpe"](spark, SF).collect()}
    want = {d: own.encode_ordinary(t) for d, t in docs.items()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {d: (len(x), sha(" ".join(map(str, x)).encode()), sha(docs[d].encode())) for d, x in want.items()}


def test_op5(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op5_ftrl_toxicity"](spark, SF).collect()}
    assert set(got) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    cell = lambda v: "NULL" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    df = QUERIES[name](spark, SF)
    assert df.columns == columns
    assert sorted(tuple(map(cell, r)) for r in df.collect()) == sorted(tuple(map(cell, r)) for r in found.fetchall())


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 12)) for _ in range(150)]
    labels = np.array([int(7 in x or 11 in x) for x in sets])
    z, n, w = dict.fromkeys(range(65), 0.0), dict.fromkeys(range(65), 0.0), {}
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        if i == 64:
            return -z[i] / ((b + math.sqrt(n[i])) / a + l2)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(3):
        for x, y in zip(sets, labels, strict=True):
            w = {int(i): weight(int(i)) for i in [*x, 64]}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (toxicity.POSITIVE if y else 1.0)
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
                n[i] += g * g
    got, bias = toxicity.ftrl(sets, labels, bits=6, epochs=3)
    assert np.allclose(got, [weight(i) for i in range(64)]) and math.isclose(bias, weight(64))
    assert 0 < np.count_nonzero(got) < 64 and got[7] > 0 and got[11] > 0


def test_training_is_bounded_by_rows_and_not_moved_by_repeats(spark):
    """One id in two fifths of all rows, each with another text; and every row three times over."""
    from stockflow.llm.common import one_text_each, texts

    base = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("good words "), F.col("id"), F.when(F.col("id") % 3 == 0, " vile toad").otherwise(" kind bird")).alias("text"))
    labels = base.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    hot = base.unionByName(spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("hot vile toad "), F.col("id")).alias("text")))
    assert one_text_each(texts(hot)).count() == 3000
    chosen = labels.where(~toxicity.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(50).select("doc_id").unionByName(spark.createDataFrame([(7,)], "doc_id long")).distinct()
    assert one_text_each(texts(hot).join(chosen, "doc_id")).count() == chosen.count() <= 51
    once, often = (toxicity.learn(d, labels, most=400) for d in (base, base.unionByName(base).unionByName(base)))
    assert all(np.array_equal(a, b) for a, b in zip(once, often, strict=True)) and len(once[0])
    one, many = (quality.learn(d.repartition(3), most=300) for d in (base, hot))
    assert np.count_nonzero(one.weights()) and np.count_nonzero(many.weights())


def test_scores_are_sums_over_the_set_of_grams():
    texts, bits = ["One two two three.", "", "  !!", "two one", "Zwei, drei VIER fünf sechs zwei drei"], 18
    weights = np.random.default_rng(1).standard_normal(1 << bits)
    sets = words.gram_sets(texts, bits)
    assert np.allclose(words.gram_scores(texts, weights, 0.5, bits), [0.5 + weights[s].sum() for s in sets])
    assert [len(s) for s in sets][1:3] == [0, 0]


def test_quality_training_against_a_plain_version():
    rng = np.random.default_rng(6)
    rows = [(np.unique(rng.integers(0, 30, 5)), None) for _ in range(60)]
    rows = [(s, rng.random(len(s))) for s, _ in rows]
    target = rng.random(60)
    w, g2 = [0.0] * 33, [1e-3] * 33
    for _ in range(quality.EPOCHS):
        for (slots, values), y in zip(rows, target, strict=True):
            x = {**dict(zip(slots.tolist(), values.tolist(), strict=True)), 32: 1.0}
            e = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - y
            for i, v in x.items():
                g2[i] += (e * v) ** 2
                w[i] -= quality.RATE * e * v / math.sqrt(g2[i])
    assert np.allclose(quality.train(rows, target, bits=5), w)


def test_estimation_against_a_plain_version():
    votes = np.array([[1, 1, -1], [0, 1, 1], [0, 0, 1], [-1, -1, -1], [1, 0, 0]], np.int8)
    counts = np.array([50.0, 5.0, 9.0, 2.0, 4.0])
    p, table, share = quality.estimate(votes, counts, kinds=2, rounds=40)
    r = []
    for v in votes:
        bad = (v == 0).any()
        first = [(v[k] == 0) + 0.02 for k in range(2)]
        r.append([0.1 if bad else 0.98, *((0.9 if bad else 0.02) * x / sum(first) for x in first)])
    prior = [(quality.FALSE_ALARM * quality.PRIOR, (1 - quality.FALSE_ALARM) * quality.PRIOR)] + [(quality.KIND_PRIOR, quality.KIND_PRIOR)] * 2
    for _ in range(40):
        n = [sum(c * x[k] for c, x in zip(counts, r, strict=True)) for k in range(3)]
        pi = [(n[k] + (5 if k == 0 else 1)) / (sum(counts) + 7) for k in range(3)]
        th = [[(sum(c * x[k] for c, x, v in zip(counts, r, votes, strict=True) if v[j] == 0) + prior[k][0]) / (sum(c * x[k] for c, x, v in zip(counts, r, votes, strict=True) if v[j] >= 0) + sum(prior[k])) for j in range(3)] for k in range(3)]
        new = []
        for v in votes:
            like = [pi[k] * math.prod(th[k][j] if v[j] == 0 else 1 - th[k][j] for j in range(3) if v[j] >= 0) for k in range(3)]
            new.append([x / sum(like) for x in like])
        done = max(abs(x - y) for a, b in zip(r, new, strict=True) for x, y in zip(a, b, strict=True)) < 1e-6
        r = new
        if done:
            break
    assert np.allclose(p, [x[0] for x in r]) and np.allclose(table, th) and np.allclose(share, pi)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, no rows, and extra columns with clashing names."""
    import corpus_pipeline

    real = spark.read.parquet(f"{SF}/documents.parquet")
    text = max((r.text for r in real.where("lang = 'en'").collect() if r.text), key=len)
    plain = " ".join(text.split()[:200])
    rows = [(None, plain, None, None, None), (900_001, None, None, None, None), (900_002, "", "en", "x", 0), (900_003, plain + " again", "en", "x", 1), (900_003, plain + " again", "en", "x", 1), (900_003, " ".join(text.split()[300:500]), "en", "x", 1), (900_004, (text + " ") * 40, "en", "x", 1)]
    odd = spark.createDataFrame(rows, real.schema)
    docs = real.unionByName(odd).withColumns({c: F.lit(1) for c in ("node", "score", "label", "item", "h", "_row")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
        assert docs.where("doc_id IS NULL").count() == 1 and docs.where("doc_id IS NULL").first().text == plain
    left = sorted((r.doc_id, (r.text or "")[:20]) for r in docs.where("doc_id > 900000").collect())
    assert left.count((900_003, plain[:20])) <= 1 and len([x for x in left if x[0] == 900_003]) >= 1  # other texts of one id are no copies
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
    none = real.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
