"""The operators against brute force, round trips and held-out labels, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockflow.llm import ann, bpe, html_text, impact, lm_score, near_dup, packing, quality, rans, toxicity
from stockflow.llm.tokens import Encoder

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a", "a  b", "a \n b", "a\n \nb", "<|endoftext|> hi", "é ü\tz \t z", "a\x1cb \x1d c\x85d", "don't  we're 'd 12 34", "x" * 5000, "!" * 3000, "a " * 3000, "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated row, and other columns whose names clash with those the operators use."""
    rows = [(None if i == 5 else i, t, 1, 2.0, "x", "y") for i, t in enumerate(ODD)] + [(3, "  a", 1, 2.0, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, score double, node string, block string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def tk():
    return Tokenizer.from_file(JSON)


def test_chunks_give_the_ids_of_whole_texts(tk):
    rng = random.Random(1)
    texts = [x or "" for x in ODD] + ["".join(rng.choice(["a", " ", "\n", "é", "'s", "1", "!", " ", "漢", " ", "<|endoftext|>", "<|endof"]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [x.format("<|endoftext|>") for x in ("{0}", "{0}{0}", " {0} ", "{0} a", "a {0}", "a {0} b", "a{0}b", "x {0}.{0} y")]
    e = Encoder(JSON)
    for _ in range(2):
        ids, counts = e.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in tk.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, wanted, capacity):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, odd, docs, empty, tk):
    for frame, capacity in ((odd, 64), (docs, 2048)):
        wanted = []
        for r in frame.collect():
            ids = np.array(tk.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
            n, start, piece = len(ids), 0, 0
            while start < n:
                length = (n if n <= capacity else n % capacity or capacity) if piece == 0 else capacity
                wanted.append((r.doc_id is not None, r.doc_id or 0, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                start, piece = start + length, piece + 1
        bins = check_packing(packing.pack_documents(frame, JSON, capacity).collect(), wanted, capacity)
        assert bins <= 1 + -(-sum(w[4] for w in wanted) // capacity) * 1.02
    assert packing.pack_documents(empty, JSON).count() == 0


def test_packing_over_many_shards_and_assembly(spark, odd):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 3000).tolist() + [100] * 7
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    found = packing.pack(items, 100, per_shard=300).join(items, "item").collect()
    assert len(found) == len(lengths)
    loads = Counter()
    for r in found:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 100 and len(loads) <= sum(lengths) / 100 * 1.02
    packed = packing.pack_documents(odd, JSON, 64, with_ids=True)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * sum(r.lengths) and len(r.doc_ids) == len(r.lengths)


def test_packing_takes_pieces_that_never_fit_together(spark):
    items = spark.createDataFrame([(i, 60) for i in range(900)], "item long, length long")
    assert packing.pack(items, 100, per_shard=100).select("sequence_id").distinct().count() == 900


def triplets(n, rng):
    """Lengths of which three fill a bin of 1000, and which best fit packs badly."""
    out = []
    for _ in range(n):
        a = rng.integers(380, 490)
        b = rng.integers(250, (1000 - a) // 2 + 1)
        out += [a, b, 1000 - a - b]
    return rng.permutation(np.array(out, np.int64))


def test_evolution_beats_best_fit_on_hard_lengths(spark):
    rng = np.random.default_rng(1)
    lengths = triplets(300, rng)
    best_fit = int(packing.best_fit(lengths, 1000, np.argsort(-lengths, kind="stable")).max()) + 1
    first = packing.first_population(lengths, 1000, 4, rng)
    found = packing.evolve(lengths, 1000, first, rng, 3)[0]
    assert np.bincount(found, lengths).max() <= 1000 and found.max() + 1 < 0.92 * best_fit
    for a, b in itertools.permutations(first[:3], 2):
        for child in (packing.crossover(lengths, 1000, a, b, rng), packing.mutated(lengths, 1000, a, rng)):
            assert child.min() == 0 and np.bincount(child, lengths).max() <= 1000 and len(np.unique(child)) == child.max() + 1
    items = spark.createDataFrame(list(enumerate(lengths.tolist())), "item long, length long")
    spread = packing.pack(items, 1000, per_shard=450).join(items, "item").groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert spread.where("n > 1000").count() == 0 and spread.count() < 0.94 * best_fit


def test_replacements_leave_fuller_bins():
    lengths = np.array([40, 30, 20, 50, 95, 69], np.int64)
    start = np.array([0, 0, 0, 1, -1, -1])  # bins of 90 and 50; 95 and 69 are displaced
    packing.replaced(lengths, 100, start)
    assert sorted(np.flatnonzero(start < 0).tolist()) == [0, 2, 3] and start[5] == 0 and start[4] == 1


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 700_000])
def test_rans_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 50257).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=50257))
    payload = rans.encode_block(ids, table)
    assert (rans.decode_block(payload, table) == ids).all()
    _, _, lanes, _, marks, *_ = rans.HEAD.unpack_from(payload)
    for step in (1, 2):
        runs = [rans.decode_block(payload, table, (i, i + step)) for i in range(0, marks, step)]
        assert np.array_equal(np.concatenate(runs or [np.zeros(0, np.uint32)]), ids)
        assert all(len(x) == step * rans.CHECKPOINT * lanes for x in runs[:-1])
    if n:
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(broken), table)


def test_rans_files(spark, odd, empty, tk, tmp_path):
    rows = odd.unionByName(spark.createDataFrame([(None, f"no id {i}") for i in range(40)] + [(7, f"same id {i}") for i in range(40)], "doc_id long, text string"), allowMissingColumns=True)
    files = rans.write_ids(rows, JSON, 2, out=f"{tmp_path}/ids")
    whole, digest = rans.read_ids(spark, files).collect(), rans.read_ids(spark, files, digest=True).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, tk.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in rows.collect())
    whole.sort(key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in whole] == [w[:2] for w in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in whole) == want
    assert [r.start for r in whole] == np.cumsum([0, *(r.n_tokens for r in whole)])[:-1].tolist()
    assert sorted(r.ids_crc32 for r in digest) == sorted(zlib.crc32(np.array(w[2], "<u4").tobytes()) for w in want)
    everything = [i for r in whole for i in r.ids]
    for first, last in ((0, 10**9), (5, 6), (3000, 9000), (len(everything) - 1, len(everything)), (len(everything), 10**9)):
        parts = sorted((r.start, list(r.ids)) for r in rans.read_range(spark, files, first, last).collect())
        assert [i for _, ids in parts for i in ids] == everything[first:last]
        assert not parts or parts[0][0] == first
    assert rans.read_ids(spark, rans.write_ids(empty, JSON, 2)).count() == 0


def test_rans_files_are_read_by_another_process(spark, docs, tk, tmp_path):
    """Nothing but the folder and the description of the format: frequencies, blocks, lanes."""
    files = rans.write_ids(docs.limit(20), JSON, 2, out=f"{tmp_path}/ids")
    code = f"""
import glob, struct, zlib
import pyarrow.parquet as pq
f = sorted(zip(*pq.read_table({files!r} + "/frequencies").to_pydict().values()))
freq, first, symbol = {{}}, {{}}, []
for i, n in f:
    freq[i], first[i] = n, len(symbol)
    symbol += [i] * n
for r in sorted(pq.read_table({files!r} + "/blocks").to_pylist(), key=lambda r: (r["part"], r["block"])):
    p = r["payload"]
    magic, n, lanes, steps, marks, words, crc, _ = struct.unpack_from("<8s7I", p)
    state = list(struct.unpack_from(f"<{{lanes}}Q", p, 36 + 4 * marks))
    w = iter(struct.unpack_from(f"<{{words}}I", p, 36 + 4 * marks + 8 * marks * lanes))
    ids = []
    for s in range(steps):
        for l in range(lanes):
            slot = state[l] & 0xFFFFF
            ids.append(symbol[slot])
            state[l] = freq[ids[-1]] * (state[l] >> 20) + slot - first[ids[-1]]
            if state[l] < 1 << 31:
                state[l] = state[l] << 32 | next(w)
    ids = ids[:n]
    assert zlib.crc32(struct.pack(f"<{{n}}I", *ids)) == crc
    print(*ids)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    want = [i for r in sorted(docs.limit(20).collect()) for i in tk.encode(r.text or "", add_special_tokens=False).ids + [2]]
    assert list(map(int, out)) == want


def test_bpe_words():
    import tiktoken

    ranks = bpe.ranks_of(RANKS)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for n in [*range(1, 60), 200, 2000]:
        w = bytes(rng.choice(b"aabcthe !\xc3\xa9") for _ in range(n))
        assert bpe.merged(w, ranks) == own._encode_single_piece(w)


@pytest.mark.parametrize("chars", [14_000_000, 3000])
def test_bpe_documents(spark, odd, empty, chars):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    encoded = bpe.encode(odd, RANKS, P.PATTERN, block_chars=chars, with_decoded=True)
    want = sorted((r.doc_id is not None, r.doc_id or 0, own.encode_ordinary(r.text or "")) for r in odd.collect())
    got = encoded.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == want
    assert all(own.decode_bytes(list(r.ids)) == bytes(r.decoded) for r in got)
    again = bpe.decode(encoded.drop("decoded"), RANKS).collect()
    assert sorted(hashlib.sha256(r.decoded).hexdigest() for r in again) == sorted(hashlib.sha256(r.decoded).hexdigest() for r in got)
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0
    assert bpe.encode(empty, RANKS, P.PATTERN, with_decoded=True).count() == 0
    few = bpe.encode(odd, RANKS, P.PATTERN, block_chars=chars, most_words=5).collect()  # a task that forgets its words
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in few) == want


def test_bpe_decoding_joins_the_token_bytes(spark, odd):
    encoded = bpe.encode(odd, RANKS, P.PATTERN, with_decoded=True)
    assert "BroadcastHashJoin [token#" in encoded._jdf.queryExecution().executedPlan().toString()
    big = spark.createDataFrame([(2**60 + 1, "a b"), (None, "c"), (2**60 + 3, None)], "doc_id long, text string").coalesce(1)
    found = bpe.encode(big, RANKS, P.PATTERN, with_decoded=True).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in found) == [(0, b"c"), (2**60 + 1, b"a b"), (2**60 + 3, b"")]
    rows = [(1, [87, 220, 331, 87], "x", "y"), (1, [87, 220, 331, 87], "x", "y"), (None, [], "x", "y"), (2, None, "x", "y")]
    ids = spark.createDataFrame(rows, "doc_id long, ids array<int>, token string, bytes string").repartition(3)
    by_id = {i: b for b, i in bpe.ranks_of(RANKS).items()}
    got = bpe.decode(ids, RANKS)
    assert got.columns == ["doc_id", "ids", "token", "bytes", "decoded"]
    assert sorted(map(str, ((r.doc_id, r.token, bytes(r.decoded)) for r in got.collect()))) == sorted(map(str, ((d, t, b"".join(by_id[i] for i in x or [])) for d, x, t, _ in rows)))
    assert bpe.decode(ids.where("false"), RANKS).count() == 0
    for bad in ([10_000_000], [87, None]):
        with pytest.raises(Exception, match="no token has the id"):
            bpe.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), RANKS).collect()


def test_lm_score_prefers_the_target(spark, odd, empty):
    rng = random.Random(5)
    words = {"en": ["the", "cat", "sat", "on", "a", "mat"], "xx": ["lorem", "ipsum", "dolor", "sit", "amet", "sed"]}
    rows = [(i, lang, " ".join(rng.choice(words[lang]) for _ in range(30))) for i in range(60) for lang in [("en", "xx")[i % 2]]] + [(60, "en", ""), (61, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in lm_score.score(df, F.col("lang") == "en").collect()}
    assert len(got) == 62 and got[60].score is None and got[61].n_words == 0
    assert max(got[i].score for i in range(0, 60, 2)) < min(got[i].score for i in range(1, 60, 2))
    other = lm_score.score(df.where("lang = 'xx'"), target_docs=df.where("lang = 'en'")).collect()
    assert len(other) == 30 and all(r.h_target > r.h_background for r in other)
    assert lm_score.score(odd).count() == len(ODD) + 1 and lm_score.score(empty).count() == 0


def test_toxicity_on_held_out_documents(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels)
    assert len(model[0]) < 20_000
    got = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.97
    assert np.mean([s >= 0.7 for s in toxic]) > 0.65 and np.mean([s >= 0.7 for s in clean]) < 0.005
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert toxicity.score(empty, toxicity.learn(empty, labels.where("false"))).count() == 0


def test_quality_finds_the_labels_it_never_saw(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.learn(docs)
    got = quality.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r.keep == bool(r.quality) for r in got]) > 0.99
    assert all(r.keep for r in got if r.quality)
    assert len(model.accuracy) == len(quality.LABELLERS)
    assert quality.score(odd, model).count() == len(ODD) + 1
    assert quality.score(empty, quality.learn(empty)).count() == 0


def vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)).astype(np.float32) / 4
    m[n // 2 : n // 2 + 30] = m[0]  # a common vector
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(m)]
    bad = [(n, None, "x"), (n + 1, [], "x"), (n + 2, [0.0] * dim, "x"), (n + 3, [float("nan")] * dim, "x"), (n + 4, [None] * dim, "x"), (n + 5, [1.0, 2.0], "x"), (None, rows[1][1], "x"), rows[7]]
    return m, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, shard string")


def test_nearest(spark):
    m, df = vectors(spark, 1200, 16, 1)
    queries = df.where("vec_id % 50 = 0")
    got = ann.nearest(df, queries, k=5, rows_per_shard=400).collect()
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 1200, 50):
        s = u @ u[q]
        want = sorted((x for x in range(1200) if x != q), key=lambda x: (-round(s[x], 12), x))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r[2] - s[r[1]]) < 1e-12 for r in own)
        hits += len({r[1] for r in own} & set(want))
    assert hits / (24 * 5) >= 0.9
    assert not {r.query_id for r in got} & {1202, 1200}
    assert ann.nearest(df.where("false"), queries).count() == 0


def test_impact_top_k(spark):
    m, df = vectors(spark, 900, 8, 2)
    got = impact.top_k(df, df.where("vec_id % 20 = 0"), k=20, rows_per_shard=200, queries_per_block=10).collect()
    v = np.floor(64 * m.astype(float)).astype(np.int64)
    zero = 902  # the zero vector is a candidate here
    for q in range(0, 900, 20):
        s = [(-int(v[x] @ v[q]), x) for x in range(900) if x != q] + [(0, zero)]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(x, -y) for y, x in sorted(s)[:20]]
    assert impact.top_k(df, df.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One  <b>two<br>three<p>Four&nbsp;five<div class=ad>buy</div><form>mail <input></form></article>
<section id="comments"><article class="comment">nice</article></section><aside>more</aside><footer>&copy;</footer></body></html>"""


def test_page_text(spark):
    assert html_text.main_text(PAGE) == "A & B One two three Four five"
    for x in ("", "<nav>menu</nav>", "<script>x", "<!-- open", "<p class='"):
        assert html_text.main_text(x) in ("", "<p class='")
    assert html_text.main_text("<div>" + "word " * 50 + "</div><div class=sidebar>" + "link " * 50 + "</div>") == ("word " * 50).strip()
    df = spark.createDataFrame([(1, "u", PAGE, 5), (None, None, None, 6), (1, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "A & B One two three Four five", 29), (1, "A & B One two three Four five", 29)]


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = sum((sets[a] & sets[b]).values())
        if common and common / (sum(sets[a].values()) + sum(sets[b].values()) - common) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, docs, odd, empty):
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    found = near_dup.classes(odd).collect()
    assert len(found) == len(ODD)  # all rows with an id, the repeated one too
    assert {r.doc_id: r.class_id for r in found}[15] == 14 and {r.doc_id: r.class_size for r in found}[0] == 1
    assert near_dup.classes(empty).count() == 0
    kept = near_dup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.class_id for r in found}) + 1  # and the row without an id


def test_near_duplicates_of_a_family_of_edits(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(1, 7)):
            t[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(f"y{rng.randrange(50)}" for _ in range(100))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.classes(df).collect()} == brute_classes(rows)


def test_bag_minhash_is_unbiased_for_weights():
    rng = random.Random(4)
    a, b = [], []
    for _ in range(80):
        x = [f"w{rng.randrange(3)}" for _ in range(rng.choice([30, 120]))]
        y = list(x)
        for _ in range(3):
            y[rng.randrange(len(y))] = f"w{rng.randrange(4)}"
        a.append(" ".join(x))
        b.append(" ".join(y))
    doc, shingle, weight, _ = near_dup.multisets(a + b, width=2)
    assert weight.max() > 4
    sig = near_dup.signatures(doc, shingle, weight, 160, 192)
    sets = [near_dup.occurrences(shingle[doc == i], weight[doc == i]) for i in range(160)]
    true = np.array([near_dup.similarity(sets[i], sets[i + 80]) for i in range(80)])
    seen = (sig[:80] == sig[80:]).mean(axis=1)
    assert abs((seen - true).mean()) < 0.015 and np.sqrt(((seen - true) ** 2).mean()) < 0.06


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        assert docs.columns == before.columns and 0 < docs.count() < before.count(), name
    left = docs.join(labels, "doc_id")
    assert left.where("quality = 0").count() == 0
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(set(brute_classes(texts).values())) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == len(texts)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
