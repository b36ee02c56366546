"""What the operators did less than whole, by finding."""

from __future__ import annotations

import random

import numpy as np
import pytest

from stockflow.llm import html_text, near_dup, quality

SF = "/root/testdata/sf0.01"
def only(name, rng, text):
    """``text``, which no labeller calls bad, as one labeller alone calls it bad."""
    w = text.split()[:300]
    if name == "marks":
        return " ".join(x + "!!" if i % 5 == 0 else x for i, x in enumerate(w))
    if name == "capitals":
        return " ".join(x.upper() if i % 5 < 2 else x for i, x in enumerate(w))
    if name == "separators":
        return " ".join("|" if i % 7 == 0 else x for i, x in enumerate(w))
    if name == "repeats":
        return " ".join(x + " " + x for x in w)
    if name == "distinct":
        return " ".join(w[:3] * 60)
    if name == "same_lines":
        return "\n".join([" ".join(w[:20])] * 2 + [" ".join(w[:20])])
    if name == "digits":
        return " ".join(x + str(i) if i % 5 < 4 else x for i, x in enumerate(w))
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(31)) if i % 5 < 2 else x for i, x in enumerate(w))


def test_scorer_rejects_what_one_labeller_alone_rejects(spark):
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    clean = sorted((r.doc_id, r.text) for r in docs.collect() if len(set((r.text or "").split())) > 100)
    clean = [(i, t) for (i, t), v in zip(clean, quality.read([t for _, t in clean])[0], strict=True) if (v == 1).all()]
    made = [(10_000_000 + 100 * k + i, only(name, rng, t)) for k, name in enumerate(quality.LABELLERS) for i, (_, t) in enumerate(rng.sample(clean, 60))]
    seen = [[list(quality.LABELLERS)[k] for k in range(8) if v[k] == 0] for v in quality.read([t for _, t in made])[0]]
    made = [(m, n[0]) for m, n in zip(made, seen, strict=True) if len(n) == 1]
    made = [m for name in quality.LABELLERS for m in [m for m, n in made if n == name][:5]]
    assert len(made) == 40
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = {r.doc_id: r for r in quality.score(docs, quality.learn(docs)).collect()}
    wrong = [(i, got[i].votes, got[i].weak_label, got[i].score) for i, _ in made if got[i].keep or got[i].weak_label > 0.5]
    assert not wrong, wrong
    assert all(got[i].keep for i, _ in clean)


LONG = "A long line of the text of a page, with more than sixty characters in it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content has-sidebar'><article>{LONG}</article></div>", LONG),
        (f"<div id='page' class='with-header'><main>{LONG}</main></div>", LONG),
        (f"<div class='sidebar'><main>{LONG}</main></div>", LONG),
        (f"<form id='all'><div>{LONG}</div></form>", LONG),
        (f"<div class='newsletter'><p>{LONG}</p></div><div>short</div>", f"{LONG} short"),
        (f"<article><h2 id='related-work'>Related</h2>{LONG}<section id='social-impact'>Impact</section><p id='share-prices'>Prices</p></article>", f"Related {LONG} Impact Prices"),
        (f"<h1><span>Title</span></h1><div><div><div><div><div>{LONG}</div></div></div></div></div><div><div><div><div>End</div></div></div></div>", f"Title {LONG} End"),
        (f"<article>{LONG}<div class='ad'>buy</div><div class='site-footer'>foot</div><div class='cookie-notice'>ok</div></article>", LONG),
        (f"<article>{LONG}<section id='comments'><article class='comment'>nice</article><article>nice</article></section></article>", LONG),
        (f"<p>{LONG}</p><p>{LONG}</p><div class='related'>short</div>", f"{LONG} {LONG}"),
    ],
)
def test_page_text_drops_boilerplate_only(page, text):
    assert html_text.main_text(page) == text


def test_deduplicated_chooses_rows_not_ids(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (2, b), (3, a), (4, c), (None, d), (None, d), (None, c), (None, ""), (None, " "), (5, "")]
    kept = near_dup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = [(1, a), (1, b), (4, c), (None, d), (None, c), (None, ""), (None, " "), (5, "")]
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string").collect()))


def test_estimation_recovers_overlapping_labellers():
    """Three kinds of bad documents, each seen by two or three labellers, and false alarms: the accuracies come from the votes."""
    rng = np.random.default_rng(0)
    alarm = np.array([0.05, 0.02, 0.03, 0.01, 0.04, 0.02, 0.03, 0.02])
    seen = np.array([[0.9, 0.8, 0.7, 0.1, 0.05, 0.05, 0.05, 0.05], [0.05, 0.05, 0.1, 0.9, 0.8, 0.7, 0.05, 0.05], [0.05, 0.05, 0.05, 0.05, 0.05, 0.1, 0.9, 0.85]])
    kind = rng.choice(4, 40_000, p=[0.8, 0.08, 0.07, 0.05])
    chance = np.where((kind == 0)[:, None], alarm, seen[np.maximum(kind - 1, 0)])
    votes = np.where(rng.random((40_000, 8)) < 0.1, -1, np.where(rng.random((40_000, 8)) < chance, 0, 1)).astype(np.int8)
    patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    any_bad = (votes == 0).any(axis=1)
    for kinds, share in ((3, 0.95), (4, 0.91)):
        p, table, shares = quality.estimate(patterns, counts.astype(float), kinds)
        assert ((p[of] > 0.5) == (kind == 0)).mean() > share > 0.9 > (~any_bad == (kind == 0)).mean()
        if kinds == 3:  # with one more, it takes one labeller's false alarms
            assert np.abs(table[0] - alarm).max() < 0.01 and abs(shares[0] - 0.8) < 0.02
            for k in range(3):  # some class is what the labellers of a kind see
                assert np.abs(table[1:] - seen[k]).max(axis=1).min() < 0.15


def test_features_and_votes_against_plain_counting():
    rng = random.Random(3)
    words = ["plain", "Word,", "LOUD", "a!!", "||", "--", "x12", "9", "é", "b" * 40, "ok.", "re"]
    texts = ["", " ", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(200)), "a b\na b\na b\nc d " * 9]
    shares = quality.Parts(texts).shares
    for i, t in enumerate(texts):
        w = t.split()
        n = max(1, len(w))
        lines = [x for x in t.split("\n") if x.strip()]
        want = {
            "capitals": sum(len(x) > 1 and x.upper() == x and x.lower() != x for x in w) / n,
            "digits": sum(any(c.isdigit() for c in x) for x in w) / n,
            "long_words": sum(len(x) > 30 for x in w) / n,
            "repeats": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
            "distinct": len(set(w)) / n,
            "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0,
            "marks": sum(bool(quality.MARKED.search(x)) for x in w) / n,
            "separators": sum(bool(quality.SEPARATOR.match(x)) for x in w) / n,
        }
        assert {k: round(float(v[i]), 9) for k, v in shares.items()} == {k: round(v, 9) for k, v in want.items()}
    weights = np.random.default_rng(1).standard_normal((1 << quality.BITS) + 1)
    scores = quality.linear_scores(quality.Parts(texts), weights)
    plain = [weights[-1] + sum(weights[s] * v for s, v in zip(*row, strict=True)) for row in quality.read(texts)[1]]
    assert np.allclose(scores, plain)
