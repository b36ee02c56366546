"""Personal data: the base against plain patterns, what weak supervision adds and leaves alone, and odd texts."""

from __future__ import annotations

import hashlib
import random
import re


from stockflow.llm import private_data as P
from stockflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
# the contract's patterns, as they stand
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def odd_texts():
    rng = random.Random(7)
    bits = ["a.b@c.d", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.000255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "-", "x", "é", "😀", "9", "12", "\n", "x@y.z._q@r.s", "a@b", "+12 ", "1.2.3.4.5.6.7.8", "--", "4012888888881881", "a@-b.c"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)] + [None, "", "a" * 9000, "1" * 9000, "1." * 9000, "a@" * 9000, "a." * 5000 + "@b" + ".c" * 9000, "+1" + " " * 9000, "1.1.1.1 " * 9000, "😀 a@b.cd " * 3000]


def test_base_against_plain_patterns(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: sorted((s.start, P.KINDS.index(s.kind), s.end) for s in r.spans if s.base) for r in P.private_spans(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == plain(t), (t or "")[:80]


def test_long_texts_take_linear_time(spark):
    """The plain patterns would take minutes for these."""
    texts = ["a" * 1_000_000, "a." * 300_000 + "@b" + ".c" * 300_000, "1" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in P.private_spans(df).collect()}
    assert got == {0: [], 1: [("email", 0, 1_200_002, True)], 2: []}


def world(seed):
    """Texts with base data, other forms of it with words before them, and look-alikes; (text, other forms as they stand)."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    prose = lambda: " ".join(word() for _ in range(rng.randint(5, 20)))

    def card(sep):
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    for i in range(900):
        kind, form = i % 9, None
        if kind == 0:
            t = f"{prose()} {word()}.{num(2)}@{word()}.example.com {prose()}"
        elif kind == 1:
            t = f"{prose()} +1 ({num(3)}) 555-{num(4)} {prose()}"
        elif kind == 2:
            t = f"{prose()} {card(rng.choice(['', ' ', '-']))} {prose()}"
        elif kind == 3:
            t = f"{prose()} {rng.randint(11, 120)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)} {prose()}"
        elif kind == 4:
            form = rng.choice([f"{word()} [at] {word()} [dot] com", f"{word()}(at){word()}.org"])
            t = f"{prose()} mail {form}, {prose()}"
        elif kind == 5:
            form = rng.choice([f"(212) 555-{num(4)}", f"0044 20 7946 {num(4)}"])
            t = f"{prose()} call {form} {prose()}"
        elif kind == 6:
            form = card(".")
            t = f"{prose()} my card {form} {prose()}"
        elif kind == 7:  # look-alikes: a sum in groups, an address too large, a wrong check digit, prose
            t = f"{prose()} order {num(3)} {num(3)} {num(4)} {prose()} 999.{num(3)}.300.1 {prose()} release 4111 1111 1111 1112 {prose()} is at home.{word().title()} {prose()}"
        else:
            t = prose()
        out.append((t, form))
    return out


def test_weak_supervision_adds_other_forms_and_no_look_alikes(spark):
    rows = world(3)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.private_spans(df).collect()}
    added = {i: [rows[i][0][s.start : s.end] for s in spans if not s.base] for i, spans in got.items()}
    forms = [i for i, (_, f) in enumerate(rows) if f]
    right = sum(any(rows[i][1] in a or a in rows[i][1] for a in added[i]) for i in forms)
    wrong = sum(len(added[i]) for i, (_, f) in enumerate(rows) if not f)
    assert right >= 0.9 * len(forms), (right, len(forms))
    assert wrong <= 3, [added[i] for i, (_, f) in enumerate(rows) if not f and added[i]]
    assert all(plain(t) == sorted((s.start, P.KINDS.index(s.kind), s.end) for s in got[i] if s.base) for i, (t, _) in enumerate(rows))


def test_estimation_recovers_reliabilities():
    rng = random.Random(1)
    true_rate, false_rate, counts = (0.95, 0.9, 0.85, 0.8, 0.9, 0.7), (0.2, 0.3, 0.4, 0.1, 0.5, 0.3), {}
    for _ in range(20_000):
        y = rng.random() < 0.6
        p = "".join("-" if rng.random() < 0.2 else str(int(rng.random() < (true_rate if y else false_rate)[j])) for j in range(6))
        counts[p] = counts.get(p, 0) + 1.0
    post, rate, share = P.reliabilities(counts)
    assert abs(share - 0.6) < 0.05
    assert all(abs(a - t) < 0.05 and abs(b - f) < 0.07 for (a, b), t, f in zip(rate, true_rate, false_rate, strict=True))
    assert post["111111"] > 0.95 and post["000000"] < 0.05 and all(0 <= x <= 1 for x in post.values())


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (None, "x a@b.cd"), (3, "é😀 1.2.3.4"), (3, "é😀 1.2.3.4"), (4, "1.2.3.4@a.b")]
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, n int, spans string, blocks int")
    got = sorted(((r.doc_id or 0, [tuple(s) for s in r.spans]) for r in P.private_spans(df).collect()))
    assert got == [(0, [("email", 2, 8, True)]), (1, []), (2, []), (3, [("ip", 3, 10, True)]), (3, [("ip", 3, 10, True)]), (4, [("email", 0, 11, True), ("ip", 0, 7, True)])]
    assert P.private_spans(df.where("false")).collect() == []
    assert [r.spans for r in P.private_spans(df.where("doc_id < 3")).collect()] == [[], []]


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (P.marked(docs), P.private_spans(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    df = QUERIES["op13_weak_label_spans"](spark, SF)
    assert df.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(docs)
    for r in docs:
        want = plain(r.text)
        listed = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in want)
        own = got[r.doc_id]
        assert tuple(own[1:5]) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert own.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(own.spans.split(","))
    assert sum(len(plain(r.text)) for r in docs) > 20
