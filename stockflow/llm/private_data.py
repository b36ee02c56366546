"""Personal data by weak supervision, in DataFrame functions alone.

Matches of fixed patterns that pass their checks are the base. Matches that fail, and other written forms of the same
four kinds, are candidates beside them. Six labelers vote 1, 0 or nothing on each: two by pattern (form, validity), one
by gazetteer, two by context (words before, characters around), one by company (other data in the text). The counts of
vote patterns of all documents, at most KINDS x 3^6, give the labelers' reliabilities by expectation-maximisation; its
posteriors train a linear span classifier over votes and hashed shapes. A candidate outside the base is added if its
form, its validity and the words before it speak for it, it meets no base span, and the classifier finds it likelier than not.

Texts are read in one pass of each pattern; spans alone are kept and shuffled. Patterns are linear: a run of letters is
tried from its start only, and no group is taken back. Offsets are code points.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import texts, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "validity", "gazetteer", "words", "edges", "company")
BLOCK, BEFORE, SHAPES = 256, 40, 64
PRIOR, ROUNDS, EPOCHS, RATE, SHRINK = 20.0, 50, 60, 0.5, 0.01
OWN_MARK = r"[\[({](?i:at|dot|\.)[\])}]|^(?:[0-9A-Fa-f]{1,4}:){7}"

# The patterns of the base. Possessive and looking behind, they match what the plain ones do, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Other written forms.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?: ?[\[({](?i:at)[\])}] ?| (?i:at) )[A-Za-z0-9-]++(?:(?: ?[\[({](?i:dot)[\])}] ?| (?i:dot) |\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{3,6}(?:(?:  |[._/])[0-9]{2,7}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[ .-]?[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
# Gazetteers. Top-level domains; card issuers' first digits; calling codes; words before each kind, and words that speak against it.
DOMAINS = "com org net edu gov mil int info biz io ai app dev me tv eu de fr es it pt nl be ch at dk se no fi pl cz sk hu ro bg gr tr ru ua uk ie us ca mx br ar cl co pe au nz jp cn kr in za".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[04-9]|6)"
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[05678][0-9]|9[679][0-9])"
LOCAL = r"^(?:0|10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[345][0-9])\."
CUES = {
    "email": r"e-?mail|mail|contact|write|reach|correo|courriel|kontakt|escrib|[eé]cri|schreib",
    "ip": r"\bip\b|address|host|server|login|logged|from|client|adresse|direcci",
    "card": r"card|visa|mastercard|amex|credit|debit|pay|carte|tarjeta|karte",
    "phone": r"phone|tel|call|fax|mobile|cell|ring|whatsapp|appel|llam|anruf|telefon|t[eé]l",
}
AGAINST = r"version|release|isbn|issn|doi|order|invoice|ticket|serial|section|chapter|page|part no|date"
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
HIT = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string,shape:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(array: Column) -> Column:
    """Runs of BLOCK elements of an array that is not empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK)))


def hits(text: Column, pattern: str) -> Column:
    """All matches with their places, the last characters before and the first one after, in linear time (blocks keep arrays that grow short)."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    ended = lambda z: F.slice(F.zip_with(z, F.slice(z, F.lit(2), F.size(z)), lambda x, y: F.struct(x["p"].alias("p"), x["h"].alias("h"), F.substring(y["p"], 1, 1).alias("next"))), F.lit(1), F.size(z) - 1)

    def hit(at: Column, x: Column) -> Column:
        start = at + F.length(x["p"])
        return F.struct(start.alias("start"), (start + F.length(x["h"])).alias("end"), x["h"].alias("text"), F.right(x["p"], F.lit(BEFORE)).alias("before"), x["next"].alias("after"))

    def step(acc: Column, x: Column) -> Column:
        return let(hit(acc["at"], x), lambda h: F.struct(h["end"].alias("at"), F.concat(acc["out"], F.array(h)).alias("out")))

    none = F.array().cast(HIT)

    def of_block(acc: Column, block: Column) -> Column:
        whole = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(whole, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{HIT}>").alias("outs"))
    found = let(let(pairs, ended), lambda z: F.flatten(F.aggregate(in_blocks(z), start, of_block)["outs"]))
    return F.when(text.rlike(pattern), found).otherwise(none)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def plain_form(kind: str, x: Column) -> Column:
    """The written form without what hides it: an email with @ and dots, an address with dots, digits of others."""
    if kind == "email":
        x = F.regexp_replace(x, r" ?[\[({](?i:at)[\])}] ?| (?i:at) ", "@")
        return F.regexp_replace(x, r" ?[\[({](?i:dot)[\])}] ?| (?i:dot) ", ".")
    return F.regexp_replace(x, r"[\[\]()]", "") if kind == "ip" else digits(x)


def passes(kind: str, x: Column) -> Column:
    """Whether a match of the base pattern is one of the base."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    n = F.length(digits(x))
    return n.between(10, 15) if kind == "phone" else n.between(14, 19) & F.call_function("luhn_check", digits(x))


def votes(kind: str, base_form: bool, hit: Column, company: Column) -> Column:
    """One letter a labeler: 1, 0 or - (no vote)."""
    x = plain_form(kind, hit["text"])
    of = lambda c: F.when(c, "1").otherwise("0")
    if kind == "email":
        form, valid = x.rlike(r"^[^@]++@[^@]*\.[A-Za-z]{2,}$"), ~x.rlike(r"^\.|\.@|\.\.|^[^@]{65,}@|@-|-\.")
        listed = of(F.lower(F.substring_index(x, ".", -1)).isin(DOMAINS))
    elif kind == "ip":
        dotted = x.rlike(r"^[0-9.]+$")
        form, valid = ~dotted | x.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), ~x.rlike(r"^(?:0+\.){3}0+$|\.\.|^[0-9]{4,}\.")
        listed = F.when(~dotted, "-").otherwise(of(~x.rlike(LOCAL)))
    elif kind == "card":
        form, valid = F.length(x).between(14, 19), F.call_function("luhn_check", x) & ~x.rlike(r"^([0-9])\1*$")
        listed = of(x.rlike(ISSUERS))
    else:
        form, valid = F.length(x).between(10, 15), ~x.rlike(r"^([0-9])\1*$")
        abroad = hit["text"].rlike(r"^(?:\+|00)")
        listed = F.when(abroad, of(F.regexp_replace(x, "^00", "").rlike(CALLING))).otherwise("-")
    against, cue = hit["before"].rlike(rf"(?i){AGAINST}"), hit["before"].rlike(f"(?i){CUES[kind]}")
    said = F.when(against, "0").when(cue | hit["text"].rlike(OWN_MARK), "1").otherwise("-" if base_form else "0")  # a form without marks of its own needs a word
    inside = F.right(hit["before"], F.lit(2)).rlike(r"[\p{L}\p{N}_/=#$@]$|[0-9][.:/-]$") | hit["after"].rlike(r"[\p{L}\p{N}_@]")
    return F.concat(of(form), of(valid), listed, said, of(~inside), F.when(company, "1").otherwise("-"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (SPAN: base ones and candidates with their votes, by kind and place) of every row."""
    rows = texts(docs, id_col, text_col)
    text = F.col("text")
    rows = rows.select("doc_id", *(hits(text, p).alias(f"{name}_{k}") for name, by in (("base", BASE), ("wide", WIDE)) for k, p in by.items()))

    def checked(k: str) -> Column:
        return F.transform(f"base_{k}", lambda h: F.struct(h.alias("h"), passes(k, h["text"]).alias("ok")))

    rows = rows.select("doc_id", *(checked(k).alias(f"base_{k}") for k in KINDS), *(f"wide_{k}" for k in KINDS))
    count = sum((F.size(F.filter(f"base_{k}", lambda x: x["ok"])) for k in KINDS), F.lit(0))
    taken = F.concat(*(F.transform(F.filter(f"base_{k}", lambda x: x["ok"]), lambda x: F.struct(x["h"]["start"].alias("start"), x["h"]["end"].alias("end"))) for k in KINDS))
    blocks = F.when(count > 0, let(F.array_sort(taken), lambda t: F.transform(in_blocks(t), lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("spans")))))
    rows = rows.withColumns({"n": count, "blocks": blocks})

    def free(h: Column) -> Column:
        meets = lambda s: (s["start"] < h["end"]) & (h["start"] < s["end"])
        return ~F.exists(F.coalesce("blocks", F.array().cast("array<struct<low:int,high:int,spans:array<struct<start:int,end:int>>>>")), lambda b: (b["low"] < h["end"]) & (h["start"] < b["high"]) & F.exists(b["spans"], meets))

    def span(i: int, h: Column, base: Column, base_form: bool, others: Column) -> Column:
        shape = F.regexp_replace(F.regexp_replace(h["text"], "[0-9]+", "9"), "[A-Za-z]+", "a")
        return F.struct(F.lit(i).alias("kind"), h["start"].alias("start"), h["end"].alias("end"), base.alias("base"), votes(KINDS[i], base_form, h, others > 0).alias("votes"), F.pmod(F.xxhash64(shape), F.lit(SHAPES)).cast("int").alias("shape"))

    def of_kind(i: int, k: str) -> list[Column]:
        based = F.transform(F.filter(f"base_{k}", lambda x: x["ok"] | free(x["h"])), lambda x: span(i, x["h"], x["ok"], True, F.col("n") - x["ok"].cast("int")))
        return [based, F.transform(F.filter(f"wide_{k}", free), lambda h: span(i, h, F.lit(False), False, F.col("n")))]

    parts = [c for i, k in enumerate(KINDS) for c in of_kind(i, k)]
    return rows.select("doc_id", F.concat(*parts).cast(SPAN).alias("spans"))


def reliabilities(counts: dict[str, float]) -> tuple[dict[str, float], list[tuple[float, float]], float]:
    """By expectation-maximisation over vote patterns of a kind: posteriors, each labeler's rate of votes for true and for false candidates, and the share of true ones. Votes not given tell nothing."""
    patterns, n = list(counts), len(LABELERS)
    rate, share = [(0.9, 0.3)] * n, 0.5
    given = {p: [(j, v == "1") for j, v in enumerate(p) if v != "-"] for p in patterns}
    post = {p: 0.05 if "0" in p[:2] else (sum(v for _, v in given[p]) + 0.5) / (len(given[p]) + 1) for p in patterns}
    for _ in range(ROUNDS):
        true = sum(counts[p] * post[p] for p in patterns)
        share = (true + 2) / (sum(counts.values()) + 4)
        sums = [[0.9 * PRIOR, PRIOR, 0.3 * PRIOR, PRIOR] for _ in range(n)]
        for p in patterns:
            for j, v in given[p]:
                for at, w in ((0, counts[p] * post[p]), (2, counts[p] * (1 - post[p]))):
                    sums[j][at] += w * v
                    sums[j][at + 1] += w
        rate = [(a / b, c / d) for a, b, c, d in sums]
        for p in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(rate[j][0] / rate[j][1] if v else (1 - rate[j][0]) / (1 - rate[j][1])) for j, v in given[p])
            post[p] = 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))
    return post, rate, share


def features(kind: int, pattern: str, shape: int) -> list[str]:
    return [f"{kind}", *(f"{kind}:{j}{v}" for j, v in enumerate(pattern)), f"{kind}:s{shape}"]


def trained(rows: list[tuple[list[str], float, float]]) -> dict[str, float]:
    """Weights of a logistic regression on (features, target, weight) rows, with rates by coordinate and shrinking weights."""
    w, g2 = defaultdict(float), defaultdict(lambda: 1e-3)
    for _ in range(EPOCHS):
        for x, y, n in rows:
            e = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[f] for f in x))))) - y
            for f in x:
                g = n * (e + SHRINK * w[f])
                g2[f] += g * g
                w[f] -= RATE * g / math.sqrt(g2[f])
    return dict(w)


def learn(spans: DataFrame) -> dict[str, float]:
    """The span classifier's weights, from the counts of all rows of ``marked``: at most KINDS x 3^6 x SHAPES of them, whatever the input."""
    s = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count()
    found = sorted((r.kind, r.votes, r.shape, float(r["count"])) for r in s.collect())
    by_kind: dict[int, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for kind, pattern, _, n in found:
        by_kind[kind][pattern] += n
    post = {kind: reliabilities(counts)[0] for kind, counts in by_kind.items()}
    return trained([(features(kind, pattern, shape), post[kind][pattern], math.log1p(n)) for kind, pattern, shape, n in found])


def find(spans: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """doc_id and spans (kind, start, end, base; by start and kind) of every row of ``marked``: the base and what the classifier adds."""
    table = F.create_map(*(F.lit(x) for item in sorted(weights.items()) for x in item)) if weights else F.lit(None).cast("map<string,double>")
    weight = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0.0))

    def likely(s: Column) -> Column:
        kind = s["kind"].cast("string")
        total = weight(kind) + weight(F.concat(kind, F.lit(":s"), s["shape"].cast("string")))
        for j in range(len(LABELERS)):
            total += weight(F.concat(kind, F.lit(f":{j}"), F.substring(s["votes"], j + 1, 1)))
        return 1 / (1 + F.exp(-total)) >= threshold

    kept = F.filter("spans", lambda s: s["base"] | (s["votes"].rlike("^11.1") & likely(s)))
    plain = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), (~s["base"]).alias("added")))
    names = F.array(*(F.lit(k) for k in KINDS))
    return spans.select("doc_id", F.transform(F.array_sort(plain), lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (~s["added"]).alias("base"))).alias("spans"))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row, learnt from all of them.

    Base spans are matches of BASE, leftmost and apart within a kind, that pass: address parts to 255, cards of 14 to 19
    digits with a right check digit, phones of 10 to 15 digits; spans of several kinds may overlap. Added ones (base
    false) meet no base span. Offsets are code points, the end exclusive. Null and empty texts have no spans; every row
    gives one row, repeated ones and null ids too; texts are read whole; without any candidate nothing is learnt or added.
    """
    spans = written(marked(docs, id_col, text_col), "private-spans")
    return find(spans, learn(spans))
