"""Combination of entities planned from a stored cube's own columns.

Each column of a cube says in its field's metadata how it may be combined; Spark writes that into the Parquet file and
reads it back, so a plan needs the file alone. Kinds:

entity, key: what is combined, and what rows are combined by; stock, flow, stock_change: added, NULL if any is; flag,
all: ORed, ANDed; first, last, most: smallest, latest, largest; same: kept if equal, else NULL; numerator (of a
denominator): added where the denominator is there, a row without stock adding nothing; denominator: added; small (of a
denominator): made anew; ratio (num, den, least): made anew from its parts, NULL on a smaller base; coverage, known (of,
unless, within): made anew over the rows that share the keys ``within``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockflow.operators.base import TOTAL
from stockflow.operators.rollup import SMALL

ADDED = ("stock", "flow", "stock_change")
SUMMED_AT_ONCE = {"flag": F.bool_or, "all": F.bool_and, "first": F.min, "last": F.max, "most": F.max, "denominator": F.sum}
MADE_ANEW = ("small", "ratio", "coverage", "known")

Dictionary = dict[str, dict]


def kinds(kind: str, *names: str, **more) -> Dictionary:
    """The same entry for several columns."""
    return {name: {"kind": kind, **more} for name in names}


def rates(name: str, numerators: list[str]) -> Dictionary:
    """Entries of the rates of one method: numerators, their denominator, its months and its small-base flag."""
    den = f"rate_{name}_den"
    return kinds("numerator", *(f"rate_{r}_{name}_num" for r in numerators), of=den) | kinds("denominator", den) | kinds("most", f"rate_{name}_months") | kinds("small", f"rate_{name}_small", of=den)


def described(cube: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``cube`` with the dictionary in its fields' metadata; a column that it lacks is refused."""
    if missing := [c for c in cube.columns if c not in dictionary]:
        raise ValueError(f"no kind for {', '.join(missing)}")
    return cube.select(*(F.col(c).alias(c, metadata=dictionary[c]) for c in cube.columns))


def dictionary_of(schema: StructType) -> Dictionary:
    """The dictionary that a schema carries."""
    return {f.name: dict(f.metadata) for f in schema.fields if "kind" in f.metadata}


@dataclass(frozen=True)
class Plan:
    """How rows of a cube combine: keys, aggregates by name, and columns that are made anew from these, in the cube's order."""

    entity: str
    keys: list[str]
    sums: dict[str, Column]
    anew: dict[str, Column]
    order: list[str]


def plan(schema: StructType) -> Plan:
    """The plan that a schema's kinds make; a column without a kind, or with parts that the schema lacks, is refused."""
    d = dictionary_of(schema)
    if missing := [f.name for f in schema.fields if f.name not in d]:
        raise ValueError(f"no kind for {', '.join(missing)}")
    for name, x in d.items():
        if lost := [x[p] for p in ("of", "num", "den", "unless", "only") if x.get(p) and x[p] not in d]:
            raise ValueError(f"{name} is made from {', '.join(lost)}, which the cube lacks")
    (entity,) = [c for c, x in d.items() if x["kind"] == "entity"] or [None]
    if entity is None:
        raise ValueError("the cube has no entities")
    keys = [c for c, x in d.items() if x["kind"] == "key"]
    sums, anew = {}, {}
    for c, x in d.items():
        kind = x["kind"]
        if kind in ADDED:
            sums[c] = F.when(F.count("*") == F.count(c), F.sum(c))
        elif kind in SUMMED_AT_ONCE:
            sums[c] = SUMMED_AT_ONCE[kind](c)
        elif kind == "same":
            sums[c] = F.when(F.min(c) == F.max(c), F.max(c))
        elif kind == "numerator":
            sums[c] = F.sum(F.when(F.col(x["of"]).isNotNull(), F.col(c)))
        elif kind == "small":
            anew[c] = F.col(x["of"]) < SMALL
        elif kind == "ratio":
            ratio = F.round(F.try_divide(x["num"], x["den"]), 4)
            anew[c] = F.when(F.col(x["den"]) >= x["least"], ratio) if x.get("least") else ratio
        elif kind in ("coverage", "known"):
            w = Window.partitionBy(*(k for k in keys if k in x["within"]))
            known = F.sum(F.when(~F.col(x["unless"]), F.col(x["of"])).otherwise(0)).over(w)
            anew[c] = F.round(F.try_divide(known, F.sum(x["of"]).over(w)), 4) if kind == "coverage" else F.when(F.col(x["only"]), F.nullif(known, F.lit(0)))
        elif kind not in ("entity", "key"):
            raise ValueError(f"{c} has an unknown kind, {kind}")
    return Plan(entity, keys, sums, anew, [c for c in d if c != entity])


def combine(cube: DataFrame, entities: list[str], whole: bool = False) -> DataFrame:
    """The rows of several entities as one for each key, by the cube's own kinds; the dictionary stays with the result.

    The total beside its parts and a repeated entity are refused. ``entities`` of the result is how many of them a row
    has: some end sooner than others; with ``whole``, rows that lack one are left out. Where an entity has two rows of
    one key, what is added is NULL.
    """
    if TOTAL in entities and len(entities) > 1:
        raise ValueError("the total holds the others")
    if len(set(entities)) < len(entities):
        raise ValueError("an entity is listed twice")
    p, d = plan(cube.schema), dictionary_of(cube.schema)
    once = F.count("*") == F.size(F.collect_set(p.entity))
    sums = {c: F.when(once, s) if d[c]["kind"] in (*ADDED, "numerator", "denominator") else s for c, s in p.sums.items()}
    out = cube.where(F.col(p.entity).isin(entities)).groupBy(*p.keys).agg(*(s.alias(c) for c, s in sums.items()), F.size(F.collect_set(p.entity)).alias("entities"))
    if whole:
        out = out.where(F.col("entities") == len(entities))
    out = out.select("*", *(a.alias(c) for c, a in p.anew.items()))
    return out.select(*(F.col(c).alias(c, metadata=d[c]) for c in p.order), "entities")


def route(cube: DataFrame, entities: list[str]) -> DataFrame:
    """What a selection shows: none the total's rows, one its own rows, several their combination; all with the same columns."""
    if len(entities) > 1:
        return combine(cube, entities)
    p = plan(cube.schema)
    own = cube.where(F.col(p.entity) == (entities[0] if entities else TOTAL))
    return own.select(*p.order, F.lit(1).alias("entities"))
