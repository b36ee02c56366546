"""Typing that keeps redactions apart, and declarative value rules that become one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, UNMAPPED = "Unknown", "__unmapped__"


def typed(column: Column, kind: str, mark: str = "REDACTED") -> Column:
    """The value as ``kind``; redacted and unreadable text is NULL."""
    return F.nullif(column, F.lit(mark)).try_cast(kind)


def redacted(column: Column, mark: str = "REDACTED") -> Column:
    return F.coalesce(column == mark, F.lit(False))


def yyyymm(column: Column) -> Column:
    return F.try_to_date(column, "yyyyMM")


def scope(month: Column, since: str, new: Column, old: Column, wanted: str) -> Column:
    """Whether a row is of the population: by the new code from a month on, by the old one before."""
    return F.coalesce(F.when(month >= F.lit(since).cast("date"), new).otherwise(old) == wanted, F.lit(False))


def group_or_other(code: Column, listed: list[str], other: str = "other") -> Column:
    return F.when(F.trim(F.coalesce(code, F.lit(""))).isin(listed), F.trim(code)).otherwise(other)


@dataclass(frozen=True)
class Issue:
    """Values from ``low`` to ``high`` in files of these months are not known."""

    first: str
    last: str
    low: float
    high: float

    def hits(self, file_month: Column, value: Column) -> Column:
        inside = file_month.between(F.lit(self.first).cast("date"), F.lit(self.last).cast("date")) & value.between(self.low, self.high)
        return F.coalesce(inside, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """One value of a dimension. kind: range, codes, rest, unknown, plan_grade, prefix, null or unknown_rest."""

    value: str
    kind: str
    low: float | None = None
    high: float | None = None
    codes: tuple[str, ...] = ()


def assigned(rules: list[Rule], field: Column, grade: Column | None = None, issue: Column | None = None) -> Column:
    """The value of each row by the rules: unknown first, then the others in order, then rest, else ``__unmapped__``."""

    def holds(r: Rule) -> Column:
        if r.kind == "unknown":
            out = field.isNull() | (F.trim(field.cast("string")) == "") | F.trim(field.cast("string")).isin(list(r.codes))
            return out if issue is None else out | issue
        if r.kind == "range":
            inside = field >= r.low
            return inside if r.high is None else inside & (field < r.high)
        if r.kind == "codes":
            return F.trim(field).isin(list(r.codes))
        if r.kind == "plan_grade":
            number = grade.try_cast("int")
            return F.trim(field).isin(list(r.codes)) & (number >= r.low) & (number < r.high)
        if r.kind == "prefix":
            starts = [F.trim(field).startswith(c) for c in r.codes]
            out = starts[0]
            for s in starts[1:]:
                out = out | s
            return out
        if r.kind == "null":
            return field.isNull()
        if r.kind == "rest":
            return field.isNotNull()
        if r.kind == "unknown_rest":
            return F.lit(True)
        raise ValueError(f"unknown rule kind {r.kind}")

    order = {"unknown": 0, "rest": 2, "unknown_rest": 3}
    ordered = sorted(rules, key=lambda r: order.get(r.kind, 1))
    out = None
    for r in ordered:
        condition = F.coalesce(holds(r), F.lit(False))
        out = F.when(condition, r.value) if out is None else out.when(condition, r.value)
    return out.otherwise(UNMAPPED)
