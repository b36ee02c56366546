"""Monthly counts by entity with totals, on a dense grid.

The frames: stock (month, entity, member, group_code), inflow (effective_month, entity, code, group_code) and outflow
(effective_month, file_month, entity, code, overlay, years, group_code). Row-level data is shuffled once, to counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTAL = "ALL"


def _and_total(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by month and entity (and keys), and their sums over the entities for the total."""
    measures = [c for c in counts.columns if c not in ("month", "entity", *keys)]
    sets = [["month", "entity", *keys], ["month", *keys]]
    out = counts.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in sets[0])).agg(F.grouping("entity").alias("_total"), *(F.sum(c).alias(c) for c in measures))
    return out.withColumn("entity", F.when(F.col("_total") == 1, TOTAL).otherwise(F.col("entity"))).drop("_total")


def with_total(df: DataFrame, month: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates that add up (counts, sums) by month and entity (and keys), and by month (and keys) for the total, which comes from the counts: a row is counted once."""
    return _and_total(df.groupBy(F.col(month).alias("month"), "entity", *keys).agg(*aggregates), keys)


def counted(parts: list[tuple[DataFrame, str, list[Column]]], keys: list[str]) -> DataFrame:
    """The counts of several frames, each (rows, month column, aggregates that add up), beside each other by month and entity (and keys), totals included; 0 where a frame has none."""
    each = [rows.groupBy(F.col(month).alias("month"), "entity", *keys).agg(*aggregates) for rows, month, aggregates in parts]
    out = each[0]
    for n in each[1:]:
        out = out.unionByName(n, allowMissingColumns=True)
    return filled(_and_total(out, keys), ["month", "entity", *keys])


def categories(code: str, codes: list[str], prefix: str) -> list[Column]:
    """One count for each code."""
    return [F.count_if(F.col(code) == c).alias(f"{prefix}_{c.lower()}") for c in codes]


def flow_counts(codes: list[str]) -> list[Column]:
    """Outflow, its categories, the overlay across them, and the categories without the overlay."""
    overlay = F.col("overlay").eqNullSafe("Y")
    plain = [F.count_if((F.col("code") == c) & ~overlay).alias(f"plain_{c.lower()}") for c in codes]
    return [F.count("*").alias("outflow"), *categories("code", codes, "out"), F.count_if(overlay).alias("overlay"), *plain]


def measured(value: str, issue: Column) -> list[Column]:
    """Sum and number of known values without issue ones, and the number of these."""
    known = F.when(~issue, F.col(value))
    return [F.sum(known).alias("years_sum"), F.count(known).alias("years_known"), F.count_if(issue).alias("years_issue")]


def months_of(stock: DataFrame) -> DataFrame:
    return stock.select("month").distinct()


def grid(stock: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """entity x month (x keys), the total included: both sides are small dimensions. ``stock`` may be any rows that have all entities and months, so that the stock need not be worked out for them."""
    entities = stock.select("entity").distinct().unionByName(stock.sparkSession.createDataFrame([(TOTAL,)], "entity string"))
    out = entities.crossJoin(months_of(stock))
    return out if keys is None else out.crossJoin(keys)


def filled(df: DataFrame, keys: list[str]) -> DataFrame:
    """0 for absent counts; only valid on a grid."""
    return df.select(*keys, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in df.columns if c not in keys))


def dense(counts: DataFrame, pair: list[str], months: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """``counts`` (month, ``pair``, columns of ``values``, measures) on a grid that is sparse in ``pair``: each pair that occurs, by all months and all rows of ``values``, 0 where there is nothing.

    Months and values are dimensions (calendar and configuration), so a pair's cells are a short array that is filled up
    where it lies: no product of pairs is made, nothing is joined with the counts, and they are worked out once. Months
    and values that the dimensions lack are left out.
    """
    within = values.columns if values is not None else []
    measures = [c for c in counts.columns if c not in ("month", *pair, *within)]
    cells = counts.groupBy(*pair, *within).agg(F.collect_list(F.struct("month", *(F.col(c).cast("long").alias(c) for c in measures))).alias("_cells"))
    if values is not None:
        name = lambda x: F.concat_ws("\0", *(x[c] for c in within))
        listed = values.agg(F.collect_set(F.struct(*within)).alias("_listed"))
        found = cells.where(F.concat(*within).isNotNull()).groupBy(*pair).agg(F.collect_list(F.struct(*within, "_cells")).alias("_found")).crossJoin(F.broadcast(listed))
        none = F.array().cast(cells.schema["_cells"].dataType)
        known = F.filter("_found", lambda x: F.array_contains(F.transform("_listed", name), name(x)))
        absent = F.filter("_listed", lambda v: ~F.array_contains(F.transform("_found", name), name(v)))
        all_ = F.concat(known, F.transform(absent, lambda v: F.struct(*(v[c].alias(c) for c in within), none.alias("_cells"))))
        cells = found.select(*pair, F.inline(all_))
    calendar = months.agg(F.collect_set("month").alias("_months"))
    there = F.transform("_cells", lambda c: c["month"])
    zeros = F.transform(F.array_except("_months", there), lambda m: F.struct(m.alias("month"), *(F.lit(0).cast("long").alias(c) for c in measures)))
    inside = F.filter("_cells", lambda c: F.array_contains("_months", c["month"]))
    return cells.crossJoin(F.broadcast(calendar)).select(*pair, *within, F.inline(F.concat(inside, zeros)))


def monthly_base(stock: DataFrame, inflow: DataFrame, outflow: DataFrame, codes: list[str], issue: Column, by: list[str] | None = None, months: DataFrame | None = None) -> DataFrame:
    """Per entity (and keys) that occurs and month: stock, flows, categories and measured values, 0 where there is nothing. ``months`` are those of the stock, if something else than the stock has them sooner."""
    by = by or []
    n = counted([(stock, "month", [F.count("*").alias("stock")]), (inflow, "effective_month", [F.count("*").alias("inflow")]), (outflow, "effective_month", [*flow_counts(codes), *measured("years", issue)])], by)
    base = dense(n, ["entity", *by], months_of(stock) if months is None else months)
    return base.select("entity", "month", *by, *(c for c in base.columns if c not in ("entity", "month", *by)))


def provisional(months: DataFrame, newest: int = 3) -> DataFrame:
    """month, provisional: the newest ones. The window is over the month dimension, a few hundred rows."""
    return months.select("month", (F.row_number().over(Window.orderBy(F.desc("month"))) <= newest).alias("provisional"))


def entity_ends(base: DataFrame) -> DataFrame:
    """entity, last_month with any stock."""
    return base.groupBy("entity").agg(F.max(F.when(F.col("stock") > 0, F.col("month"))).alias("last_month"))


def within_life(base: DataFrame, go_on: list[str] | None = None) -> DataFrame:
    """Rows up to each entity's last stock month; listed entities go on at 0."""
    ends = entity_ends(base)
    return base.join(ends, "entity").where((F.col("month") <= F.col("last_month")) | F.col("entity").isin(go_on or [])).drop("last_month")


def all_groups(by_group: DataFrame, group: str, whole: str = "all") -> DataFrame:
    """Rows of each (entity, group) that ever has a stock or a flow, and of group ``whole``: their sums, in the same pass over the counts."""
    keys = ["entity", "month", group]
    measures = [c for c in by_group.columns if c not in keys]
    sets = [[F.col(c) for c in keys], [F.col(c) for c in keys[:2]]]
    out = by_group.groupingSets(sets, *(F.col(c) for c in keys)).agg(F.grouping(group).alias("_all"), *(F.sum(c).alias(c) for c in measures))
    out = out.withColumn(group, F.when(F.col("_all") == 1, whole).otherwise(F.col(group))).drop("_all")
    some = F.max(F.greatest("stock", "inflow", "outflow")).over(Window.partitionBy("entity", group))
    return out.withColumn("_some", some).where("_some > 0").drop("_some")


def alive(base: DataFrame, go_on: list[str] | None = None) -> DataFrame:
    """``base`` (of one or more keys beside entity and month) up to each entity's last month with any stock; listed entities go on."""
    last = F.max(F.when(F.col("stock") > 0, F.col("month"))).over(Window.partitionBy("entity"))
    return base.withColumn("_last", last).where((F.col("month") <= F.col("_last")) | F.col("entity").isin(go_on or [])).drop("_last")


def refused_ends(base: DataFrame, go_on: dict[str, str] | None = None, flows: tuple[str, ...] = ("inflow", "outflow")) -> DataFrame:
    """entity, why: entities without any stock, with flows after their last month of stock, or configured to go on after another last month (entity -> yyyy-MM-dd) than the data has."""
    go_on = go_on or {}
    said = F.create_map(*(F.lit(x) for pair in go_on.items() for x in pair))[F.col("entity")] if go_on else F.lit(None).cast("string")
    ends = base.join(entity_ends(base), "entity").groupBy("entity", "last_month").agg(F.max(F.when(F.greatest(*flows) > 0, F.col("month"))).alias("last_flow"))
    why = (
        F.when(F.col("last_month").isNull(), "never in stock")
        .when(said.isNotNull() & (said.cast("date") != F.col("last_month")), "goes on after another month")
        .when(said.isNull() & (F.col("last_flow") > F.col("last_month")), "flows after its end")
    )
    return ends.select("entity", why.alias("why")).where("why IS NOT NULL")
