"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.demo import Frames

#: Date columns of the queries' results, by query.
DATES: dict[str, tuple[str, ...]] = {
    **dict.fromkeys("scoped_population issue_predicate issue_marker".split(), ("file_month",)),
    **dict.fromkeys("period_table snap_range".split(), ("first_month", "last_month")),
    **dict.fromkeys("entity_end rollup_stock all_grains period_rollup period_list cube_overlapping_groups select_range".split(), ("last_month",)),
    **dict.fromkeys("stock_by_month partition_counts subtype_counts grouping_sets_total grouping_sets_by_group union_total coverage_sum monthly_panel dense_grid monthly_base entity_that_ends continued_at_zero provisional_months trailing_12 era_running change_12 no_staff breakdown_t12 overlapping_groups group_share versions_pivot supersede_semi_join overwrite_idempotent gated_publish reissued_months partition_check row_set_diff month_gaps continuity_check issue_balance_check refused_flows group_partition_check panel_basis_check sort_by_column reissue_marks stale_flags multisets_by_month differing_months issue_table_balance hierarchy_proof overlap_partition_check sort_nulls_last month_spine period_bridge era_assignment".split(), ("month",)),
    **dict.fromkeys("cube_core cube_core_by_group combine_entities combine_breakdown combine_breakdown_by_group cube_outflow_breakdown cube_outflow_breakdown_by_group cube_inflow_breakdown cube_inflow_breakdown_by_group".split(), ("first_month", "last_month")),
    "cube_era": ("month_0", "month_n"),
    **dict.fromkeys("yyyymm_to_month".split(), ("month", "checked")),
    **dict.fromkeys("period_keys".split(), ("month", "fy_first", "fy_last")),
    **dict.fromkeys("filename_parts manifest_periods".split(), ("period",)),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Frames`` under its name, with its SQL if SQL can express it.

    Dates leave as text on both sides, so that no client's date type matters.
    """

    def register(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Frames(spark, sf_dir))
            return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            dates = DATES.get(f.__name__, ())
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM (\n{sql}\n)" if dates else sql
        return f

    return register


from stockflow.queries import aggregates, algebra, cubes, files, quality, records, values  # noqa: E402, F401
