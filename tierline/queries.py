"""Registered queries: every model and report of the warehouse.

``MODEL_QUERIES[name](warehouse)`` works on any warehouse (original raw
tables or the test-data adapter, lazy or stored).  ``QUERIES[name](spark,
sf_dir)`` runs it over the driver's test tables through the adapter in
``tierline.sources.testdata``; every query works on whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.operators.joins import balanced_left_join
from tierline.operators.quality import orphans
from tierline.plans import build, dimensions, explore, fact, kpis, quality, rollups, views, windows
from tierline.plans.warehouse import Params, Warehouse
from tierline.sources import testdata
from tierline.sources.testdata import PROFILE, TestdataProfile

Query = Callable[[SparkSession, str], DataFrame]


def testdata_params(profile: TestdataProfile = PROFILE) -> Params:
    return Params(
        current_year=profile.current_year,
        previous_year=profile.previous_year,
        large_at=profile.large_at,
        medium_at=profile.medium_at,
        z_threshold=profile.z_threshold,
        expected_years=profile.expected_years,
    )


def testdata_warehouse(spark: SparkSession, sf_dir: str, profile: TestdataProfile = PROFILE) -> Warehouse:
    names, regions = testdata.region_lookups(spark, sf_dir)
    return Warehouse(
        spark,
        testdata.raw_sources(spark, sf_dir),
        testdata_params(profile),
        state_names=names,
        state_regions=regions,
    )


def _cur_in(wh: Warehouse) -> DataFrame:
    return wh.raw.profiled("inpatient", wh.params.current_year)


def _cur_out(wh: Warehouse) -> DataFrame:
    return wh.raw.profiled("outpatient", wh.params.current_year)


def _phys(wh: Warehouse) -> DataFrame:
    return wh.raw.profiled("physicians", wh.params.previous_year)


def _p(wh: Warehouse) -> Params:
    return wh.params


MODEL_QUERIES: dict[str, Callable[[Warehouse], DataFrame]] = {
    # 01 exploration of the raw sources
    "explore_row_counts": lambda w: explore.explore_row_counts(w.raw),
    "explore_sample_inpatient": lambda w: explore.explore_sample(_cur_in(w), _p(w).sample_rows, ordered=True),
    "explore_sample_outpatient": lambda w: explore.explore_sample(_cur_out(w), _p(w).sample_rows, ordered=True),
    "explore_sample_physicians": lambda w: explore.explore_sample(_phys(w), _p(w).sample_rows, ordered=True),
    "explore_nulls_inpatient": lambda w: explore.explore_nulls_inpatient(_cur_in(w)),
    "explore_nulls_outpatient": lambda w: explore.explore_nulls_outpatient(_cur_out(w)),
    "explore_cardinality": lambda w: explore.explore_cardinality(_cur_in(w)),
    "explore_distribution": lambda w: explore.explore_distribution(_cur_in(w)),
    "explore_distribution_approx": lambda w: explore.explore_distribution_approx_check(_cur_in(w)),
    "explore_top_states": lambda w: explore.explore_top_states(_cur_in(w), _p(w).top_explore),
    "explore_top_drgs": lambda w: explore.explore_top_drgs(_cur_in(w), _p(w).top_explore),
    "explore_year_availability": lambda w: explore.explore_year_availability(w.raw),
    # 02 staging
    "stg_inpatient": lambda w: w.model("stg_inpatient_charges"),
    "stg_outpatient": lambda w: w.model("stg_outpatient_charges"),
    "stg_physicians": lambda w: w.model("stg_physicians"),
    # 03 intermediate
    "int_provider_inpatient": lambda w: w.model("int_provider_inpatient_summary"),
    "int_provider_outpatient": lambda w: w.model("int_provider_outpatient_summary"),
    "int_physician_summary": lambda w: w.model("int_physician_summary"),
    "int_state_metrics": lambda w: w.model("int_state_metrics"),
    "int_provider_combined": lambda w: w.model("int_provider_combined"),
    # 04 dimensions
    "dim_provider": lambda w: w.model("dim_provider"),
    "dim_region": lambda w: w.model("dim_region"),
    "dim_date": lambda w: dimensions.dim_date_coverage(w.model("dim_date"), w.model("stg_inpatient_charges")),
    # 05 fact (the load timestamp differs per run, so it is left out here)
    "fact_metrics": lambda w: w.fact.drop("loaded_at"),
    "fact_load_stamp": lambda w: fact.fact_load_stamp(w.fact),
    "fact_verification": lambda w: fact.fact_verification(w.fact),
    # 06 KPIs
    "kpi_cost_by_state": lambda w: kpis.kpi_cost_by_state(w.fact, _p(w).current_year),
    "kpi_top_cost_providers": (
        lambda w: kpis.kpi_top_cost_providers(w.fact, _p(w).current_year, _p(w).top_providers)
    ),
    "kpi_cost_by_region": lambda w: kpis.kpi_cost_by_region(w.fact),
    "kpi_yoy_change": lambda w: kpis.kpi_yoy_change(w.fact, _p(w).current_year, _p(w).previous_year),
    "kpi_volume_tiers": lambda w: kpis.kpi_volume_tiers(w.fact),
    "kpi_cost_mix": lambda w: kpis.kpi_cost_mix(w.fact),
    "kpi_coverage_efficiency": lambda w: kpis.kpi_coverage_efficiency(w.fact, _p(w).current_year),
    # 06 reporting views
    "vw_cost_by_state": lambda w: views.vw_cost_by_state(w.fact),
    "vw_provider_details": lambda w: views.vw_provider_details(w.fact),
    "vw_yoy_change": (
        lambda w: views.vw_yoy_change(w.fact, _p(w).current_year, _p(w).previous_year, _p(w).trend_pct)
    ),
    "vw_region_summary": lambda w: views.vw_region_summary(w.fact),
    "vw_size_category": lambda w: views.vw_size_category(w.fact),
    # 07 window analytics
    "win_rank_topn": lambda w: windows.win_rank_topn(w.fact, _p(w).current_year, _p(w).top_rank),
    "win_lag_lead": lambda w: windows.win_lag_lead(w.fact),
    "win_rolling_avg": lambda w: windows.win_rolling_avg(w.fact),
    "win_ntile": lambda w: windows.win_ntile(w.fact, _p(w).current_year, _p(w).quartiles, _p(w).deciles),
    "win_percentiles": lambda w: windows.win_percentiles(w.fact, _p(w).current_year, _p(w).top_percentiles),
    "win_vs_group_avg": lambda w: windows.win_vs_group_avg(w.fact, _p(w).current_year),
    "win_cumulative_share": lambda w: windows.win_cumulative_share(w.fact),
    "win_running_volume": lambda w: windows.win_running_volume(w.fact),
    # mergeable states: quantiles and distinct counts of any union of years and states
    "rollup_quantiles": lambda w: _quantiles(w.model("stg_inpatient_charges")),
    "rollup_distinct": lambda w: rollups.rollup_distinct(rollups.build(w.model("stg_inpatient_charges")), w.model("dim_region")),
    # J1 / J2 over staged rows, where one provider may hold any share of them
    "join_staged_providers": lambda w: _staged_by_size(w.model("stg_inpatient_charges"), w.model("dim_provider")),
    # 08 data quality
    "dq_nulls": (
        lambda w: quality.dq_nulls(
            w.model("stg_inpatient_charges"), w.model("stg_outpatient_charges"), w.model("stg_physicians")
        )
    ),
    "dq_duplicates_fact": lambda w: quality.dq_duplicates_fact(w.fact),
    "dq_duplicates_provider": lambda w: quality.dq_duplicates_provider(w.model("dim_provider")),
    "dq_duplicates_region": lambda w: quality.dq_duplicates_region(w.model("dim_region")),
    "dq_orphans_provider": lambda w: quality.dq_orphans_provider(w.fact, w.model("dim_provider")),
    "dq_orphans_region": lambda w: quality.dq_orphans_region(w.fact, w.model("dim_region")),
    "dq_outliers_zscore": (
        lambda w: quality.dq_outliers_zscore(w.fact, _p(w).current_year, _p(w).z_threshold)
    ),
    "dq_health_report": (
        lambda w: quality.dq_health_report(
            w.fact, w.model("dim_provider"), w.model("dim_region"), _p(w).min_states, _p(w).expected_years
        )
    ),
    # README run order: build 02 -> 05, one stored table per model
    "warehouse_build": lambda w: build.table_row_counts(build.materialise(w)),
}


def _quantiles(staged: DataFrame) -> DataFrame:
    """Boundaries merged from stored sketches, against the ranks of the rows."""
    return rollups.boundary_check(staged, rollups.build(staged).payments)


def _staged_by_size(staged: DataFrame, providers: DataFrame) -> DataFrame:
    """Staged rows with their provider's size class, by class and year."""
    sizes = providers.select("provider_id", "provider_size_category")
    joined = balanced_left_join(staged.select("provider_id", "data_year", "total_discharges"), sizes, ["provider_id"])
    return joined.groupBy("provider_size_category", F.col("data_year").alias("year")).agg(
        F.count(F.lit(1)).alias("staged_rows"), F.sum("total_discharges").alias("discharges")
    )


def _over_testdata(fn: Callable[[Warehouse], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(testdata_warehouse(spark, sf_dir))

    return run


def _order_line_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uniqueness check on the raw order lines' natural key, which the
    driver tables do repeat (the warehouse keys never repeat there)."""
    lines = testdata.read_tables(spark, sf_dir)["lineitem"]
    return quality.dq_duplicates_keys(lines, ["l_orderkey", "l_linenumber"])


def _orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The referential-integrity check on orders, some of which have no line."""
    t = testdata.read_tables(spark, sf_dir)
    return orphans(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey").select("o_orderkey", "o_orderpriority")


QUERIES: dict[str, Query] = {key: _over_testdata(fn) for key, fn in MODEL_QUERIES.items()}
QUERIES["dq_duplicates_order_lines"] = _order_line_duplicates
# the warehouse's own keys are clean on the driver tables; the same checks on whole tables that do violate them
QUERIES["dq_duplicates_supplier_nations"] = lambda spark, sf_dir: quality.dq_duplicates_keys(
    testdata.read_tables(spark, sf_dir)["supplier"], ["s_nationkey"]
)
QUERIES["dq_duplicates_customer_days"] = lambda spark, sf_dir: quality.dq_duplicates_keys(
    testdata.read_tables(spark, sf_dir)["orders"], ["o_custkey", "o_orderdate"]
)
QUERIES["dq_orphans_orders"] = _orders_without_lines
QUERIES["dq_orphans_order_priorities"] = lambda spark, sf_dir: (
    _orders_without_lines(spark, sf_dir).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("unmatched_rows"))
)

FLAGSHIP = "kpi_cost_by_state"

__all__ = ["QUERIES", "MODEL_QUERIES", "FLAGSHIP", "testdata_warehouse", "testdata_params"]
