"""Stakeholder KPIs over the fact table.

Averages here are *unweighted means of provider-level values* (an average
of averages), as in the reference; the year filters reach the scan of a
stored fact as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.functions.metrics import mean_round, pct_change


def _avg(c: str, digits: int, name: str):
    return mean_round(c, digits).alias(name)


def kpi_cost_by_state(fact: DataFrame, year: int) -> DataFrame:
    """KPI 1: average inpatient cost by state (one year)."""
    return (
        fact.filter(F.col("year") == year)
        .groupBy("state_code", "census_region")
        .agg(
            F.count_distinct("provider_id").alias("provider_count"),
            F.sum("total_discharges").alias("total_discharges"),
            _avg("avg_inpatient_payment", 2, "avg_inpatient_cost"),
            _avg("avg_medicare_payments", 2, "avg_medicare_payment"),
            _avg("medicare_payment_ratio", 4, "avg_medicare_ratio"),
        )
        .orderBy(F.col("avg_inpatient_cost").desc_nulls_last(), "state_code")
    )


def kpi_top_cost_providers(fact: DataFrame, year: int, k: int = 20) -> DataFrame:
    """KPI 2: top-k providers by inpatient payment (TakeOrderedAndProject: per-task top-k,
    then a k-row merge).  Provider id breaks ties."""
    return (
        fact.filter(F.col("year") == year)
        .orderBy(F.col("avg_inpatient_payment").desc_nulls_last(), F.col("provider_id").asc_nulls_first())
        .limit(k)
        .select(
            "provider_id",
            "provider_name",
            "provider_city",
            "state_code",
            "provider_size_category",
            "total_discharges",
            F.round("avg_inpatient_payment", 2).alias("avg_inpatient_cost"),
            F.round("avg_medicare_payments", 2).alias("avg_medicare_cost"),
            F.round("combined_avg_cost", 2).alias("combined_cost"),
        )
    )


def kpi_cost_by_region(fact: DataFrame) -> DataFrame:
    """KPI 3: cost by census region and year."""
    return (
        fact.groupBy("census_region", "year")
        .agg(
            F.count_distinct("provider_id").alias("provider_count"),
            F.sum("total_patient_volume").alias("total_patient_volume"),
            _avg("avg_inpatient_payment", 2, "avg_inpatient_cost"),
            _avg("avg_outpatient_payment", 2, "avg_outpatient_cost"),
            _avg("combined_avg_cost", 2, "avg_combined_cost"),
            _avg("medicare_payment_ratio", 4, "avg_medicare_ratio"),
        )
        .orderBy("census_region", "year")
    )


def yearly_state_cost(fact: DataFrame, keys: tuple[str, ...] = ("state_code",), extra: bool = False) -> DataFrame:
    aggs = [_avg("avg_inpatient_payment", 2, "avg_cost")]
    if extra:
        aggs += [
            F.sum("total_discharges").alias("total_discharges"),
            F.count_distinct("provider_id").alias("provider_count"),
        ]
    return fact.groupBy(*keys, "year").agg(*aggs)


def kpi_yoy_change(fact: DataFrame, current_year: int, previous_year: int) -> DataFrame:
    """KPI 4: year-over-year cost change by state; states present in both
    years; ``avg_cost_<year>`` columns."""
    yearly = yearly_state_cost(fact)
    cur = yearly.filter(F.col("year") == current_year).alias("cur")
    prev = yearly.filter(F.col("year") == previous_year).alias("prev")
    joined = cur.join(prev, F.col("cur.state_code") == F.col("prev.state_code"))
    return joined.select(
        F.col("cur.state_code").alias("state_code"),
        F.col("prev.avg_cost").alias(f"avg_cost_{previous_year}"),
        F.col("cur.avg_cost").alias(f"avg_cost_{current_year}"),
        F.round(F.col("cur.avg_cost") - F.col("prev.avg_cost"), 2).alias("absolute_change"),
        F.round(pct_change("cur.avg_cost", "prev.avg_cost"), 2).alias("pct_change"),
    ).orderBy(F.col("pct_change").desc_nulls_last(), "state_code")


def kpi_volume_tiers(fact: DataFrame) -> DataFrame:
    """KPI 5: provider volume tiers (size class x year)."""
    return (
        fact.groupBy("provider_size_category", "year")
        .agg(
            F.count_distinct("provider_id").alias("provider_count"),
            _avg("total_discharges", 0, "avg_discharges"),
            _avg("avg_inpatient_payment", 2, "avg_inpatient_cost"),
            _avg("avg_medicare_payments", 2, "avg_medicare_cost"),
            _avg("medicare_payment_ratio", 4, "avg_medicare_ratio"),
            _avg("distinct_drg_count", 1, "avg_drg_complexity"),
        )
        .orderBy("year", F.col("avg_inpatient_cost").desc_nulls_last())
    )


def kpi_cost_mix(fact: DataFrame) -> DataFrame:
    """KPI 6: outpatient vs inpatient cost mix by state and year."""
    return (
        fact.groupBy("state_code", "year")
        .agg(
            _avg("avg_inpatient_payment", 2, "avg_inpatient_cost"),
            _avg("avg_outpatient_payment", 2, "avg_outpatient_cost"),
            _avg("outpatient_volume_share_pct", 2, "outpatient_pct_of_volume"),
            _avg("combined_avg_cost", 2, "combined_cost"),
        )
        .orderBy(F.col("outpatient_pct_of_volume").desc_nulls_last(), "state_code", "year")
    )


def kpi_coverage_efficiency(fact: DataFrame, year: int) -> DataFrame:
    """KPI 7: medicare coverage efficiency by state (one year)."""
    return (
        fact.filter(F.col("year") == year)
        .groupBy("state_code", "census_region")
        .agg(
            _avg("medicare_payment_ratio", 4, "avg_medicare_ratio"),
            _avg("avg_inpatient_payment", 2, "avg_inpatient_cost"),
            _avg("avg_medicare_payments", 2, "avg_medicare_payment"),
            F.sum("total_discharges").alias("total_discharges"),
        )
        .orderBy(F.col("avg_medicare_ratio").desc_nulls_last(), "state_code")
    )
