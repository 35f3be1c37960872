"""Reporting views, each defined once, as SQL over the fact (``view_definitions``).

The functions run a definition on a fact DataFrame; ``register_views`` publishes the
results as temporary views of the session; ``create_views`` creates the definitions in
the catalog, where a BI tool finds them.  All read the fact live (Catalyst inlines a
view before optimising).  Only the percentile of ``vw_provider_details`` has a second
form: as a DataFrame it runs through the distributed ranking, whose plan depends on
the session, as a catalog view it ranks the different payments of a year, in cents
below a million, at most 10^8 of them whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions.metrics import mean_sql
from tierline.operators.ranking import percent_rank_of, with_rank_stats


def _defined(fact: DataFrame, name: str, current_year: int = 0, previous_year: int = 0, trend_pct: float = 3.0) -> DataFrame:
    sql = view_definitions("{fact}", current_year, previous_year, trend_pct)[name]
    return fact.sparkSession.sql(sql, fact=fact)


def vw_cost_by_state(fact: DataFrame) -> DataFrame:
    """View 1: cost and volume by state, region and year (map / bar charts)."""
    return _defined(fact, "vw_cost_by_state")


def vw_provider_details(fact: DataFrame) -> DataFrame:
    """View 2: provider rows with the national cost percentile within the year.

    PERCENT_RANK over PARTITION BY year has only a handful of groups, so it
    runs through the distributed ranking (running totals of the counts per
    value, joined back) rather than a per-year single-task window.
    """
    base = fact.select(
        "provider_id",
        "provider_name",
        "provider_city",
        "state_code",
        "census_region",
        "provider_size_category",
        "year",
        "total_discharges",
        "total_outpatient_services",
        "total_patient_volume",
        "distinct_drg_count",
        "avg_inpatient_payment",
        "avg_medicare_payments",
        "avg_outpatient_payment",
        "combined_avg_cost",
        "medicare_payment_ratio",
        "outpatient_volume_share_pct",
    )
    ranked = with_rank_stats(base, "avg_inpatient_payment", partition_by=["year"])
    return ranked.select(
        "provider_id",
        "provider_name",
        "provider_city",
        "state_code",
        "census_region",
        "provider_size_category",
        "year",
        "total_discharges",
        "total_outpatient_services",
        "total_patient_volume",
        "distinct_drg_count",
        F.round("avg_inpatient_payment", 2).alias("avg_inpatient_cost"),
        F.round("avg_medicare_payments", 2).alias("avg_medicare_cost"),
        F.round("avg_outpatient_payment", 2).alias("avg_outpatient_cost"),
        F.round("combined_avg_cost", 2).alias("combined_avg_cost"),
        "medicare_payment_ratio",
        "outpatient_volume_share_pct",
        F.round(percent_rank_of() * 100, 1).alias("national_cost_percentile"),
    )


def vw_yoy_change(fact: DataFrame, current_year: int, previous_year: int, trend_pct: float = 3.0) -> DataFrame:
    """View 3: year-over-year change by state with a trend label.  Joined on
    state only, as in the original (safe while a state has one region)."""
    return _defined(fact, "vw_yoy_change", current_year, previous_year, trend_pct)


def vw_region_summary(fact: DataFrame) -> DataFrame:
    """View 4: region KPIs against the national average of the same year."""
    return _defined(fact, "vw_region_summary")


def vw_size_category(fact: DataFrame) -> DataFrame:
    """View 5: size class x year comparison (its ORDER BY is dropped: a view
    has no order for its readers)."""
    return _defined(fact, "vw_size_category_comparison")


def register_views(fact: DataFrame, current_year: int, previous_year: int, trend_pct: float = 3.0) -> dict[str, DataFrame]:
    """Publish the five views as temporary views; returns them by name."""
    views = {
        "vw_cost_by_state": vw_cost_by_state(fact),
        "vw_provider_details": vw_provider_details(fact),
        "vw_yoy_change": vw_yoy_change(fact, current_year, previous_year, trend_pct),
        "vw_region_summary": vw_region_summary(fact),
        "vw_size_category_comparison": vw_size_category(fact),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def _sql_avg(column: str, digits: int, name: str) -> str:
    return f"{mean_sql(column, digits)} AS {name}"


def view_definitions(fact: str, current_year: int, previous_year: int, trend_pct: float = 3.0) -> dict[str, str]:
    """The five views as SQL over the fact table, for the catalog.

    The percentile of view 2 ranks the counts per (year, payment): payments are
    rounded to cents, so the window orders values, not rows.
    """
    yearly = (
        f"SELECT state_code, census_region, year, {_sql_avg('avg_inpatient_payment', 2, 'avg_cost')}, "
        f"sum(total_discharges) AS total_discharges FROM {fact} GROUP BY state_code, census_region, year"
    )
    change = "try_divide(c.avg_cost - p.avg_cost, nullif(p.avg_cost, 0)) * 100"
    diff = "r.avg_inpatient_cost - n.national_avg_cost"
    return {
        "vw_cost_by_state": f"""
            SELECT state_code, census_region, year, count(DISTINCT provider_id) AS provider_count,
                   sum(total_discharges) AS total_discharges,
                   {_sql_avg("avg_inpatient_payment", 2, "avg_inpatient_cost")},
                   {_sql_avg("avg_outpatient_payment", 2, "avg_outpatient_cost")},
                   {_sql_avg("avg_medicare_payments", 2, "avg_medicare_payment")},
                   {_sql_avg("medicare_payment_ratio", 4, "avg_medicare_ratio")},
                   {_sql_avg("combined_avg_cost", 2, "avg_combined_cost")},
                   {_sql_avg("outpatient_volume_share_pct", 2, "outpatient_pct_of_volume")}
            FROM {fact} GROUP BY state_code, census_region, year""",
        "vw_provider_details": f"""
            WITH counts AS (
              SELECT year, avg_inpatient_payment AS v, count(*) AS n FROM {fact} GROUP BY year, avg_inpatient_payment),
            ranks AS (
              SELECT year, v, sum(n) OVER (PARTITION BY year ORDER BY v NULLS FIRST ROWS UNBOUNDED PRECEDING) - n AS below,
                     sum(n) OVER (PARTITION BY year) AS cnt
              FROM counts)
            SELECT f.provider_id, f.provider_name, f.provider_city, f.state_code, f.census_region,
                   f.provider_size_category, f.year, f.total_discharges, f.total_outpatient_services,
                   f.total_patient_volume, f.distinct_drg_count,
                   round(f.avg_inpatient_payment, 2) AS avg_inpatient_cost,
                   round(f.avg_medicare_payments, 2) AS avg_medicare_cost,
                   round(f.avg_outpatient_payment, 2) AS avg_outpatient_cost,
                   round(f.combined_avg_cost, 2) AS combined_avg_cost, f.medicare_payment_ratio,
                   f.outpatient_volume_share_pct,
                   round(CASE WHEN r.cnt > 1 THEN r.below / (r.cnt - 1) ELSE 0D END * 100, 1) AS national_cost_percentile
            FROM {fact} f JOIN ranks r ON f.year <=> r.year AND f.avg_inpatient_payment <=> r.v""",
        "vw_yoy_change": f"""
            WITH yearly AS ({yearly})
            SELECT c.state_code, c.census_region, p.avg_cost AS avg_cost_{previous_year},
                   c.avg_cost AS avg_cost_{current_year}, round(c.avg_cost - p.avg_cost, 2) AS absolute_change,
                   round({change}, 2) AS pct_change, c.total_discharges AS discharges_{current_year},
                   CASE WHEN {change} > {trend_pct}D THEN 'Increasing'
                        WHEN {change} < -{trend_pct}D THEN 'Decreasing' ELSE 'Stable' END AS cost_trend
            FROM yearly c JOIN yearly p ON c.state_code = p.state_code AND c.year = {current_year} AND p.year = {previous_year}""",
        "vw_region_summary": f"""
            WITH r AS (
              SELECT census_region, year, count(DISTINCT provider_id) AS provider_count,
                     sum(total_patient_volume) AS total_patient_volume, sum(total_discharges) AS total_discharges,
                     {_sql_avg("avg_inpatient_payment", 2, "avg_inpatient_cost")},
                     {_sql_avg("avg_outpatient_payment", 2, "avg_outpatient_cost")},
                     {_sql_avg("combined_avg_cost", 2, "avg_combined_cost")},
                     {_sql_avg("medicare_payment_ratio", 4, "avg_medicare_ratio")}
              FROM {fact} GROUP BY census_region, year),
            n AS (SELECT year, {_sql_avg("avg_inpatient_payment", 2, "national_avg_cost")} FROM {fact} GROUP BY year)
            SELECT r.*, n.national_avg_cost, round({diff}, 2) AS diff_from_national,
                   round(try_divide({diff}, nullif(n.national_avg_cost, 0)) * 100, 1) AS pct_above_national
            FROM r JOIN n ON r.year = n.year""",
        "vw_size_category_comparison": f"""
            SELECT provider_size_category, year, count(DISTINCT provider_id) AS provider_count,
                   {_sql_avg("total_discharges", 0, "avg_discharges")},
                   {_sql_avg("avg_inpatient_payment", 2, "avg_inpatient_cost")},
                   {_sql_avg("avg_medicare_payments", 2, "avg_medicare_cost")},
                   {_sql_avg("avg_outpatient_payment", 2, "avg_outpatient_cost")},
                   {_sql_avg("medicare_payment_ratio", 4, "avg_medicare_ratio")},
                   {_sql_avg("distinct_drg_count", 1, "avg_drg_complexity")},
                   {_sql_avg("outpatient_volume_share_pct", 2, "avg_outpatient_share_pct")}
            FROM {fact} GROUP BY provider_size_category, year""",
    }


def create_views(
    spark: SparkSession, fact: str, current_year: int, previous_year: int, trend_pct: float = 3.0, database: str | None = None
) -> list[str]:
    """CREATE OR REPLACE the five views in the catalog, over the catalog table
    ``fact``.  They outlive the session and read the table as it is when they
    are queried; creating them reads nothing."""
    names = []
    for name, sql in view_definitions(fact, current_year, previous_year, trend_pct).items():
        names.append(f"{database}.{name}" if database else name)
        spark.sql(f"CREATE OR REPLACE VIEW {names[-1]} AS {sql}")
    return names
