"""Window analytics over the fact.

Partitioned windows stay native (they are distributed by their key);
global NTILE / PERCENT_RANK / CUME_DIST go through the distributed ranking
operator; the unordered group mean is an aggregate joined back, so a hot
state is collapsed map-side instead of buffered in one window task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.functions.metrics import EXACT_DIGITS, exact_sum_sql, mean_round, ratio, round_ratio_sql, scaled_sql
from tierline.operators.ranking import cume_dist_of, percent_rank_of, running_totals_by, top_k_with_rank_stats, with_ntiles
from tierline.plans.kpis import yearly_state_cost

# The quartile labels.
QUARTILE_LABELS = (
    (1, "Low cost (Q1)"),
    (2, "Below average (Q2)"),
    (3, "Above average (Q3)"),
    (4, "High cost (Q4)"),
)


def win_rank_topn(fact: DataFrame, year: int, n: int = 5) -> DataFrame:
    """Pattern 1: ROW_NUMBER / RANK / DENSE_RANK per state-year; QUALIFY RANK <= n.

    The rank filter sits directly on the rank window, so Spark inserts a
    partial WindowGroupLimit before the shuffle.  ROW_NUMBER (with provider
    id as tie-breaker) is computed after the cut: rows kept by RANK <= n
    precede every dropped row, so their row numbers are unchanged.
    """
    value = F.col("avg_inpatient_payment").desc_nulls_last()
    by_value = Window.partitionBy("state_code", "year").orderBy(value)
    kept = (
        fact.filter(F.col("year") == year)
        .select(
            "provider_id",
            "provider_name",
            "state_code",
            "year",
            "avg_inpatient_payment",
            F.rank().over(by_value).cast("bigint").alias("cost_rank"),
            F.dense_rank().over(by_value).cast("bigint").alias("cost_dense_rank"),
        )
        .filter(F.col("cost_rank") <= n)
    )
    by_row = Window.partitionBy("state_code", "year").orderBy(value, F.col("provider_id").asc_nulls_first())
    return kept.select(
        "provider_id",
        "provider_name",
        "state_code",
        "year",
        F.round("avg_inpatient_payment", 2).alias("avg_cost"),
        F.row_number().over(by_row).cast("bigint").alias("row_num"),
        "cost_rank",
        "cost_dense_rank",
    ).orderBy(F.col("state_code").asc_nulls_first(), "cost_rank", "row_num")


def win_lag_lead(fact: DataFrame) -> DataFrame:
    """Pattern 2: previous / next *row* per provider (a missing year is not detected)."""
    w = Window.partitionBy("provider_id").orderBy(
        F.col("year").asc_nulls_first(), F.col("provider_name").asc_nulls_first(), F.col("state_code").asc_nulls_first()
    )
    v = F.col("avg_inpatient_payment")
    prev = F.lag(v).over(w)
    return fact.select(
        "provider_id",
        "provider_name",
        "state_code",
        "year",
        F.round(v, 2).alias("avg_cost"),
        F.round(prev, 2).alias("prev_year_cost"),
        F.round(F.lead(v).over(w), 2).alias("next_year_cost"),
        F.round(v - prev, 2).alias("yoy_change"),
        F.round(ratio(v - prev, prev) * 100, 2).alias("yoy_pct_change"),
    ).orderBy(F.col("provider_id").asc_nulls_first(), "year")


def win_rolling_avg(fact: DataFrame) -> DataFrame:
    """Pattern 3: 2-row rolling mean and running discharges per state."""
    yearly = yearly_state_cost(fact, ("state_code", "census_region"), extra=True)
    w = Window.partitionBy("state_code").orderBy("year", F.col("census_region").asc_nulls_first())
    two_rows = " OVER (PARTITION BY state_code ORDER BY year, census_region NULLS FIRST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"
    return yearly.select(
        "state_code",
        "census_region",
        "year",
        "avg_cost",
        mean_round("avg_cost", 2, two_rows).alias("rolling_2yr_avg_cost"),
        F.sum("total_discharges")
        .over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("cumulative_discharges"),
    ).orderBy(F.col("state_code").asc_nulls_first(), "year")


def win_ntile(fact: DataFrame, year: int, quartiles: int = 4, deciles: int = 10) -> DataFrame:
    """Pattern 4: global NTILE(4), NTILE(10) by cost (provider id breaks ties)."""
    base = fact.filter(F.col("year") == year).select(
        "provider_id", "provider_name", "state_code", "census_region", "provider_size_category", "avg_inpatient_payment"
    )
    tiled = with_ntiles(
        base,
        {"cost_quartile": quartiles, "cost_decile": deciles},
        ["avg_inpatient_payment", "provider_id"],
    )
    label = F.lit(None).cast("string")
    for q, text in reversed(QUARTILE_LABELS):
        label = F.when(F.col("cost_quartile") == q, F.lit(text)).otherwise(label)
    return tiled.select(
        "provider_id",
        "provider_name",
        "state_code",
        "census_region",
        "provider_size_category",
        F.round("avg_inpatient_payment", 2).alias("avg_cost"),
        "cost_quartile",
        "cost_decile",
        label.alias("cost_quartile_label"),
        "avg_inpatient_payment",
    ).orderBy(F.col("avg_inpatient_payment").asc_nulls_first(), F.col("provider_id").asc_nulls_first()).drop(
        "avg_inpatient_payment"
    )


def win_percentiles(fact: DataFrame, year: int, k: int = 50) -> DataFrame:
    """Pattern 5: top-k by cost with PERCENT_RANK / CUME_DIST over the whole year.

    Only the top rows are reported, so only they are ranked: their ranks
    depend on the rows at or above them, which are all in the top k.
    """
    base = fact.filter(F.col("year") == year).select("provider_id", "provider_name", "state_code", "avg_inpatient_payment")
    ranked = top_k_with_rank_stats(base, "avg_inpatient_payment", k, [F.col("provider_id").asc_nulls_first()])
    return ranked.orderBy(
        F.col("avg_inpatient_payment").desc_nulls_last(), F.col("provider_id").asc_nulls_first()
    ).select(
        "provider_id",
        "provider_name",
        "state_code",
        F.round("avg_inpatient_payment", 2).alias("avg_cost"),
        F.round(percent_rank_of() * 100, 1).alias("cost_percentile"),
        F.round(cume_dist_of() * 100, 1).alias("cumulative_dist_pct"),
    )


def win_vs_group_avg(fact: DataFrame, year: int) -> DataFrame:
    """Pattern 6: provider cost against the state-year mean (AVG OVER PARTITION BY)."""
    rows = fact.filter(F.col("year") == year)
    value = "avg_inpatient_payment"
    sums = rows.groupBy("state_code", "year").agg(
        F.expr(exact_sum_sql(value)).alias("total"), F.count(value).alias("n"), mean_round(value, 2).alias("state_avg_cost")
    )
    r, m = rows.alias("r"), sums.alias("m")
    joined = r.join(
        m, F.col("r.state_code").eqNullSafe(F.col("m.state_code")) & (F.col("r.year") == F.col("m.year"))
    )
    # value - mean = (value * n - total) / n, and over the mean: / total
    above = f"(CAST({scaled_sql('r.' + value)} AS DECIMAL(38,0)) * m.n - m.total)"
    return joined.select(
        F.col("r.provider_id").alias("provider_id"),
        F.col("r.provider_name").alias("provider_name"),
        F.col("r.state_code").alias("state_code"),
        F.col("r.year").alias("year"),
        F.round(f"r.{value}", 2).alias("provider_cost"),
        F.col("m.state_avg_cost").alias("state_avg_cost"),
        F.when(F.col("m.n") > 0, F.expr(round_ratio_sql(above, "m.n", 2, EXACT_DIGITS))).alias("diff_from_state_avg"),
        F.when(F.col("m.total") > 0, F.expr(round_ratio_sql(f"({above} * 100)", "m.total", 1))).alias("pct_above_state_avg"),
    ).orderBy(F.col("pct_above_state_avg").desc_nulls_last(), "provider_id")


def win_cumulative_share(fact: DataFrame) -> DataFrame:
    """Pattern 7: running discharges per region and share of the year's total."""
    yearly = fact.groupBy("census_region", "year").agg(F.sum("total_discharges").alias("yearly_discharges"))
    running = Window.partitionBy("census_region").orderBy("year").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    national = Window.partitionBy("year")
    return yearly.select(
        "census_region",
        "year",
        "yearly_discharges",
        F.sum("yearly_discharges").over(running).alias("cumulative_discharges"),
        F.round(ratio("yearly_discharges", F.sum("yearly_discharges").over(national)) * 100, 2).alias(
            "pct_of_national_volume"
        ),
    ).orderBy(F.col("census_region").asc_nulls_first(), "year")


def win_running_volume(fact: DataFrame) -> DataFrame:
    """Pattern 7 at the level of provider-years: running discharges of a region
    by year and provider, and the share of the region's total reached.  There are
    few regions, and one may hold any share of the rows, so their running totals
    come from ranges (``running_totals_by``) instead of one task a region."""
    rows = fact.select("provider_id", "year", "census_region", "total_discharges")
    running = running_totals_by(rows, ["census_region"], ["year", "provider_id"], F.col("total_discharges"), "running_discharges")
    totals = rows.groupBy("census_region").agg(F.sum("total_discharges").alias("region_total"))
    l, r = running.alias("l"), totals.alias("r")
    return l.join(r, F.col("l.census_region").eqNullSafe(F.col("r.census_region"))).select(
        "l.provider_id",
        "l.year",
        "l.census_region",
        "l.total_discharges",
        "l.running_discharges",
        F.round(ratio("l.running_discharges", "r.region_total") * 100, 2).alias("running_pct_of_region"),
    )
