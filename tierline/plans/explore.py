"""Profiling of the raw sources before modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.functions.metrics import mean_round
from tierline.operators.quality import null_profile, stack
from tierline.operators.ranking import exact_quantiles
from tierline.sources.readers import RawSources, year_parts

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def explore_row_counts(raw: RawSources) -> DataFrame:
    return stack(
        [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for name, df in raw.table_names()]
    )


def explore_sample(raw_table: DataFrame, n: int = 10, ordered: bool = False) -> DataFrame:
    """A preview of ``n`` rows: any of them, which reads no more than it shows.
    ``ordered`` takes the first in the order of all columns, the same on every
    run (a per-task top-n over the whole table), for checks."""
    if ordered:
        raw_table = raw_table.orderBy(*[F.col(c).asc_nulls_first() for c in raw_table.columns])
    return raw_table.limit(n)


def explore_nulls_inpatient(raw_inpatient: DataFrame) -> DataFrame:
    return null_profile(
        raw_inpatient,
        {
            "null_provider_id": "provider_id",
            "null_provider_name": "provider_name",
            "null_provider_state": "provider_state",
            "null_drg_definition": "drg_definition",
            "null_avg_total_payments": "average_total_payments",
            "null_avg_covered_charges": "average_covered_charges",
            "null_total_discharges": "total_discharges",
        },
    )


def explore_nulls_outpatient(raw_outpatient: DataFrame) -> DataFrame:
    return null_profile(
        raw_outpatient,
        {
            "null_provider_id": "provider_id",
            "null_provider_state": "provider_state",
            "null_avg_total_payments": "average_total_payments",
            "null_outpatient_services": "outpatient_services",
        },
    )


def explore_cardinality(raw_inpatient: DataFrame) -> DataFrame:
    return raw_inpatient.agg(
        F.count_distinct("provider_id").alias("distinct_providers"),
        F.count_distinct("provider_state").alias("distinct_states"),
        F.count_distinct("drg_definition").alias("distinct_drg_codes"),
    )


def _moments(c: str) -> list:
    return [
        F.min(c).alias("min_payment"),
        F.max(c).alias("max_payment"),
        mean_round(c, 6).alias("avg_payment"),
        F.round(F.stddev_samp(c), 6).alias("stddev_payment"),
    ]


def explore_distribution(raw_inpatient: DataFrame, value: str = "average_total_payments") -> DataFrame:
    """min / max / mean / sample stddev and exact quartiles (PERCENTILE_DISC:
    the smallest value whose cumulative share reaches p).  The quartiles
    come from running totals of the counts per value; the two one-row results
    are stacked and folded into one row."""
    moments = raw_inpatient.agg(*_moments(value))
    quartiles = exact_quantiles(raw_inpatient, value, QUARTILES)
    cols = moments.columns + list(QUARTILES)
    stacked = moments.unionByName(quartiles, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def explore_distribution_approx(
    raw_inpatient: DataFrame, value: str = "average_total_payments", accuracy: int = 10000
) -> DataFrame:
    """Same profile with mergeable approximate quartiles (one pass, no sort);
    a quartile's rank is off by n / ``accuracy`` at most."""
    q = F.percentile_approx(value, list(QUARTILES.values()), accuracy)
    return raw_inpatient.agg(*_moments(value), q.alias("_q")).select(
        "min_payment",
        "max_payment",
        "avg_payment",
        "stddev_payment",
        *[F.col("_q")[i].alias(name) for i, name in enumerate(QUARTILES)],
    )


def explore_distribution_approx_check(
    raw_inpatient: DataFrame, value: str = "average_total_payments", accuracy: int = 10000
) -> DataFrame:
    """The approximate profile's moments and, per quartile, whether the rank of
    the value found is within n / ``accuracy`` (rounded up to whole ranks) of
    the exact one: the quartiles in one pass, their ranks in another."""
    profile = explore_distribution_approx(raw_inpatient, value, accuracy)
    ranked = raw_inpatient.select(F.col(value).alias("_v")).where("_v IS NOT NULL").join(F.broadcast(profile))  # one row
    n = F.count(F.lit(1))
    bound = F.ceil(n / F.lit(accuracy))
    inside = [
        ((F.count_if(F.col("_v") < F.col(q)) + 1 <= F.ceil(n * p) + bound) & (F.count_if(F.col("_v") <= F.col(q)) >= F.ceil(n * p) - bound)).alias(f"{q}_in_bound")
        for q, p in QUARTILES.items()
    ]
    moments = ("min_payment", "max_payment", "avg_payment", "stddev_payment")
    return ranked.agg(*[F.max(m).alias(m) for m in moments], *inside)


def explore_top_states(raw_inpatient: DataFrame, k: int = 20) -> DataFrame:
    return (
        raw_inpatient.groupBy("provider_state")
        .agg(
            F.count_distinct("provider_id").alias("provider_count"),
            F.sum("total_discharges").alias("total_discharges"),
            mean_round("average_total_payments", 2).alias("avg_payment"),
        )
        .orderBy(F.col("total_discharges").desc_nulls_last(), F.col("provider_state").asc_nulls_first())
        .limit(k)
    )


def explore_top_drgs(raw_inpatient: DataFrame, k: int = 20) -> DataFrame:
    return (
        raw_inpatient.groupBy("drg_definition")
        .agg(
            F.sum("total_discharges").alias("total_discharges"),
            mean_round("average_total_payments", 2).alias("avg_payment"),
            mean_round("average_covered_charges", 2).alias("avg_covered_charges"),
        )
        .orderBy(F.col("total_discharges").desc_nulls_last(), F.col("drg_definition").asc_nulls_first())
        .limit(k)
    )


def explore_year_availability(raw: RawSources) -> DataFrame:
    counts = [
        df.groupBy(year.cast("string").alias("year")).agg(F.count(F.lit(1)).alias("inpatient_rows"))
        for year, df in year_parts(raw.inpatient)
    ]
    return stack(counts).orderBy("year")
