"""Data-quality checks across the warehouse layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.functions.metrics import pass_fail
from tierline.operators.quality import duplicate_keys, null_profile, orphans, stack, zscore_outliers


def dq_nulls(stg_inpatient: DataFrame, stg_outpatient: DataFrame, stg_physicians: DataFrame) -> DataFrame:
    """Null counts of the three staging tables in one positional layout:
    for outpatient / physicians the third column counts their volume column
    and the medicare / DRG slots hold 0 and NULL."""
    return stack(
        [
            null_profile(
                stg_inpatient,
                {
                    "null_provider_id": "provider_id",
                    "null_provider_state": "provider_state",
                    "null_total_discharges": "total_discharges",
                    "null_avg_total_payments": "avg_total_payments",
                    "null_avg_medicare_payments": "avg_medicare_payments",
                    "null_drg_definition": "drg_definition",
                },
                label=("table_name", "stg_inpatient_charges"),
            ),
            null_profile(
                stg_outpatient,
                {
                    "null_provider_id": "provider_id",
                    "null_provider_state": "provider_state",
                    "null_total_discharges": "outpatient_services",
                    "null_avg_total_payments": "avg_total_payments",
                    "null_avg_medicare_payments": 0,
                    "null_drg_definition": None,
                },
                label=("table_name", "stg_outpatient_charges"),
            ),
            null_profile(
                stg_physicians,
                {
                    "null_provider_id": "npi",
                    "null_provider_state": "provider_state",
                    "null_total_discharges": "line_service_count",
                    "null_avg_total_payments": "avg_medicare_payment",
                    "null_avg_medicare_payments": 0,
                    "null_drg_definition": None,
                },
                label=("table_name", "stg_physicians"),
            ),
        ]
    )


def dq_duplicates_fact(fact: DataFrame) -> DataFrame:
    return duplicate_keys(fact, ["provider_id", "year"]).orderBy(F.col("row_count").desc(), "provider_id", "year")


def dq_duplicates_provider(dim_provider: DataFrame) -> DataFrame:
    return duplicate_keys(dim_provider, ["provider_id"])


def dq_duplicates_region(dim_region: DataFrame) -> DataFrame:
    return duplicate_keys(dim_region, ["state_code"])


def dq_duplicates_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """The same uniqueness check on any table and key."""
    return duplicate_keys(table.select(*keys), keys).orderBy(F.col("row_count").desc(), *keys)


def dq_orphans_provider(fact: DataFrame, dim_provider: DataFrame) -> DataFrame:
    return orphans(fact, dim_provider, "provider_id", "provider_id").select("provider_id", "year", "state_code")


def dq_orphans_region(fact: DataFrame, dim_region: DataFrame) -> DataFrame:
    return (
        orphans(fact, dim_region, "state_code", "state_code")
        .groupBy("state_code")
        .agg(F.count(F.lit(1)).alias("unmatched_rows"))
    )


def dq_outliers_zscore(fact: DataFrame, year: int, threshold: float = 3.0) -> DataFrame:
    rows = fact.filter(F.col("year") == year)
    flagged = zscore_outliers(rows, "avg_inpatient_payment", threshold, ["year"])
    return flagged.select(
        "provider_id",
        "provider_name",
        "state_code",
        F.round("avg_inpatient_payment", 2).alias("avg_cost"),
        F.col("_mean_rounded").alias("national_mean"),
        F.round("_z", 2).alias("z_score"),
    ).orderBy(F.col("z_score").desc_nulls_last(), "provider_id")


def dq_health_report(
    fact: DataFrame,
    dim_provider: DataFrame,
    dim_region: DataFrame,
    min_states: int = 50,
    expected_years: int = 2,
) -> DataFrame:
    """Five named PASS/FAIL rows, sorted by status then name (the check names
    are fixed values)."""
    years_name = (
        "Both years present in fact table" if expected_years == 2 else f"{expected_years} years present in fact table"
    )
    n = F.count(F.lit(1))
    # Both fact-level checks come from one aggregate (one scan of the fact).
    fact_checks = fact.agg(n.alias("_rows"), F.count_distinct("year").alias("_years")).select(
        F.explode(
            F.array(
                F.struct(F.lit("Fact table has rows").alias("check_name"), pass_fail(F.col("_rows") > 0).alias("status")),
                F.struct(
                    F.lit(years_name).alias("check_name"),
                    pass_fail(F.col("_years") == expected_years).alias("status"),
                ),
            )
        ).alias("_c")
    ).select("_c.*")
    checks = [
        ("No duplicate provider+year", duplicate_keys(fact, ["provider_id", "year"]), n == 0),
        ("dim_provider has rows", dim_provider, n > 0),
        (f"dim_region covers {min_states}+ states", dim_region, n >= min_states),
    ]
    rows = [fact_checks] + [
        df.agg(F.lit(name).alias("check_name"), pass_fail(cond).alias("status")) for name, df, cond in checks
    ]
    return stack(rows).orderBy("status", "check_name")
