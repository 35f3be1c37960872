"""The provider x year fact and its load verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.functions.metrics import mean_round, ratio, weighted_blend


def fact_healthcare_metrics(
    combined: DataFrame,
    dim_provider: DataFrame,
    dim_region: DataFrame,
    with_load_time: bool = True,
) -> DataFrame:
    """Enrich the combined provider model with the two dimensions.

    dim_provider grows with the data and joins by shuffle on provider_id;
    dim_region has one row per state and is left to AQE, which broadcasts it
    from its measured size.
    """
    pc, dp, dr = combined.alias("pc"), dim_provider.alias("dp"), dim_region.alias("dr")
    enriched = (
        pc.join(dp, F.col("pc.provider_id") == F.col("dp.provider_id"), "left")
        .join(dr, F.col("pc.provider_state") == F.col("dr.state_code"), "left")
        .select(
            F.col("pc.provider_id").alias("provider_id"),
            F.col("pc.provider_state").alias("state_code"),
            F.col("pc.data_year").alias("year"),
            F.col("pc.provider_name").alias("provider_name"),
            F.col("pc.provider_city").alias("provider_city"),
            "pc.distinct_drg_count",
            "pc.total_discharges",
            "pc.avg_inpatient_payment",
            "pc.avg_medicare_payments",
            "pc.medicare_payment_ratio",
            "pc.total_outpatient_services",
            "pc.avg_outpatient_payment",
            "pc.total_patient_volume",
            "dp.provider_size_category",
            "dr.census_region",
            F.round(ratio("pc.avg_inpatient_payment", "pc.avg_medicare_payments"), 4).alias(
                "inpatient_to_medicare_ratio"
            ),
            F.round(ratio("pc.total_outpatient_services", "pc.total_patient_volume"), 4).alias(
                "outpatient_volume_share"
            ),
        )
    )
    cols = [
        "provider_id",
        "state_code",
        "year",
        "provider_name",
        "provider_city",
        "provider_size_category",
        "census_region",
        "total_discharges",
        "total_outpatient_services",
        "total_patient_volume",
        "distinct_drg_count",
        F.round("avg_inpatient_payment", 2).alias("avg_inpatient_payment"),
        F.round("avg_medicare_payments", 2).alias("avg_medicare_payments"),
        F.round("avg_outpatient_payment", 2).alias("avg_outpatient_payment"),
        "medicare_payment_ratio",
        "inpatient_to_medicare_ratio",
        F.round(F.col("outpatient_volume_share") * 100, 2).alias("outpatient_volume_share_pct"),
        F.round(
            weighted_blend(
                "avg_inpatient_payment", "total_discharges", "avg_outpatient_payment", "total_outpatient_services"
            ),
            2,
        ).alias("combined_avg_cost"),
    ]
    if with_load_time:
        cols.append(F.current_timestamp().alias("loaded_at"))
    return enriched.select(*cols)


def fact_verification(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct("provider_id").alias("providers"),
            F.count_distinct("state_code").alias("states"),
            mean_round("avg_inpatient_payment", 2).alias("overall_avg_inpatient_cost"),
        )
        .orderBy("year")
    )


def fact_load_stamp(fact: DataFrame) -> DataFrame:
    """Rows, rows with a load time, and different load times (one per build)."""
    return fact.agg(
        F.count(F.lit(1)).alias("fact_rows"),
        F.count("loaded_at").alias("stamped_rows"),
        F.count_distinct("loaded_at").alias("load_times"),
    )
