"""Intermediate models: provider- and state-level aggregates.

Aggregations are hash aggregates with a map-side partial step, so a hot
provider or state collapses before the shuffle.  The state model
pre-aggregates both sources *before* joining them (Catalyst has no general
eager aggregation, so this is kept by hand).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions.metrics import Put, Steps, mean_round, mean_sql, ratio, weighted_blend


def _summary(rows: DataFrame, keys: list[str], value: str, distinct: str, columns: dict[str, Callable[[Put], Column]]) -> DataFrame:
    """``keys``, the number of different ``value``s as ``distinct``, and ``columns``
    made of counts and sums.

    Grouping by (keys, value) first spreads a hot group over its values, but must
    not carry the sums of all measures with each value: that is a shuffle larger
    than the rows.  So a row goes in twice, as measures of its keys, which collapse
    map-side, and as a bare value.  Whole numbers go 64 neighbours to a group."""
    whole = dict(rows.dtypes)[value] == "bigint"
    spot = F.shiftright(value, 6) if whole else F.col(value)
    bit = F.expr(f"shiftleft(1L, CAST(`{value}` & 63 AS INT))") if whole else F.col(value).isNotNull().cast("bigint")
    measures = [c for c in rows.columns if c not in (*keys, value)]
    twice = rows.withColumn("_value", F.explode(F.array(F.lit(False), F.lit(True)))).select(
        *keys,
        "_value",
        F.when(F.col("_value"), spot).alias("_spot"),
        F.when(F.col("_value"), bit).alias("_bit"),
        *[F.when(~F.col("_value"), F.col(c)).alias(c) for c in measures],
    )
    steps = Steps()
    made = [make(steps.put).alias(name) for name, make in columns.items()]
    grouped = twice.groupBy(*keys, "_value", "_spot").agg(F.bit_or("_bit").alias("_bits"), *steps.first)
    seen = F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0).cast("bigint"))
    return grouped.groupBy(*keys).agg(seen.alias(distinct), *made)


def _total(c: str) -> Callable[[Put], Column]:
    return lambda put: F.expr(put("sum", c))


def _mean(c: str) -> Callable[[Put], Column]:
    return lambda put: F.expr(mean_sql(c, 2, put=put))


def _mean_ratio(a: str, b: str) -> Callable[[Put], Column]:
    """The ratio of two means of doubles, to 4 digits."""

    def mean(put: Put, c: str) -> Column:
        return F.try_divide(F.expr(put("sum", c)), F.expr(put("count", c)).cast("double"))

    return lambda put: F.round(ratio(mean(put, a), mean(put, b)), 4)


def int_provider_inpatient_summary(stg_inpatient: DataFrame) -> DataFrame:
    return _summary(
        stg_inpatient,
        ["provider_id", "provider_name", "provider_state", "provider_city", "hrr_description", "data_year"],
        "drg_code",
        "distinct_drg_count",
        {
            "total_discharges": _total("total_discharges"),
            "avg_covered_charges": _mean("avg_covered_charges"),
            "avg_total_payments": _mean("avg_total_payments"),
            "avg_medicare_payments": _mean("avg_medicare_payments"),
            "medicare_payment_ratio": _mean_ratio("avg_medicare_payments", "avg_covered_charges"),
        },
    )


def int_provider_outpatient_summary(stg_outpatient: DataFrame) -> DataFrame:
    return _summary(
        stg_outpatient,
        ["provider_id", "provider_name", "provider_state", "provider_city", "data_year"],
        "apc",
        "distinct_apc_count",
        {
            "total_outpatient_services": _total("outpatient_services"),
            "avg_submitted_charges": _mean("avg_submitted_charges"),
            "avg_total_payments": _mean("avg_total_payments"),
        },
    )


def int_physician_summary(stg_physicians: DataFrame) -> DataFrame:
    return _summary(
        stg_physicians,
        ["provider_state", "provider_type", "data_year"],
        "npi",
        "distinct_physicians",
        {
            "total_services": _total("line_service_count"),
            "total_beneficiaries": _total("beneficiary_count"),
            "avg_medicare_payment": _mean("avg_medicare_payment"),
            "avg_submitted_charge": _mean("avg_submitted_charge"),
            "payment_to_charge_ratio": _mean_ratio("avg_medicare_payment", "avg_submitted_charge"),
        },
    )


def int_state_metrics(stg_inpatient: DataFrame, stg_outpatient: DataFrame) -> DataFrame:
    """State x year; outpatient columns NULL where that source has no rows
    (so the cost index is NULL there — no zero-fill at state level)."""
    inp = stg_inpatient.groupBy(F.col("provider_state").alias("state"), "data_year").agg(
        F.count_distinct("provider_id").alias("inpatient_provider_count"),
        F.sum("total_discharges").alias("total_inpatient_discharges"),
        mean_round("avg_total_payments", 2).alias("avg_inpatient_payment"),
        mean_round("avg_covered_charges", 2).alias("avg_covered_charges"),
    )
    out = stg_outpatient.groupBy(F.col("provider_state").alias("state"), "data_year").agg(
        F.count_distinct("provider_id").alias("outpatient_provider_count"),
        F.sum("outpatient_services").alias("total_outpatient_services"),
        mean_round("avg_total_payments", 2).alias("avg_outpatient_payment"),
    )
    i, o = inp.alias("i"), out.alias("o")
    joined = i.join(
        o, (F.col("i.state") == F.col("o.state")) & (F.col("i.data_year") == F.col("o.data_year")), "left"
    )
    return joined.select(
        "i.state",
        "i.data_year",
        "i.inpatient_provider_count",
        "i.total_inpatient_discharges",
        "i.avg_inpatient_payment",
        "i.avg_covered_charges",
        "o.outpatient_provider_count",
        "o.total_outpatient_services",
        "o.avg_outpatient_payment",
        F.round(
            weighted_blend(
                "i.avg_inpatient_payment",
                "i.total_inpatient_discharges",
                "o.avg_outpatient_payment",
                "o.total_outpatient_services",
            ),
            2,
        ).alias("combined_cost_index"),
    )


def int_provider_combined(inpatient_summary: DataFrame, outpatient_summary: DataFrame) -> DataFrame:
    """Provider x year; missing outpatient side zero-filled.  Joined on id and
    year only, so attribute spelling variants fan out (and are detected by
    the duplicate check downstream)."""
    i, o = inpatient_summary.alias("i"), outpatient_summary.alias("o")
    joined = i.join(
        o,
        (F.col("i.provider_id") == F.col("o.provider_id")) & (F.col("i.data_year") == F.col("o.data_year")),
        "left",
    )
    services = F.coalesce(F.col("o.total_outpatient_services"), F.lit(0).cast("bigint"))
    return joined.select(
        "i.provider_id",
        "i.provider_name",
        "i.provider_state",
        "i.provider_city",
        "i.hrr_description",
        "i.data_year",
        "i.distinct_drg_count",
        "i.total_discharges",
        F.col("i.avg_total_payments").alias("avg_inpatient_payment"),
        "i.avg_medicare_payments",
        "i.medicare_payment_ratio",
        services.alias("total_outpatient_services"),
        F.coalesce(F.col("o.avg_total_payments"), F.lit(0.0)).alias("avg_outpatient_payment"),
        (F.col("i.total_discharges") + services).alias("total_patient_volume"),
    )
