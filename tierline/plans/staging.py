"""Staging layer: clean, standardise and stack the yearly raw tables.

Each filter sits on its own raw branch, so Catalyst pushes it into that
branch's scan; the union is positional-free (``unionByName``) and shuffles
nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions.text import first_token_int, trim_ws
from tierline.sources.readers import year_parts

MAX_INPATIENT_PAYMENT = 1_000_000.0


def _stack(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no raw table given for this source")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _year(year: Column) -> Column:
    return year.cast("bigint").alias("data_year")


def stg_inpatient_charges(
    sources: Mapping[int, DataFrame] | DataFrame, max_payment: float = MAX_INPATIENT_PAYMENT
) -> DataFrame:
    """Union of the yearly inpatient tables; rows without id / discharges and
    payments outside (0, max_payment) are dropped; DRG code parsed."""
    parts = []
    for year, raw in year_parts(sources):
        kept = raw.filter(
            F.col("provider_id").isNotNull()
            & F.col("total_discharges").isNotNull()
            & (F.col("average_total_payments") > 0)
            & (F.col("average_total_payments") < max_payment)
        )
        drg = trim_ws("drg_definition")
        parts.append(
            kept.select(
                trim_ws("provider_id").alias("provider_id"),
                trim_ws("provider_name").alias("provider_name"),
                trim_ws("provider_street_address").alias("provider_street_address"),
                trim_ws("provider_city").alias("provider_city"),
                trim_ws("provider_state").alias("provider_state"),
                trim_ws("provider_zipcode").alias("provider_zipcode"),
                trim_ws("hospital_referral_region_description").alias("hrr_description"),
                F.col("total_discharges").cast("bigint").alias("total_discharges"),
                F.col("average_covered_charges").alias("avg_covered_charges"),
                F.col("average_total_payments").alias("avg_total_payments"),
                F.col("average_medicare_payments").alias("avg_medicare_payments"),
                drg.alias("drg_definition"),
                first_token_int(drg).alias("drg_code"),
                _year(year),
            )
        )
    return _stack(parts)


def stg_outpatient_charges(sources: Mapping[int, DataFrame] | DataFrame) -> DataFrame:
    """Outpatient rows with an id and a positive payment (no upper bound)."""
    parts = []
    for year, raw in year_parts(sources):
        kept = raw.filter(F.col("provider_id").isNotNull() & (F.col("average_total_payments") > 0))
        parts.append(
            kept.select(
                trim_ws("provider_id").alias("provider_id"),
                trim_ws("provider_name").alias("provider_name"),
                trim_ws("provider_city").alias("provider_city"),
                trim_ws("provider_state").alias("provider_state"),
                F.col("provider_zipcode").cast("string").alias("provider_zipcode"),
                trim_ws("hospital_referral_region").alias("hrr_description"),
                trim_ws("apc").alias("apc"),
                F.col("outpatient_services").cast("bigint").alias("outpatient_services"),
                F.col("average_estimated_submitted_charges").alias("avg_submitted_charges"),
                F.col("average_total_payments").alias("avg_total_payments"),
                _year(year),
            )
        )
    return _stack(parts)


_PHYSICIAN_TEXT = (
    ("npi", "npi"),
    ("nppes_provider_last_org_name", "provider_last_name"),
    ("nppes_provider_first_name", "provider_first_name"),
    ("nppes_provider_city", "provider_city"),
    ("nppes_provider_state", "provider_state"),
    ("nppes_provider_zip", "provider_zip"),
    ("nppes_entity_code", "entity_code"),
    ("provider_type", "provider_type"),
    ("hcpcs_code", "hcpcs_code"),
    ("hcpcs_description", "hcpcs_description"),
    ("place_of_service", "place_of_service"),
)
_PHYSICIAN_MEASURES = (
    ("line_srvc_cnt", "line_service_count"),
    ("bene_unique_cnt", "beneficiary_count"),
    ("bene_day_srvc_cnt", "beneficiary_day_service_count"),
    ("average_medicare_allowed_amt", "avg_medicare_allowed"),
    ("average_submitted_chrg_amt", "avg_submitted_charge"),
    ("average_medicare_payment_amt", "avg_medicare_payment"),
    ("average_medicare_standard_amt", "avg_medicare_standard"),
)


def stg_physicians(sources: Mapping[int, DataFrame] | DataFrame) -> DataFrame:
    """One row per physician x service with positive counts and payments."""
    parts = []
    for year, raw in year_parts(sources):
        kept = raw.filter(
            F.col("npi").isNotNull()
            & (F.col("line_srvc_cnt") > 0)
            & (F.col("average_medicare_payment_amt") > 0)
        )
        parts.append(
            kept.select(
                *[trim_ws(src).alias(dst) for src, dst in _PHYSICIAN_TEXT],
                *[F.col(src).alias(dst) for src, dst in _PHYSICIAN_MEASURES],
                _year(year),
            )
        )
    return _stack(parts)
