"""Declared schemas of the raw source tables (original shape).

One table per source and year.  Declaring the schema avoids inference scans
and fixes the types the staging layer relies on (the outpatient zip is a
number, the inpatient zip is text).
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


INPATIENT = _struct(
    [
        ("provider_id", _S),
        ("provider_name", _S),
        ("provider_street_address", _S),
        ("provider_city", _S),
        ("provider_state", _S),
        ("provider_zipcode", _S),
        ("hospital_referral_region_description", _S),
        ("drg_definition", _S),
        ("total_discharges", _L),
        ("average_covered_charges", _D),
        ("average_total_payments", _D),
        ("average_medicare_payments", _D),
    ]
)

OUTPATIENT = _struct(
    [
        ("provider_id", _S),
        ("provider_name", _S),
        ("provider_street_address", _S),
        ("provider_city", _S),
        ("provider_state", _S),
        ("provider_zipcode", _L),
        ("hospital_referral_region", _S),
        ("apc", _S),
        ("outpatient_services", _L),
        ("average_estimated_submitted_charges", _D),
        ("average_total_payments", _D),
    ]
)

PHYSICIANS = _struct(
    [
        ("npi", _S),
        ("nppes_provider_last_org_name", _S),
        ("nppes_provider_first_name", _S),
        ("nppes_provider_city", _S),
        ("nppes_provider_state", _S),
        ("nppes_provider_zip", _S),
        ("nppes_entity_code", _S),
        ("provider_type", _S),
        ("hcpcs_code", _S),
        ("hcpcs_description", _S),
        ("place_of_service", _S),
        ("line_srvc_cnt", _D),
        ("bene_unique_cnt", _D),
        ("bene_day_srvc_cnt", _D),
        ("average_medicare_allowed_amt", _D),
        ("average_submitted_chrg_amt", _D),
        ("average_medicare_payment_amt", _D),
        ("average_medicare_standard_amt", _D),
    ]
)

RAW_SCHEMAS = {
    "inpatient_charges": INPATIENT,
    "outpatient_charges": OUTPATIENT,
    "physicians_and_other_supplier": PHYSICIANS,
}
