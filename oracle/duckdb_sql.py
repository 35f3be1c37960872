"""Independent SQL oracle (DuckDB dialect) for every registered query.

Hand-written SQL over the driver's pre-registered views, following the
reference SQL model by model with the same test-data mapping and parameters
as ``tierline.sources.testdata``.  Dialect notes:

* NULL order is stated explicitly (DuckDB sorts NULLs last on ASC);
* integer SUMs are cast to BIGINT (DuckDB widens them to HUGEINT);
* window ranks are cast to BIGINT;
* SAFE_DIVIDE is ``a / NULLIF(b, 0)`` on doubles;
* the integer guard keeps ``TRY_CAST('1.5' AS BIGINT)`` (2 in DuckDB) out;
* ``round(x, n)`` is rewritten to round x's shortest decimal text half-up,
  which is what Spark's ``round`` on a double does (``_spark_round``);
* ``round(avg(x), n)`` is the exact mean of the values' shortest decimals, rounded
  once, half away from zero (``_exact_mean``): the last bits of a sum of doubles
  depend on its order, and DuckDB's own ``avg`` of decimals is a double.
"""

from __future__ import annotations

import re

# The mapping of the driver tables, stated here again (nothing is imported from the package).
Y1, Y0 = 1998, 1997
LARGE_AT, MEDIUM_AT, Z_THRESHOLD = 1000, 850, 2.0
DECIMAL_INT_PATTERN = "^[+-]?[0-9]+$"
HEX_INT_PATTERN = "^[+-]?0[xX][0-9a-fA-F]+$"
# Unicode white space: code points.
_WS = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def T(x: str) -> str:
    return f"trim({x}, {_WS})"


def SAFE_INT(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '{DECIMAL_INT_PATTERN}') THEN TRY_CAST({x} AS BIGINT) "
        f"WHEN regexp_matches({x}, '{HEX_INT_PATTERN}') THEN TRY_CAST({x} AS BIGINT) END"
    )


def SD(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def _whole(x: str) -> str:
    """x in whole numbers of 1e-8."""
    return f"CAST({x} * 100000000 AS HUGEINT)"


def _rounded_quotient(a: str, b: str, digits: int, scale: int) -> str:
    """a / (b * 10^scale) of whole numbers, b positive, rounded half away from zero."""
    b = f"CAST({b} AS HUGEINT)"
    return (
        f"(CASE WHEN {a} < 0 THEN -1 ELSE 1 END * "
        f"CAST((2 * abs({a}) * {10 ** max(0, digits - scale)} + {b} * {10 ** max(0, scale - digits)}) "
        f"// (2 * {b} * {10 ** max(0, scale - digits)}) AS DOUBLE) / {float(10**digits)})"
    )


def _exact_mean(x: str, digits: int, over: str = "") -> str:
    decimal = f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)) AS VARCHAR)"  # then in whole numbers of 1e-18
    return _rounded_quotient(f"sum(CAST(replace({decimal}, '.', '') AS HUGEINT)){over}", f"count({x}){over}", digits, 18)


_TOTAL = "l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)"
_MEDICARE = "l.l_extendedprice * (1 - l.l_discount)"


_RAW_INPATIENT = f"""
  SELECT CAST(l.l_suppkey AS VARCHAR) AS provider_id, g.s_name AS provider_name,
         CAST(NULL AS VARCHAR) AS provider_street_address, CAST(NULL AS VARCHAR) AS provider_city,
         g.n_name AS provider_state, CAST(g.s_nationkey AS VARCHAR) AS provider_zipcode,
         g.r_name AS hospital_referral_region_description,
         split_part(p.p_brand, '#', 2) || ' - ' || p.p_type AS drg_definition,
         CAST(trunc(l.l_quantity) AS BIGINT) AS total_discharges,
         l.l_extendedprice AS average_covered_charges,
         {_TOTAL} AS average_total_payments,
         CASE WHEN l.l_discount <> 0 THEN {_MEDICARE} END AS average_medicare_payments,
         CAST(year(l.l_shipdate) AS BIGINT) AS data_year
  FROM lineitem l JOIN geo g ON l.l_suppkey = g.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_linestatus = 'F'"""


_RAW_OUTPATIENT = f"""
  SELECT CAST(l.l_suppkey AS VARCHAR) AS provider_id, g.s_name AS provider_name,
         CAST(NULL AS VARCHAR) AS provider_street_address, CAST(NULL AS VARCHAR) AS provider_city,
         g.n_name AS provider_state, CAST(g.s_nationkey AS BIGINT) AS provider_zipcode,
         g.r_name AS hospital_referral_region, p.p_type AS apc,
         CAST(trunc(l.l_quantity) AS BIGINT) AS outpatient_services,
         l.l_extendedprice AS average_estimated_submitted_charges,
         {_TOTAL} AS average_total_payments, CAST(year(l.l_shipdate) AS BIGINT) AS data_year
  FROM lineitem l JOIN geo g ON l.l_suppkey = g.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_linestatus = 'O'"""


_RAW_PHYSICIANS = f"""
  SELECT CAST(c.c_custkey AS VARCHAR) AS npi, c.c_name AS nppes_provider_last_org_name,
         CAST(NULL AS VARCHAR) AS nppes_provider_first_name, CAST(NULL AS VARCHAR) AS nppes_provider_city,
         n.n_name AS nppes_provider_state, CAST(c.c_nationkey AS VARCHAR) AS nppes_provider_zip,
         CAST(NULL AS VARCHAR) AS nppes_entity_code, c.c_mktsegment AS provider_type,
         o.o_orderpriority AS hcpcs_code, CAST(NULL AS VARCHAR) AS hcpcs_description,
         o.o_orderstatus AS place_of_service,
         l.l_quantity AS line_srvc_cnt, CAST(1.0 AS DOUBLE) AS bene_unique_cnt, l.l_quantity AS bene_day_srvc_cnt,
         {_TOTAL} AS average_medicare_allowed_amt, l.l_extendedprice AS average_submitted_chrg_amt,
         {_MEDICARE} AS average_medicare_payment_amt, {_MEDICARE} AS average_medicare_standard_amt,
         CAST(year(o.o_orderdate) AS BIGINT) AS data_year
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""


_STG_INPATIENT = f"""
  SELECT {T('provider_id')} AS provider_id, {T('provider_name')} AS provider_name,
         {T('provider_street_address')} AS provider_street_address, {T('provider_city')} AS provider_city,
         {T('provider_state')} AS provider_state, {T('provider_zipcode')} AS provider_zipcode,
         {T('hospital_referral_region_description')} AS hrr_description,
         total_discharges, average_covered_charges AS avg_covered_charges,
         average_total_payments AS avg_total_payments, average_medicare_payments AS avg_medicare_payments,
         {T('drg_definition')} AS drg_definition,
         {SAFE_INT("split_part(" + T('drg_definition') + ", ' ', 1)")} AS drg_code,
         data_year
  FROM raw_inpatient
  WHERE provider_id IS NOT NULL AND total_discharges IS NOT NULL
    AND average_total_payments > 0 AND average_total_payments < 1000000"""


_STG_OUTPATIENT = f"""
  SELECT {T('provider_id')} AS provider_id, {T('provider_name')} AS provider_name,
         {T('provider_city')} AS provider_city, {T('provider_state')} AS provider_state,
         CAST(provider_zipcode AS VARCHAR) AS provider_zipcode,
         {T('hospital_referral_region')} AS hrr_description, {T('apc')} AS apc,
         outpatient_services, average_estimated_submitted_charges AS avg_submitted_charges,
         average_total_payments AS avg_total_payments, data_year
  FROM raw_outpatient
  WHERE provider_id IS NOT NULL AND average_total_payments > 0"""


_STG_PHYSICIANS = f"""
  SELECT {T('npi')} AS npi, {T('nppes_provider_last_org_name')} AS provider_last_name,
         {T('nppes_provider_first_name')} AS provider_first_name, {T('nppes_provider_city')} AS provider_city,
         {T('nppes_provider_state')} AS provider_state, {T('nppes_provider_zip')} AS provider_zip,
         {T('nppes_entity_code')} AS entity_code, {T('provider_type')} AS provider_type,
         {T('hcpcs_code')} AS hcpcs_code, {T('hcpcs_description')} AS hcpcs_description,
         {T('place_of_service')} AS place_of_service,
         line_srvc_cnt AS line_service_count, bene_unique_cnt AS beneficiary_count,
         bene_day_srvc_cnt AS beneficiary_day_service_count,
         average_medicare_allowed_amt AS avg_medicare_allowed, average_submitted_chrg_amt AS avg_submitted_charge,
         average_medicare_payment_amt AS avg_medicare_payment, average_medicare_standard_amt AS avg_medicare_standard,
         data_year
  FROM raw_physicians
  WHERE npi IS NOT NULL AND line_srvc_cnt > 0 AND average_medicare_payment_amt > 0"""


CTES: list[tuple[str, str]] = [
    (
        "geo",
        """
  SELECT s.s_suppkey, s.s_name, s.s_nationkey, n.n_name, r.r_name
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    ),
    ("raw_inpatient", _RAW_INPATIENT),
    ("raw_outpatient", _RAW_OUTPATIENT),
    ("raw_physicians", _RAW_PHYSICIANS),
    ("stg_inpatient_charges", _STG_INPATIENT),
    ("stg_outpatient_charges", _STG_OUTPATIENT),
    ("stg_physicians", _STG_PHYSICIANS),
    (
        "int_provider_inpatient_summary",
        f"""
  SELECT provider_id, provider_name, provider_state, provider_city, hrr_description, data_year,
         COUNT(DISTINCT drg_code) AS distinct_drg_count,
         CAST(SUM(total_discharges) AS BIGINT) AS total_discharges,
         round(avg(avg_covered_charges), 2) AS avg_covered_charges,
         round(avg(avg_total_payments), 2) AS avg_total_payments,
         round(avg(avg_medicare_payments), 2) AS avg_medicare_payments,
         round({SD('avg(avg_medicare_payments)', 'avg(avg_covered_charges)')}, 4) AS medicare_payment_ratio
  FROM stg_inpatient_charges
  GROUP BY provider_id, provider_name, provider_state, provider_city, hrr_description, data_year""",
    ),
    (
        "int_provider_outpatient_summary",
        """
  SELECT provider_id, provider_name, provider_state, provider_city, data_year,
         COUNT(DISTINCT apc) AS distinct_apc_count,
         CAST(SUM(outpatient_services) AS BIGINT) AS total_outpatient_services,
         round(avg(avg_submitted_charges), 2) AS avg_submitted_charges,
         round(avg(avg_total_payments), 2) AS avg_total_payments
  FROM stg_outpatient_charges
  GROUP BY provider_id, provider_name, provider_state, provider_city, data_year""",
    ),
    (
        "int_physician_summary",
        f"""
  SELECT provider_state, provider_type, data_year,
         COUNT(DISTINCT npi) AS distinct_physicians,
         SUM(line_service_count) AS total_services,
         SUM(beneficiary_count) AS total_beneficiaries,
         round(avg(avg_medicare_payment), 2) AS avg_medicare_payment,
         round(avg(avg_submitted_charge), 2) AS avg_submitted_charge,
         round({SD('avg(avg_medicare_payment)', 'avg(avg_submitted_charge)')}, 4) AS payment_to_charge_ratio
  FROM stg_physicians
  GROUP BY provider_state, provider_type, data_year""",
    ),
    (
        "inpatient_by_state",
        """
  SELECT provider_state AS state, data_year,
         COUNT(DISTINCT provider_id) AS inpatient_provider_count,
         CAST(SUM(total_discharges) AS BIGINT) AS total_inpatient_discharges,
         round(avg(avg_total_payments), 2) AS avg_inpatient_payment,
         round(avg(avg_covered_charges), 2) AS avg_covered_charges
  FROM stg_inpatient_charges GROUP BY provider_state, data_year""",
    ),
    (
        "outpatient_by_state",
        """
  SELECT provider_state AS state, data_year,
         COUNT(DISTINCT provider_id) AS outpatient_provider_count,
         CAST(SUM(outpatient_services) AS BIGINT) AS total_outpatient_services,
         round(avg(avg_total_payments), 2) AS avg_outpatient_payment
  FROM stg_outpatient_charges GROUP BY provider_state, data_year""",
    ),
    (
        "int_state_metrics",
        f"""
  SELECT i.state, i.data_year, i.inpatient_provider_count, i.total_inpatient_discharges,
         i.avg_inpatient_payment, i.avg_covered_charges,
         o.outpatient_provider_count, o.total_outpatient_services, o.avg_outpatient_payment,
         round({SD('(i.avg_inpatient_payment * i.total_inpatient_discharges) + (o.avg_outpatient_payment * o.total_outpatient_services)',
                   'i.total_inpatient_discharges + o.total_outpatient_services')}, 2) AS combined_cost_index
  FROM inpatient_by_state i
  LEFT JOIN outpatient_by_state o ON i.state = o.state AND i.data_year = o.data_year""",
    ),
    (
        "int_provider_combined",
        """
  SELECT i.provider_id, i.provider_name, i.provider_state, i.provider_city, i.hrr_description, i.data_year,
         i.distinct_drg_count, i.total_discharges,
         i.avg_total_payments AS avg_inpatient_payment, i.avg_medicare_payments, i.medicare_payment_ratio,
         COALESCE(o.total_outpatient_services, 0) AS total_outpatient_services,
         COALESCE(o.avg_total_payments, 0) AS avg_outpatient_payment,
         i.total_discharges + COALESCE(o.total_outpatient_services, 0) AS total_patient_volume
  FROM int_provider_inpatient_summary i
  LEFT JOIN int_provider_outpatient_summary o ON i.provider_id = o.provider_id AND i.data_year = o.data_year""",
    ),
    (
        "dim_provider",
        f"""
  SELECT provider_id, provider_name, provider_city, provider_state, provider_zipcode, hrr_description,
         lifetime_discharges,
         CASE WHEN lifetime_discharges >= {LARGE_AT} THEN 'Large'
              WHEN lifetime_discharges >= {MEDIUM_AT} THEN 'Medium' ELSE 'Small' END AS provider_size_category
  FROM (
    SELECT *, row_number() OVER (
             PARTITION BY provider_id
             ORDER BY data_year DESC NULLS LAST, lifetime_discharges DESC NULLS LAST,
                      provider_name ASC NULLS FIRST, provider_city ASC NULLS FIRST, provider_state ASC NULLS FIRST,
                      provider_zipcode ASC NULLS FIRST, hrr_description ASC NULLS FIRST) AS rn
    FROM (
      SELECT provider_id, provider_name, provider_city, provider_state, provider_zipcode, hrr_description, data_year,
             CAST(SUM(total_discharges) AS BIGINT) AS lifetime_discharges
      FROM stg_inpatient_charges
      GROUP BY provider_id, provider_name, provider_city, provider_state, provider_zipcode, hrr_description, data_year
    ) deduped
  ) ranked
  WHERE rn = 1""",
    ),
    (
        "region_lookup",
        f"""
  SELECT n.n_name AS code, n.n_name || ' (' || r.r_name || ')' AS state_name, r.r_name AS census_region
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    ),
    (
        "dim_region",
        """
  SELECT s.state_code,
         COALESCE(lk.state_name, s.state_code) AS state_name,
         COALESCE(lk.census_region, 'West') AS census_region
  FROM (SELECT DISTINCT provider_state AS state_code FROM stg_inpatient_charges
        WHERE provider_state IS NOT NULL) s
  LEFT JOIN region_lookup lk ON s.state_code = lk.code""",
    ),
    (
        "dim_date",
        f"""
  SELECT y.year, q.quarter,
         CAST(y.year AS VARCHAR) || '-Q' || CAST(q.quarter AS VARCHAR) AS year_quarter_label,
         CASE q.quarter WHEN 1 THEN 'Q1 (Jan-Mar)' WHEN 2 THEN 'Q2 (Apr-Jun)'
                        WHEN 3 THEN 'Q3 (Jul-Sep)' WHEN 4 THEN 'Q4 (Oct-Dec)' END AS quarter_label,
         CAST(CASE y.year WHEN {Y0} THEN 1 WHEN {Y1} THEN 2 END AS BIGINT) AS year_index
  FROM (SELECT CAST(unnest(generate_series({Y0}, {Y1})) AS BIGINT) AS year) y,
       (SELECT CAST(unnest(generate_series(1, 4)) AS BIGINT) AS quarter) q""",
    ),
    (
        "fact",
        f"""
  SELECT pc.provider_id, pc.provider_state AS state_code, pc.data_year AS year,
         pc.provider_name, pc.provider_city, dp.provider_size_category, dr.census_region,
         pc.total_discharges, pc.total_outpatient_services, pc.total_patient_volume, pc.distinct_drg_count,
         round(pc.avg_inpatient_payment, 2) AS avg_inpatient_payment,
         round(pc.avg_medicare_payments, 2) AS avg_medicare_payments,
         round(pc.avg_outpatient_payment, 2) AS avg_outpatient_payment,
         pc.medicare_payment_ratio,
         round({SD('pc.avg_inpatient_payment', 'pc.avg_medicare_payments')}, 4) AS inpatient_to_medicare_ratio,
         round(round({SD('pc.total_outpatient_services', 'pc.total_patient_volume')}, 4) * 100, 2)
           AS outpatient_volume_share_pct,
         round({SD('(pc.avg_inpatient_payment * pc.total_discharges) + (pc.avg_outpatient_payment * pc.total_outpatient_services)',
                   'pc.total_patient_volume')}, 2) AS combined_avg_cost
  FROM int_provider_combined pc
  LEFT JOIN dim_provider dp ON pc.provider_id = dp.provider_id
  LEFT JOIN dim_region dr ON pc.provider_state = dr.state_code""",
    ),
]


def with_models(final: str, extra: list[tuple[str, str]] | None = None) -> str:
    ctes = [*CTES, *(extra or [])]
    body = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{final}"


def _sample(table: str, columns: list[str]) -> str:
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in columns)
    return with_models(f"SELECT {', '.join(columns)} FROM {table} ORDER BY {order} LIMIT 10")


_RAW_IN_COLS = [
    "provider_id", "provider_name", "provider_street_address", "provider_city", "provider_state",
    "provider_zipcode", "hospital_referral_region_description", "drg_definition", "total_discharges",
    "average_covered_charges", "average_total_payments", "average_medicare_payments",
]
_RAW_OUT_COLS = [
    "provider_id", "provider_name", "provider_street_address", "provider_city", "provider_state",
    "provider_zipcode", "hospital_referral_region", "apc", "outpatient_services",
    "average_estimated_submitted_charges", "average_total_payments",
]
_RAW_PHYS_COLS = [
    "npi", "nppes_provider_last_org_name", "nppes_provider_first_name", "nppes_provider_city",
    "nppes_provider_state", "nppes_provider_zip", "nppes_entity_code", "provider_type", "hcpcs_code",
    "hcpcs_description", "place_of_service", "line_srvc_cnt", "bene_unique_cnt", "bene_day_srvc_cnt",
    "average_medicare_allowed_amt", "average_submitted_chrg_amt", "average_medicare_payment_amt",
    "average_medicare_standard_amt",
]

_YEARLY = [
    (
        "yearly",
        """
  SELECT state_code, year, round(avg(avg_inpatient_payment), 2) AS avg_cost
  FROM fact GROUP BY state_code, year""",
    )
]

_YEARLY_VIEW = [
    (
        "yearly",
        """
  SELECT state_code, census_region, year, round(avg(avg_inpatient_payment), 2) AS avg_cost,
         CAST(SUM(total_discharges) AS BIGINT) AS total_discharges,
         COUNT(DISTINCT provider_id) AS provider_count
  FROM fact GROUP BY state_code, census_region, year""",
    )
]

_PCT = SD("c.avg_cost - p.avg_cost", "p.avg_cost") + " * 100"
_STATE_YEAR = " OVER (PARTITION BY state_code, year)"
# value * n - total: n times the distance from the state's mean
_ABOVE_STATE = (
    f"({_whole('avg_inpatient_payment')} * count(avg_inpatient_payment){_STATE_YEAR} "
    f"- sum({_whole('avg_inpatient_payment')}){_STATE_YEAR})"
)

_MODEL_NAMES = [
    "stg_inpatient_charges", "stg_outpatient_charges", "stg_physicians",
    "int_provider_inpatient_summary", "int_provider_outpatient_summary", "int_physician_summary",
    "int_state_metrics", "int_provider_combined", "dim_provider", "dim_region", "dim_date",
    "fact_healthcare_metrics",
]


def _model_table(name: str) -> str:
    return "fact" if name == "fact_healthcare_metrics" else name


ORACLE: dict[str, str] = {
    # 01 exploration
    "explore_row_counts": with_models(
        f"""
SELECT 'inpatient_charges' AS table_name, COUNT(*) AS row_count FROM raw_inpatient
UNION ALL SELECT 'outpatient_charges', COUNT(*) FROM raw_outpatient
UNION ALL SELECT 'physicians_and_other_supplier', COUNT(*) FROM raw_physicians"""
    ),
    "explore_sample_inpatient": _sample(f"raw_inpatient", _RAW_IN_COLS),
    "explore_sample_outpatient": _sample(f"raw_outpatient", _RAW_OUT_COLS),
    "explore_sample_physicians": _sample(f"raw_physicians", _RAW_PHYS_COLS),
    "explore_nulls_inpatient": with_models(
        f"""
SELECT CAST(count_if(provider_id IS NULL) AS BIGINT) AS null_provider_id,
       CAST(count_if(provider_name IS NULL) AS BIGINT) AS null_provider_name,
       CAST(count_if(provider_state IS NULL) AS BIGINT) AS null_provider_state,
       CAST(count_if(drg_definition IS NULL) AS BIGINT) AS null_drg_definition,
       CAST(count_if(average_total_payments IS NULL) AS BIGINT) AS null_avg_total_payments,
       CAST(count_if(average_covered_charges IS NULL) AS BIGINT) AS null_avg_covered_charges,
       CAST(count_if(total_discharges IS NULL) AS BIGINT) AS null_total_discharges,
       COUNT(*) AS total_rows
FROM raw_inpatient"""
    ),
    "explore_nulls_outpatient": with_models(
        f"""
SELECT CAST(count_if(provider_id IS NULL) AS BIGINT) AS null_provider_id,
       CAST(count_if(provider_state IS NULL) AS BIGINT) AS null_provider_state,
       CAST(count_if(average_total_payments IS NULL) AS BIGINT) AS null_avg_total_payments,
       CAST(count_if(outpatient_services IS NULL) AS BIGINT) AS null_outpatient_services,
       COUNT(*) AS total_rows
FROM raw_outpatient"""
    ),
    "explore_cardinality": with_models(
        f"""
SELECT COUNT(DISTINCT provider_id) AS distinct_providers,
       COUNT(DISTINCT provider_state) AS distinct_states,
       COUNT(DISTINCT drg_definition) AS distinct_drg_codes
FROM raw_inpatient"""
    ),
    "explore_distribution": with_models(
        f"""
SELECT min(v) AS min_payment, max(v) AS max_payment, round(avg(v), 6) AS avg_payment,
       round(stddev_samp(v), 6) AS stddev_payment,
       min(CASE WHEN pos = greatest(1, ceil(n * 0.25)) THEN v END) AS p25,
       min(CASE WHEN pos = greatest(1, ceil(n * 0.5)) THEN v END) AS p50,
       min(CASE WHEN pos = greatest(1, ceil(n * 0.75)) THEN v END) AS p75
FROM (SELECT average_total_payments AS v,
             row_number() OVER (ORDER BY average_total_payments) AS pos,
             COUNT(*) OVER () AS n
      FROM raw_inpatient WHERE average_total_payments IS NOT NULL) ranked"""
    ),
    "explore_top_states": with_models(
        f"""
SELECT provider_state, COUNT(DISTINCT provider_id) AS provider_count,
       CAST(SUM(total_discharges) AS BIGINT) AS total_discharges,
       round(avg(average_total_payments), 2) AS avg_payment
FROM raw_inpatient
GROUP BY provider_state
ORDER BY total_discharges DESC NULLS LAST, provider_state ASC NULLS FIRST
LIMIT 20"""
    ),
    "explore_top_drgs": with_models(
        f"""
SELECT drg_definition, CAST(SUM(total_discharges) AS BIGINT) AS total_discharges,
       round(avg(average_total_payments), 2) AS avg_payment,
       round(avg(average_covered_charges), 2) AS avg_covered_charges
FROM raw_inpatient
GROUP BY drg_definition
ORDER BY total_discharges DESC NULLS LAST, drg_definition ASC NULLS FIRST
LIMIT 20"""
    ),
    "explore_year_availability": with_models(
        f"""
SELECT CAST(data_year AS VARCHAR) AS year, COUNT(*) AS inpatient_rows FROM raw_inpatient GROUP BY data_year"""
    ),
    # 02 staging
    "stg_inpatient": with_models("SELECT * FROM stg_inpatient_charges"),
    "stg_outpatient": with_models("SELECT * FROM stg_outpatient_charges"),
    "stg_physicians": with_models("SELECT * FROM stg_physicians"),
    # 03 intermediate
    "int_provider_inpatient": with_models("SELECT * FROM int_provider_inpatient_summary"),
    "int_provider_outpatient": with_models("SELECT * FROM int_provider_outpatient_summary"),
    "int_physician_summary": with_models("SELECT * FROM int_physician_summary"),
    "int_state_metrics": with_models("SELECT * FROM int_state_metrics"),
    "int_provider_combined": with_models("SELECT * FROM int_provider_combined"),
    # 04 dimensions
    "dim_provider": with_models("SELECT * FROM dim_provider"),
    "dim_region": with_models("SELECT * FROM dim_region"),
    "dim_date": with_models("SELECT * FROM dim_date"),
    # 05 fact
    "fact_metrics": with_models("SELECT * FROM fact"),
    "fact_verification": with_models(
        """
SELECT year, COUNT(*) AS row_count, COUNT(DISTINCT provider_id) AS providers,
       COUNT(DISTINCT state_code) AS states, round(avg(avg_inpatient_payment), 2) AS overall_avg_inpatient_cost
FROM fact GROUP BY year ORDER BY year"""
    ),
    # 06 KPIs
    "kpi_cost_by_state": with_models(
        f"""
SELECT state_code, census_region, COUNT(DISTINCT provider_id) AS provider_count,
       CAST(SUM(total_discharges) AS BIGINT) AS total_discharges,
       round(avg(avg_inpatient_payment), 2) AS avg_inpatient_cost,
       round(avg(avg_medicare_payments), 2) AS avg_medicare_payment,
       round(avg(medicare_payment_ratio), 4) AS avg_medicare_ratio
FROM fact WHERE year = {Y1}
GROUP BY state_code, census_region
ORDER BY avg_inpatient_cost DESC NULLS LAST"""
    ),
    "kpi_top_cost_providers": with_models(
        f"""
SELECT provider_id, provider_name, provider_city, state_code, provider_size_category, total_discharges,
       round(avg_inpatient_payment, 2) AS avg_inpatient_cost,
       round(avg_medicare_payments, 2) AS avg_medicare_cost,
       round(combined_avg_cost, 2) AS combined_cost
FROM fact WHERE year = {Y1}
ORDER BY avg_inpatient_payment DESC NULLS LAST, provider_id ASC NULLS FIRST
LIMIT 20"""
    ),
    "kpi_cost_by_region": with_models(
        """
SELECT census_region, year, COUNT(DISTINCT provider_id) AS provider_count,
       CAST(SUM(total_patient_volume) AS BIGINT) AS total_patient_volume,
       round(avg(avg_inpatient_payment), 2) AS avg_inpatient_cost,
       round(avg(avg_outpatient_payment), 2) AS avg_outpatient_cost,
       round(avg(combined_avg_cost), 2) AS avg_combined_cost,
       round(avg(medicare_payment_ratio), 4) AS avg_medicare_ratio
FROM fact GROUP BY census_region, year ORDER BY census_region, year"""
    ),
    "kpi_yoy_change": with_models(
        f"""
SELECT c.state_code, p.avg_cost AS avg_cost_{Y0}, c.avg_cost AS avg_cost_{Y1},
       round(c.avg_cost - p.avg_cost, 2) AS absolute_change,
       round({_PCT}, 2) AS pct_change
FROM yearly c JOIN yearly p ON c.state_code = p.state_code AND c.year = {Y1} AND p.year = {Y0}
ORDER BY pct_change DESC NULLS LAST""",
        _YEARLY,
    ),
    "kpi_volume_tiers": with_models(
        """
SELECT provider_size_category, year, COUNT(DISTINCT provider_id) AS provider_count,
       round(avg(total_discharges), 0) AS avg_discharges,
       round(avg(avg_inpatient_payment), 2) AS avg_inpatient_cost,
       round(avg(avg_medicare_payments), 2) AS avg_medicare_cost,
       round(avg(medicare_payment_ratio), 4) AS avg_medicare_ratio,
       round(avg(distinct_drg_count), 1) AS avg_drg_complexity
FROM fact GROUP BY provider_size_category, year ORDER BY year, avg_inpatient_cost DESC NULLS LAST"""
    ),
    "kpi_cost_mix": with_models(
        """
SELECT state_code, year,
       round(avg(avg_inpatient_payment), 2) AS avg_inpatient_cost,
       round(avg(avg_outpatient_payment), 2) AS avg_outpatient_cost,
       round(avg(outpatient_volume_share_pct), 2) AS outpatient_pct_of_volume,
       round(avg(combined_avg_cost), 2) AS combined_cost
FROM fact GROUP BY state_code, year ORDER BY outpatient_pct_of_volume DESC NULLS LAST"""
    ),
    "kpi_coverage_efficiency": with_models(
        f"""
SELECT state_code, census_region,
       round(avg(medicare_payment_ratio), 4) AS avg_medicare_ratio,
       round(avg(avg_inpatient_payment), 2) AS avg_inpatient_cost,
       round(avg(avg_medicare_payments), 2) AS avg_medicare_payment,
       CAST(SUM(total_discharges) AS BIGINT) AS total_discharges
FROM fact WHERE year = {Y1}
GROUP BY state_code, census_region ORDER BY avg_medicare_ratio DESC NULLS LAST"""
    ),
    # 06 views
    "vw_cost_by_state": with_models(
        """
SELECT state_code, census_region, year, COUNT(DISTINCT provider_id) AS provider_count,
       CAST(SUM(total_discharges) AS BIGINT) AS total_discharges,
       round(avg(avg_inpatient_payment), 2) AS avg_inpatient_cost,
       round(avg(avg_outpatient_payment), 2) AS avg_outpatient_cost,
       round(avg(avg_medicare_payments), 2) AS avg_medicare_payment,
       round(avg(medicare_payment_ratio), 4) AS avg_medicare_ratio,
       round(avg(combined_avg_cost), 2) AS avg_combined_cost,
       round(avg(outpatient_volume_share_pct), 2) AS outpatient_pct_of_volume
FROM fact GROUP BY state_code, census_region, year"""
    ),
    "vw_provider_details": with_models(
        """
SELECT provider_id, provider_name, provider_city, state_code, census_region, provider_size_category, year,
       total_discharges, total_outpatient_services, total_patient_volume, distinct_drg_count,
       round(avg_inpatient_payment, 2) AS avg_inpatient_cost,
       round(avg_medicare_payments, 2) AS avg_medicare_cost,
       round(avg_outpatient_payment, 2) AS avg_outpatient_cost,
       round(combined_avg_cost, 2) AS combined_avg_cost,
       medicare_payment_ratio, outpatient_volume_share_pct,
       round(percent_rank() OVER (PARTITION BY year ORDER BY avg_inpatient_payment ASC NULLS FIRST) * 100, 1)
         AS national_cost_percentile
FROM fact"""
    ),
    "vw_yoy_change": with_models(
        f"""
SELECT c.state_code, c.census_region, p.avg_cost AS avg_cost_{Y0}, c.avg_cost AS avg_cost_{Y1},
       round(c.avg_cost - p.avg_cost, 2) AS absolute_change,
       round({_PCT}, 2) AS pct_change,
       c.total_discharges AS discharges_{Y1},
       CASE WHEN {_PCT} > 3 THEN 'Increasing' WHEN {_PCT} < -3 THEN 'Decreasing' ELSE 'Stable' END AS cost_trend
FROM yearly c JOIN yearly p ON c.state_code = p.state_code AND c.year = {Y1} AND p.year = {Y0}""",
        _YEARLY_VIEW,
    ),
    "vw_region_summary": with_models(
        f"""
SELECT r.*, n.national_avg_cost,
       round(r.avg_inpatient_cost - n.national_avg_cost, 2) AS diff_from_national,
       round({SD('r.avg_inpatient_cost - n.national_avg_cost', 'n.national_avg_cost')} * 100, 1) AS pct_above_national
FROM region_data r JOIN national n ON r.year = n.year""",
        [
            (
                "region_data",
                """
  SELECT census_region, year, COUNT(DISTINCT provider_id) AS provider_count,
         CAST(SUM(total_patient_volume) AS BIGINT) AS total_patient_volume,
         CAST(SUM(total_discharges) AS BIGINT) AS total_discharges,
         round(avg(avg_inpatient_payment), 2) AS avg_inpatient_cost,
         round(avg(avg_outpatient_payment), 2) AS avg_outpatient_cost,
         round(avg(combined_avg_cost), 2) AS avg_combined_cost,
         round(avg(medicare_payment_ratio), 4) AS avg_medicare_ratio
  FROM fact GROUP BY census_region, year""",
            ),
            (
                "national",
                """
  SELECT year, round(avg(avg_inpatient_payment), 2) AS national_avg_cost FROM fact GROUP BY year""",
            ),
        ],
    ),
    "vw_size_category": with_models(
        """
SELECT provider_size_category, year, COUNT(DISTINCT provider_id) AS provider_count,
       round(avg(total_discharges), 0) AS avg_discharges,
       round(avg(avg_inpatient_payment), 2) AS avg_inpatient_cost,
       round(avg(avg_medicare_payments), 2) AS avg_medicare_cost,
       round(avg(avg_outpatient_payment), 2) AS avg_outpatient_cost,
       round(avg(medicare_payment_ratio), 4) AS avg_medicare_ratio,
       round(avg(distinct_drg_count), 1) AS avg_drg_complexity,
       round(avg(outpatient_volume_share_pct), 2) AS avg_outpatient_share_pct
FROM fact GROUP BY provider_size_category, year"""
    ),
    # 07 windows
    "win_rank_topn": with_models(
        f"""
SELECT provider_id, provider_name, state_code, year, round(avg_inpatient_payment, 2) AS avg_cost,
       CAST(row_number() OVER (PARTITION BY state_code, year
            ORDER BY avg_inpatient_payment DESC NULLS LAST, provider_id ASC NULLS FIRST) AS BIGINT) AS row_num,
       CAST(rank() OVER (PARTITION BY state_code, year ORDER BY avg_inpatient_payment DESC NULLS LAST) AS BIGINT)
         AS cost_rank,
       CAST(dense_rank() OVER (PARTITION BY state_code, year ORDER BY avg_inpatient_payment DESC NULLS LAST)
            AS BIGINT) AS cost_dense_rank
FROM fact WHERE year = {Y1}
QUALIFY rank() OVER (PARTITION BY state_code, year ORDER BY avg_inpatient_payment DESC NULLS LAST) <= 5
ORDER BY state_code, cost_rank"""
    ),
    "win_lag_lead": with_models(
        """
SELECT provider_id, provider_name, state_code, year, round(avg_inpatient_payment, 2) AS avg_cost,
       round(LAG(avg_inpatient_payment) OVER w, 2) AS prev_year_cost,
       round(LEAD(avg_inpatient_payment) OVER w, 2) AS next_year_cost,
       round(avg_inpatient_payment - LAG(avg_inpatient_payment) OVER w, 2) AS yoy_change,
       round(CAST(avg_inpatient_payment - LAG(avg_inpatient_payment) OVER w AS DOUBLE)
             / NULLIF(LAG(avg_inpatient_payment) OVER w, 0) * 100, 2) AS yoy_pct_change
FROM fact
WINDOW w AS (PARTITION BY provider_id ORDER BY year ASC NULLS FIRST, provider_name ASC NULLS FIRST,
             state_code ASC NULLS FIRST)
ORDER BY provider_id, year"""
    ),
    "win_rolling_avg": with_models(
        f"""
SELECT state_code, census_region, year, avg_cost,
       {_exact_mean("avg_cost", 2, " OVER (PARTITION BY state_code ORDER BY year, census_region ASC NULLS FIRST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")} AS rolling_2yr_avg_cost,
       CAST(SUM(total_discharges) OVER (PARTITION BY state_code ORDER BY year, census_region ASC NULLS FIRST
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS cumulative_discharges
FROM state_yearly ORDER BY state_code, year""",
        [
            (
                "state_yearly",
                """
  SELECT state_code, census_region, year, round(avg(avg_inpatient_payment), 2) AS avg_cost,
         CAST(SUM(total_discharges) AS BIGINT) AS total_discharges
  FROM fact GROUP BY state_code, census_region, year""",
            )
        ],
    ),
    "win_ntile": with_models(
        f"""
SELECT provider_id, provider_name, state_code, census_region, provider_size_category,
       round(avg_inpatient_payment, 2) AS avg_cost,
       CAST(NTILE(4) OVER w AS BIGINT) AS cost_quartile,
       CAST(NTILE(10) OVER w AS BIGINT) AS cost_decile,
       CASE NTILE(4) OVER w WHEN 1 THEN 'Low cost (Q1)' WHEN 2 THEN 'Below average (Q2)'
            WHEN 3 THEN 'Above average (Q3)' WHEN 4 THEN 'High cost (Q4)' END AS cost_quartile_label
FROM fact WHERE year = {Y1}
WINDOW w AS (ORDER BY avg_inpatient_payment ASC NULLS FIRST, provider_id ASC NULLS FIRST)
ORDER BY avg_inpatient_payment ASC NULLS FIRST"""
    ),
    "win_percentiles": with_models(
        f"""
SELECT provider_id, provider_name, state_code, round(avg_inpatient_payment, 2) AS avg_cost,
       round(PERCENT_RANK() OVER (ORDER BY avg_inpatient_payment ASC NULLS FIRST) * 100, 1) AS cost_percentile,
       round(CUME_DIST() OVER (ORDER BY avg_inpatient_payment ASC NULLS FIRST) * 100, 1) AS cumulative_dist_pct
FROM fact WHERE year = {Y1}
ORDER BY avg_inpatient_payment DESC NULLS LAST, provider_id ASC NULLS FIRST
LIMIT 50"""
    ),
    "win_vs_group_avg": with_models(
        f"""
SELECT provider_id, provider_name, state_code, year,
       round(avg_inpatient_payment, 2) AS provider_cost,
       {_exact_mean("avg_inpatient_payment", 2, _STATE_YEAR)} AS state_avg_cost,
       {_rounded_quotient(_ABOVE_STATE, f"count(avg_inpatient_payment){_STATE_YEAR}", 2, 8)} AS diff_from_state_avg,
       {_rounded_quotient(f"({_ABOVE_STATE} * 100)", f"nullif(sum({_whole('avg_inpatient_payment')}){_STATE_YEAR}, 0)", 1, 0)}
         AS pct_above_state_avg
FROM fact WHERE year = {Y1}
ORDER BY pct_above_state_avg DESC NULLS LAST"""
    ),
    "win_cumulative_share": with_models(
        f"""
SELECT census_region, year, yearly_discharges,
       CAST(SUM(yearly_discharges) OVER (PARTITION BY census_region ORDER BY year
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_discharges,
       round({SD('yearly_discharges', 'SUM(yearly_discharges) OVER (PARTITION BY year)')} * 100, 2)
         AS pct_of_national_volume
FROM region_yearly ORDER BY census_region, year""",
        [
            (
                "region_yearly",
                """
  SELECT census_region, year, CAST(SUM(total_discharges) AS BIGINT) AS yearly_discharges
  FROM fact GROUP BY census_region, year""",
            )
        ],
    ),
    # 08 data quality
    "dq_nulls": with_models(
        """
SELECT 'stg_inpatient_charges' AS table_name,
       CAST(count_if(provider_id IS NULL) AS BIGINT) AS null_provider_id,
       CAST(count_if(provider_state IS NULL) AS BIGINT) AS null_provider_state,
       CAST(count_if(total_discharges IS NULL) AS BIGINT) AS null_total_discharges,
       CAST(count_if(avg_total_payments IS NULL) AS BIGINT) AS null_avg_total_payments,
       CAST(count_if(avg_medicare_payments IS NULL) AS BIGINT) AS null_avg_medicare_payments,
       CAST(count_if(drg_definition IS NULL) AS BIGINT) AS null_drg_definition,
       COUNT(*) AS total_rows
FROM stg_inpatient_charges
UNION ALL
SELECT 'stg_outpatient_charges', CAST(count_if(provider_id IS NULL) AS BIGINT),
       CAST(count_if(provider_state IS NULL) AS BIGINT), CAST(count_if(outpatient_services IS NULL) AS BIGINT),
       CAST(count_if(avg_total_payments IS NULL) AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), COUNT(*)
FROM stg_outpatient_charges
UNION ALL
SELECT 'stg_physicians', CAST(count_if(npi IS NULL) AS BIGINT),
       CAST(count_if(provider_state IS NULL) AS BIGINT), CAST(count_if(line_service_count IS NULL) AS BIGINT),
       CAST(count_if(avg_medicare_payment IS NULL) AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), COUNT(*)
FROM stg_physicians"""
    ),
    "dq_duplicates_fact": with_models(
        """
SELECT provider_id, year, COUNT(*) AS row_count FROM fact
GROUP BY provider_id, year HAVING COUNT(*) > 1 ORDER BY row_count DESC"""
    ),
    "dq_duplicates_provider": with_models(
        "SELECT provider_id, COUNT(*) AS row_count FROM dim_provider GROUP BY provider_id HAVING COUNT(*) > 1"
    ),
    "dq_duplicates_region": with_models(
        "SELECT state_code, COUNT(*) AS row_count FROM dim_region GROUP BY state_code HAVING COUNT(*) > 1"
    ),
    "dq_duplicates_order_lines": """
SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
    "dq_orphans_provider": with_models(
        """
SELECT f.provider_id, f.year, f.state_code
FROM fact f LEFT JOIN dim_provider dp ON f.provider_id = dp.provider_id
WHERE dp.provider_id IS NULL"""
    ),
    "dq_orphans_region": with_models(
        """
SELECT f.state_code, COUNT(*) AS unmatched_rows
FROM fact f LEFT JOIN dim_region dr ON f.state_code = dr.state_code
WHERE dr.state_code IS NULL GROUP BY f.state_code"""
    ),
    "dq_outliers_zscore": with_models(
        f"""
SELECT f.provider_id, f.provider_name, f.state_code,
       round(f.avg_inpatient_payment, 2) AS avg_cost,
       s.mean_rounded AS national_mean,
       round((f.avg_inpatient_payment - s.mean_cost) / NULLIF(s.stddev_cost, 0), 2) AS z_score
FROM fact f JOIN stats s ON f.year = s.year
WHERE f.year = {Y1}
  AND abs((f.avg_inpatient_payment - s.mean_cost) / NULLIF(s.stddev_cost, 0)) > {Z_THRESHOLD}
ORDER BY z_score DESC NULLS LAST""",
        [
            (
                "stats",
                f"""
  SELECT year, avg(avg_inpatient_payment) AS mean_cost, round(avg(avg_inpatient_payment), 2) AS mean_rounded, stddev_samp(avg_inpatient_payment) AS stddev_cost
  FROM fact WHERE year = {Y1} GROUP BY year""",
            )
        ],
    ),
    "dq_health_report": with_models(
        """
SELECT check_name, status FROM (
  SELECT 'Fact table has rows' AS check_name, CASE WHEN COUNT(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM fact
  UNION ALL
  SELECT 'No duplicate provider+year', CASE WHEN COUNT(*) = 0 THEN 'PASS' ELSE 'FAIL' END
  FROM (SELECT provider_id, year FROM fact GROUP BY provider_id, year HAVING COUNT(*) > 1) d
  UNION ALL
  SELECT 'dim_provider has rows', CASE WHEN COUNT(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM dim_provider
  UNION ALL
  SELECT 'dim_region covers 50+ states', CASE WHEN COUNT(*) >= 50 THEN 'PASS' ELSE 'FAIL' END FROM dim_region
  UNION ALL
  SELECT '7 years present in fact table', CASE WHEN COUNT(DISTINCT year) = 7 THEN 'PASS' ELSE 'FAIL' END
  FROM fact
) checks
ORDER BY status, check_name"""
    ),
    "warehouse_build": with_models(
        "\nUNION ALL ".join(
            f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {_model_table(n)}" for n in _MODEL_NAMES
        )
    ),
}


def _spark_round(sql: str) -> str:
    """Rewrite ``round(x, n)`` as half-up rounding of x's shortest decimal
    text — what Spark's ``round`` on a double does (Java ``Double.toString``
    into ``BigDecimal``).  DuckDB's own ``round`` works on the binary value,
    so the mean of two 2-decimal numbers (an exact ``.xx5``) would otherwise
    round the other way."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        out.append(sql[i:j])
        depth, k, comma = 0, j + 6, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        expr, digits = _spark_round(sql[j + 6 : comma]), sql[comma + 1 : k].strip()
        plain_avg = re.fullmatch(r"\s*avg\(([^()]*)\)\s*", expr, re.IGNORECASE)
        if plain_avg:
            out.append(_exact_mean(plain_avg.group(1), int(digits)))
        else:
            out.append(f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)")
        i = k + 1


ORACLE["dim_date"] = with_models(
    """
SELECT d.*, COALESCE(s.n, 0) AS staged_rows
FROM dim_date d LEFT JOIN (SELECT data_year, COUNT(*) AS n FROM stg_inpatient_charges GROUP BY data_year) s
  ON d.year = s.data_year"""
)
ORACLE["fact_load_stamp"] = with_models(
    """
SELECT COUNT(*) AS fact_rows, COUNT(*) AS stamped_rows, CAST(1 AS BIGINT) AS load_times FROM fact"""
)
# the exact quartile is within the bound by definition; its rank is computed from the sorted column all the same
ORACLE["explore_distribution_approx"] = with_models(
    """
SELECT min(v) AS min_payment, max(v) AS max_payment, round(avg(v), 6) AS avg_payment,
       round(stddev_samp(v), 6) AS stddev_payment,
       abs(count(CASE WHEN v <= q1 THEN 1 END) - ceil(0.25 * count(*))) <= count(CASE WHEN v = q1 THEN 1 END) + count(*) / 10000 AS p25_in_bound,
       abs(count(CASE WHEN v <= q2 THEN 1 END) - ceil(0.5 * count(*))) <= count(CASE WHEN v = q2 THEN 1 END) + count(*) / 10000 AS p50_in_bound,
       abs(count(CASE WHEN v <= q3 THEN 1 END) - ceil(0.75 * count(*))) <= count(CASE WHEN v = q3 THEN 1 END) + count(*) / 10000 AS p75_in_bound
FROM (SELECT average_total_payments AS v FROM raw_inpatient WHERE average_total_payments IS NOT NULL) r,
     (SELECT quantile_disc(average_total_payments, 0.25) AS q1, quantile_disc(average_total_payments, 0.5) AS q2,
             quantile_disc(average_total_payments, 0.75) AS q3 FROM raw_inpatient) q"""
)
ORACLE["dq_duplicates_supplier_nations"] = """
SELECT s_nationkey, COUNT(*) AS row_count FROM supplier GROUP BY s_nationkey HAVING COUNT(*) > 1"""
ORACLE["dq_duplicates_customer_days"] = """
SELECT o_custkey, o_orderdate, COUNT(*) AS row_count FROM orders GROUP BY o_custkey, o_orderdate HAVING COUNT(*) > 1"""
ORACLE["dq_orphans_orders"] = """
SELECT o_orderkey, o_orderpriority FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"""
ORACLE["dq_orphans_order_priorities"] = """
SELECT o_orderpriority, COUNT(*) AS unmatched_rows FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) GROUP BY o_orderpriority"""
ORACLE["win_running_volume"] = with_models(
    f"""
SELECT provider_id, year, census_region, total_discharges,
       CAST(SUM(coalesce(total_discharges, 0)) OVER w AS BIGINT) AS running_discharges,
       round({SD('SUM(coalesce(total_discharges, 0)) OVER w', 'SUM(total_discharges) OVER (PARTITION BY census_region)')} * 100, 2)
         AS running_pct_of_region
FROM fact
WINDOW w AS (PARTITION BY census_region ORDER BY year ASC NULLS FIRST, provider_id ASC NULLS FIRST ROWS UNBOUNDED PRECEDING)"""
)
# the exact boundary is within any bound; the outer ones are the extremes
ORACLE["rollup_quantiles"] = with_models(
    """
SELECT data_year AS year, count(avg_total_payments) AS n, min(avg_total_payments) AS low, max(avg_total_payments) AS high,
       CAST(5 AS INTEGER) AS n_boundaries, true AS q1_in_bound, true AS q2_in_bound, true AS q3_in_bound
FROM stg_inpatient_charges GROUP BY data_year
UNION ALL
SELECT NULL, count(avg_total_payments), min(avg_total_payments), max(avg_total_payments), 5, true, true, true FROM stg_inpatient_charges"""
)
ORACLE["rollup_distinct"] = with_models(
    """
SELECT 'state' AS level, provider_state AS place, data_year AS year, count(DISTINCT provider_id) AS distinct_providers,
       count(DISTINCT drg_definition) AS distinct_drgs
FROM stg_inpatient_charges GROUP BY provider_state, data_year
UNION ALL
SELECT 'region', r.census_region, s.data_year, count(DISTINCT s.provider_id), count(DISTINCT s.drg_definition)
FROM stg_inpatient_charges s JOIN dim_region r ON s.provider_state = r.state_code GROUP BY r.census_region, s.data_year
UNION ALL
SELECT 'nation', NULL, data_year, count(DISTINCT provider_id), count(DISTINCT drg_definition)
FROM stg_inpatient_charges GROUP BY data_year
UNION ALL
SELECT 'all years', NULL, NULL, count(DISTINCT provider_id), count(DISTINCT drg_definition) FROM stg_inpatient_charges"""
)
ORACLE["join_staged_providers"] = with_models(
    """
SELECT p.provider_size_category, s.data_year AS year, COUNT(*) AS staged_rows, CAST(SUM(s.total_discharges) AS BIGINT) AS discharges
FROM stg_inpatient_charges s LEFT JOIN dim_provider p ON s.provider_id = p.provider_id
GROUP BY p.provider_size_category, s.data_year"""
)

ORACLE = {key: _spark_round(sql) for key, sql in ORACLE.items()}
