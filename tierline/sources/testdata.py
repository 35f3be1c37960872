"""Adapter: the driver's retail-shaped tables as the raw sources.

The mapping (SURVEY §2.12) turns order lines into charge rows:

* provider = supplier (id ``l_suppkey`` as text, name ``s_name``), state =
  nation name, referral region = region name, zip = nation key;
* inpatient  = lines with ``l_linestatus = 'F'``, outpatient = those with 'O';
  the ship year is the data year, a column of one table per source;
* DRG text = ``'<brand number> - <part type>'`` so the staging parser reads a
  numeric code; APC = part type;
* discharges / services = quantity, covered charges = extended price,
  total payment = price*(1-discount)*(1+tax), medicare payment =
  price*(1-discount) — recorded as missing when the discount is 0, so null
  handling is exercised end to end;
* physicians = all order lines, the order year being the data year: npi =
  customer key, provider type = market segment, HCPCS = order priority,
  place of service = order status.

Every line is read: 'F' and 'O' lines of all years, and every order.  The
dimension tables join by shuffle or, from measured sizes, as AQE sees fit; the
provider joins last, so that where it is shuffled the rows of one arrive together.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.sources.readers import YEAR, RawSources
from tierline.sources.sinks import write_table

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@dataclass(frozen=True)
class TestdataProfile:
    """Parameters that re-aim the reference models at the driver tables."""

    current_year: int = 1998
    previous_year: int = 1997
    large_at: float = 1000
    medium_at: float = 850
    z_threshold: float = 2.0
    #: Years in the driver tables (1995 to 2001).
    expected_years: int = 7


PROFILE = TestdataProfile()


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TPCH_TABLES}


def _supplier_geo(t: dict[str, DataFrame]) -> DataFrame:
    geo = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return t["supplier"].select("s_suppkey", "s_name", "s_nationkey").join(
        geo.select("n_nationkey", "n_name", "r_name"), F.col("s_nationkey") == F.col("n_nationkey")
    )


def _payments() -> tuple[Column, Column, Column]:
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    total = price * (1 - disc) * (1 + tax)
    medicare = price * (1 - disc)
    return price, total, medicare


def _lines_by_year(t: dict[str, DataFrame], status: str) -> DataFrame:
    """The lines of a status; their joins carry the year, not the date."""
    return t["lineitem"].filter(F.col("l_linestatus") == status).withColumn(YEAR, F.year("l_shipdate").cast("bigint")).drop("l_shipdate")


def inpatient_raw(t: dict[str, DataFrame]) -> DataFrame:
    lines = _lines_by_year(t, "F")
    price, total, medicare = _payments()
    return (
        lines.join(
            t["part"].select("p_partkey", "p_brand", "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .join(_supplier_geo(t), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_suppkey").cast("string").alias("provider_id"),
            F.col("s_name").alias("provider_name"),
            F.lit(None).cast("string").alias("provider_street_address"),
            F.lit(None).cast("string").alias("provider_city"),
            F.col("n_name").alias("provider_state"),
            F.col("s_nationkey").cast("string").alias("provider_zipcode"),
            F.col("r_name").alias("hospital_referral_region_description"),
            F.concat(
                F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)), F.lit(" - "), F.col("p_type")
            ).alias("drg_definition"),
            F.col("l_quantity").cast("bigint").alias("total_discharges"),
            price.alias("average_covered_charges"),
            total.alias("average_total_payments"),
            F.when(F.col("l_discount") != 0, medicare).alias("average_medicare_payments"),
            YEAR,
        )
    )


def outpatient_raw(t: dict[str, DataFrame]) -> DataFrame:
    lines = _lines_by_year(t, "O")
    price, total, _ = _payments()
    return (
        lines.join(
            t["part"].select("p_partkey", "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .join(_supplier_geo(t), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_suppkey").cast("string").alias("provider_id"),
            F.col("s_name").alias("provider_name"),
            F.lit(None).cast("string").alias("provider_street_address"),
            F.lit(None).cast("string").alias("provider_city"),
            F.col("n_name").alias("provider_state"),
            F.col("s_nationkey").cast("bigint").alias("provider_zipcode"),
            F.col("r_name").alias("hospital_referral_region"),
            F.col("p_type").alias("apc"),
            F.col("l_quantity").cast("bigint").alias("outpatient_services"),
            price.alias("average_estimated_submitted_charges"),
            total.alias("average_total_payments"),
            YEAR,
        )
    )


def physicians_raw(t: dict[str, DataFrame]) -> DataFrame:
    placed = t["orders"].select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("bigint").alias(YEAR)
    )
    customers = t["customer"].select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").join(
        t["nation"].select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    price, total, medicare = _payments()
    return (
        t["lineitem"]
        .select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_custkey").cast("string").alias("npi"),
            F.col("c_name").alias("nppes_provider_last_org_name"),
            F.lit(None).cast("string").alias("nppes_provider_first_name"),
            F.lit(None).cast("string").alias("nppes_provider_city"),
            F.col("n_name").alias("nppes_provider_state"),
            F.col("c_nationkey").cast("string").alias("nppes_provider_zip"),
            F.lit(None).cast("string").alias("nppes_entity_code"),
            F.col("c_mktsegment").alias("provider_type"),
            F.col("o_orderpriority").alias("hcpcs_code"),
            F.lit(None).cast("string").alias("hcpcs_description"),
            F.col("o_orderstatus").alias("place_of_service"),
            F.col("l_quantity").alias("line_srvc_cnt"),
            F.lit(1.0).alias("bene_unique_cnt"),
            F.col("l_quantity").alias("bene_day_srvc_cnt"),
            total.alias("average_medicare_allowed_amt"),
            price.alias("average_submitted_chrg_amt"),
            medicare.alias("average_medicare_payment_amt"),
            medicare.alias("average_medicare_standard_amt"),
            YEAR,
        )
    )


#: Maker of each source, and the column that its slices are cut by: provider or order.
_MAKERS = {
    "inpatient": (inpatient_raw, "l_suppkey"),
    "outpatient": (outpatient_raw, "l_suppkey"),
    "physicians": (physicians_raw, "l_orderkey"),
}


def raw_sources(spark: SparkSession, sf_dir: str) -> RawSources:
    t = read_tables(spark, sf_dir)

    def sliced(source: str, i: int, n: int) -> DataFrame:
        """Every line is in one slice; the hash of a null key is not null."""
        make, key = _MAKERS[source]
        return make(t | {"lineitem": t["lineitem"].where(F.pmod(F.xxhash64(key), F.lit(n)) == i)})

    return RawSources(**{source: make(t) for source, (make, _) in _MAKERS.items()}, sliced=sliced)


def materialise_raw(raw: RawSources, out_dir: str) -> RawSources:
    """Store every raw source (the adapter's output) once, partitioned by
    year, and return the stored tables — the raw layer as the original system
    sees it: tables on storage, not joins recomputed by every reader.  The
    tables are independent, so they are written as concurrent jobs."""
    base = out_dir.rstrip("/")
    tables = raw.table_names()

    def write(table: tuple[str, DataFrame]) -> DataFrame:
        name, df = table
        return write_table(df, f"{base}/{name}", partition_by=[YEAR] if YEAR in df.columns else None)

    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        stored = iter(list(pool.map(write, tables)))
    sources = (raw.inpatient, raw.outpatient, raw.physicians)  # the order of ``table_names``
    return RawSources(*[next(stored) if isinstance(s, DataFrame) else {year: next(stored) for year in s} for s in sources])


def region_lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(name lookup, region lookup) derived from nation ⋈ region."""
    t = read_tables(spark, sf_dir)
    geo = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    names = geo.select(
        F.col("n_name").alias("lookup_code"),
        F.concat(F.col("n_name"), F.lit(" ("), F.col("r_name"), F.lit(")")).alias("lookup_name"),
    )
    regions = geo.select(F.col("n_name").alias("lookup_code"), F.col("r_name").alias("lookup_region"))
    return names, regions
