"""Star-schema dimensions: provider, region, date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierline.functions.lookups import DEFAULT_REGION, QUARTER_LABELS
from tierline.functions.metrics import size_category

LARGE_AT = 10000
MEDIUM_AT = 2000

_PROVIDER_ATTRS = (
    "provider_name",
    "provider_city",
    "provider_state",
    "provider_zipcode",
    "hrr_description",
)


def dim_provider(stg_inpatient: DataFrame, large_at: float = LARGE_AT, medium_at: float = MEDIUM_AT) -> DataFrame:
    """Latest attributes per provider with a size class.

    ``lifetime_discharges`` is the sum of the provider's *latest year* (the
    grouping includes the year).  Among attribute spellings of that year the
    one with the most discharges wins, then the smallest text — the
    reference leaves that choice open.  ``rn = 1`` on ``row_number`` lets
    Spark cut each map task to one row per provider before the shuffle
    (WindowGroupLimit).
    """
    grouped = stg_inpatient.groupBy("provider_id", *_PROVIDER_ATTRS, "data_year").agg(
        F.sum("total_discharges").alias("lifetime_discharges")
    )
    latest = Window.partitionBy("provider_id").orderBy(
        F.col("data_year").desc(),
        F.col("lifetime_discharges").desc(),
        *[F.col(c).asc_nulls_first() for c in _PROVIDER_ATTRS],
    )
    return (
        grouped.withColumn("rn", F.row_number().over(latest))
        .filter(F.col("rn") == 1)
        .select(
            "provider_id",
            *_PROVIDER_ATTRS,
            "lifetime_discharges",
            size_category("lifetime_discharges", large_at, medium_at).alias("provider_size_category"),
        )
    )


def dim_region(
    stg_inpatient: DataFrame,
    names: DataFrame,
    regions: DataFrame,
    default_region: str = DEFAULT_REGION,
) -> DataFrame:
    """Distinct non-null states with a name (default: the code) and a census
    region (default: ``default_region``).

    ``names`` is (lookup_code, lookup_name), ``regions`` is (lookup_code,
    lookup_region).
    """
    states = (
        stg_inpatient.filter(F.col("provider_state").isNotNull())
        .select(F.col("provider_state").alias("state_code"))
        .distinct()
    )
    n, r = names.alias("n"), regions.alias("r")
    return (
        states.alias("s")
        .join(n, F.col("s.state_code") == F.col("n.lookup_code"), "left")
        .join(r, F.col("s.state_code") == F.col("r.lookup_code"), "left")
        .select(
            F.col("s.state_code").alias("state_code"),
            F.coalesce(F.col("n.lookup_name"), F.col("s.state_code")).alias("state_name"),
            F.coalesce(F.col("r.lookup_region"), F.lit(default_region)).alias("census_region"),
        )
    )


def dim_date(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Year x quarter calendar of the configured years, whatever data is there.
    Built by exploding sequences — no join."""
    label = F.lit(None).cast("string")
    for q, text in reversed(QUARTER_LABELS):
        label = F.when(F.col("quarter") == q, F.lit(text)).otherwise(label)
    years = spark.range(first_year, last_year + 1).select(F.col("id").alias("year"))
    quarters = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("quarter")
    return years.select("year", quarters).select(
        "year",
        "quarter",
        F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("quarter").cast("string")).alias("year_quarter_label"),
        label.alias("quarter_label"),
        (F.col("year") - F.lit(first_year) + 1).alias("year_index"),
    )


def dim_date_coverage(dates: DataFrame, stg_inpatient: DataFrame) -> DataFrame:
    """The calendar with the number of staged rows of each year (0 for none)."""
    staged = stg_inpatient.groupBy(F.col("data_year").alias("_year")).agg(F.count(F.lit(1)).alias("_n"))
    joined = dates.join(staged, F.col("year") == F.col("_year"), "left")
    return joined.select(*dates.columns, F.coalesce("_n", F.lit(0)).alias("staged_rows"))
