"""Value maps of the region dimension and the calendar labels.

The maps are small, fixed-size tables; they reach the plan as broadcast
lookup DataFrames (size bound = number of entries), so the join never
shuffles the probe side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values (must equal the reference): state code, state name, census
# region. Codes without a region fall to the default region 'West'; codes not
# listed at all keep the code as their name.
US_STATES: tuple[tuple[str, str, str | None], ...] = (
    ("CT", "Connecticut", "Northeast"),
    ("ME", "Maine", "Northeast"),
    ("MA", "Massachusetts", "Northeast"),
    ("NH", "New Hampshire", "Northeast"),
    ("RI", "Rhode Island", "Northeast"),
    ("VT", "Vermont", "Northeast"),
    ("NJ", "New Jersey", "Northeast"),
    ("NY", "New York", "Northeast"),
    ("PA", "Pennsylvania", "Northeast"),
    ("IL", "Illinois", "Midwest"),
    ("IN", "Indiana", "Midwest"),
    ("MI", "Michigan", "Midwest"),
    ("OH", "Ohio", "Midwest"),
    ("WI", "Wisconsin", "Midwest"),
    ("IA", "Iowa", "Midwest"),
    ("KS", "Kansas", "Midwest"),
    ("MN", "Minnesota", "Midwest"),
    ("MO", "Missouri", "Midwest"),
    ("NE", "Nebraska", "Midwest"),
    ("ND", "North Dakota", "Midwest"),
    ("SD", "South Dakota", "Midwest"),
    ("DE", "Delaware", "South"),
    ("FL", "Florida", "South"),
    ("GA", "Georgia", "South"),
    ("MD", "Maryland", "South"),
    ("NC", "North Carolina", "South"),
    ("SC", "South Carolina", "South"),
    ("VA", "Virginia", "South"),
    ("DC", "Washington DC", "South"),
    ("WV", "West Virginia", "South"),
    ("AL", "Alabama", "South"),
    ("KY", "Kentucky", "South"),
    ("MS", "Mississippi", "South"),
    ("TN", "Tennessee", "South"),
    ("AR", "Arkansas", "South"),
    ("LA", "Louisiana", "South"),
    ("OK", "Oklahoma", "South"),
    ("TX", "Texas", "South"),
    ("AZ", "Arizona", None),
    ("CO", "Colorado", None),
    ("ID", "Idaho", None),
    ("MT", "Montana", None),
    ("NV", "Nevada", None),
    ("NM", "New Mexico", None),
    ("UT", "Utah", None),
    ("WY", "Wyoming", None),
    ("AK", "Alaska", None),
    ("CA", "California", None),
    ("HI", "Hawaii", None),
    ("OR", "Oregon", None),
    ("WA", "Washington", None),
)
DEFAULT_REGION = "West"

# Calendar quarter labels.
QUARTER_LABELS: tuple[tuple[int, str], ...] = (
    (1, "Q1 (Jan-Mar)"),
    (2, "Q2 (Apr-Jun)"),
    (3, "Q3 (Jul-Sep)"),
    (4, "Q4 (Oct-Dec)"),
)

NAME_SCHEMA = T.StructType(
    [
        T.StructField("lookup_code", T.StringType(), False),
        T.StructField("lookup_name", T.StringType(), True),
    ]
)
REGION_SCHEMA = T.StructType(
    [
        T.StructField("lookup_code", T.StringType(), False),
        T.StructField("lookup_region", T.StringType(), True),
    ]
)


def state_name_lookup(
    spark: SparkSession, entries: Iterable[tuple[str, str, str | None]] = US_STATES
) -> DataFrame:
    """(lookup_code, lookup_name) for every listed code."""
    return spark.createDataFrame([(c, n) for c, n, _ in entries], NAME_SCHEMA)


def census_region_lookup(
    spark: SparkSession, entries: Iterable[tuple[str, str, str | None]] = US_STATES
) -> DataFrame:
    """(lookup_code, lookup_region) for codes that have an explicit region."""
    return spark.createDataFrame(
        [(c, r) for c, _, r in entries if r is not None], REGION_SCHEMA
    )
