"""Generic data-quality operators (any table, any key, any threshold)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions.metrics import mean_round, mean_value, z_score


def null_counts(columns: Mapping[str, str | int | None], total: str = "total_rows") -> list[Column]:
    """``COUNTIF(col IS NULL) AS name`` per entry, plus ``COUNT(*)``.

    An entry mapped to an int or to ``None`` yields that literal as a bigint
    (typed NULL for ``None``); it aligns union branches whose table lacks the
    column.
    """
    out = []
    for name, column in columns.items():
        if isinstance(column, str):
            out.append(F.count_if(F.col(column).isNull()).cast("bigint").alias(name))
        else:
            out.append(F.lit(column).cast("bigint").alias(name))
    out.append(F.count(F.lit(1)).alias(total))
    return out


def null_profile(
    df: DataFrame,
    columns: Mapping[str, str | int | None],
    label: tuple[str, str] | None = None,
    total: str = "total_rows",
) -> DataFrame:
    """One-row null profile, optionally led by a literal label column."""
    lead = [F.lit(label[1]).alias(label[0])] if label else []
    return df.agg(*lead, *null_counts(columns, total))


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name of report rows."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_name: str = "row_count") -> DataFrame:
    """Key values held by more than one row (HAVING COUNT(*) > 1)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name)).filter(F.col(count_name) > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent row.  A NULL child key never matches, so
    it is reported, as LEFT JOIN ... WHERE parent.key IS NULL would.  Written
    as an anti join (Spark does not rewrite the outer-join form itself)."""
    keys = parent.select(F.col(parent_key).alias("_parent_key"))
    return child.join(keys, F.col(child_key) == F.col("_parent_key"), "left_anti")


def zscore_outliers(
    df: DataFrame,
    value: str,
    threshold: float,
    group_by: Sequence[str],
    digits: int = 2,
) -> DataFrame:
    """Rows with |z| > threshold, z from the mean / sample stddev of the
    row's group (``_mean_rounded``: the exact mean rounded to ``digits``).  Statistics are one row per group (partial aggregation),
    joined back on the group key — no cross join."""
    stats = df.groupBy(*group_by).agg(
        mean_value(value).alias("_mean"), mean_round(value, digits).alias("_mean_rounded"), F.stddev_samp(value).alias("_std")
    )
    d, s = df.alias("_d"), stats.alias("_s")
    on = reduce(lambda a, b: a & b, [F.col(f"_d.{k}").eqNullSafe(F.col(f"_s.{k}")) for k in group_by])
    z = z_score(F.col(f"_d.{value}"), F.col("_s._mean"), F.col("_s._std"))
    return (
        d.join(s, on)
        .select("_d.*", F.col("_s._mean"), F.col("_s._mean_rounded"), F.col("_s._std"), z.alias("_z"))
        .filter(F.abs(F.col("_z")) > threshold)
    )
