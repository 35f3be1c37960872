"""Mergeable states per year and state: distinct counts and quantiles without rescans.

A COUNT(DISTINCT) or a quantile of a region, of the nation or of several years cannot
be had from the same figure of their parts.  What can be merged is stored instead, one
row per (year, state) or a few:

* ``distinct_states``: bitmaps of dictionary codes.  A value's code is its position in
  the sorted list of all values; a bitmap row holds the codes of one block of 32,768.
  Any union of states and years is an OR of bitmaps, its distinct count the number of
  bits, exact.
* ``payment_states``: KLL sketches of the payments.  Sketches of any set of states and
  years merge to one, which answers every quantile of the set; the rank of the answer
  is off by at most ``rank_error`` of the rows.

A report over them reads the states, thousands of rows, however many rows were staged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators.quality import stack
from tierline.operators.ranking import POS, add_positions
from tierline.session import scratch_path
from tierline.sources.sinks import write_table

#: Size parameter of the sketches: about 3 * 8 * K bytes each.
K = 4000
PARTS = 4
STATE, YEAR = "provider_state", "data_year"


def rank_error(k: int = K) -> float:
    """Twice the rank error that a sketch of size k keeps in 99 of 100 cases
    (2.296 / k^0.9723): a bound no run should miss."""
    return 2 * 2.296 / k**0.9723


def payment_states(staged: DataFrame, value: str = "avg_total_payments", k: int = K) -> DataFrame:
    """One row per (year, state): number, extremes and sketch of the payments."""
    return staged.groupBy(YEAR, STATE).agg(
        F.count(value).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.expr(f"kll_sketch_agg_double({value}, {k})").alias("sketch"),
    )


def payment_boundaries(states: DataFrame, by: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """Per group of ``by`` (all rows without): n and ``boundaries``, the parts + 1
    values from the smallest to the largest that cut the payments in equal parts."""
    ranks = ", ".join(f"{i / parts}D" for i in range(parts + 1))
    merged = states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.expr("kll_merge_agg_double(sketch)").alias("sketch")
    )
    inner = F.expr(f"slice(kll_sketch_get_quantile_double(sketch, array({ranks})), 2, {parts - 1})")
    found = F.when(F.col("n") > 0, F.concat(F.array("low"), inner, F.array("high")))
    return merged.select(*by, "n", found.alias("boundaries"))


def boundary_check(staged: DataFrame, states: DataFrame, value: str = "avg_total_payments", k: int = K) -> DataFrame:
    """Per year and for all years (year NULL): n, the outer boundaries, and for
    each inner one whether its rank in the data is within ``rank_error``."""
    per_year = payment_boundaries(states, [YEAR])
    found = per_year.unionByName(payment_boundaries(states).withColumn(YEAR, F.lit(None).cast("bigint")).select(*per_year.columns))
    scopes = staged.select(F.explode(F.array(F.col(YEAR).cast("bigint"), F.lit(None).cast("bigint"))).alias("_scope"), F.col(value).alias("_v"))
    f = F.broadcast(found)  # one row per year, and one
    ranked = scopes.where("_v IS NOT NULL").join(f, F.col("_scope").eqNullSafe(F.col(YEAR)))
    n, allowed = F.first("n"), F.ceil(F.first("n") * rank_error(k))
    inside = []
    for i in range(1, PARTS):
        bound, goal = F.col("boundaries")[i], F.ceil(F.first("n") * i / PARTS)
        below, upto = F.count_if(F.col("_v") < bound), F.count_if(F.col("_v") <= bound)
        inside.append(((below + 1 <= goal + allowed) & (upto >= goal - allowed)).alias(f"q{i}_in_bound"))
    outer = [F.first(F.col("boundaries")[0]).alias("low"), F.first(F.col("boundaries")[PARTS]).alias("high")]
    return ranked.groupBy(F.col("_scope").alias("year")).agg(n.alias("n"), *outer, F.first(F.size("boundaries")).alias("n_boundaries"), *inside)


def codes(values: DataFrame, column: str) -> DataFrame:
    """(value, code): a dense whole number per different value, in their order."""
    different = values.select(F.col(column).alias("_value")).where("_value IS NOT NULL").distinct()
    return add_positions(different, ["_value"]).select("_value", F.col(POS).alias("_code"))


def distinct_states(staged: DataFrame, column: str) -> DataFrame:
    """(year, state, block, bitmap) of the codes of the column's values."""
    pairs = staged.select(YEAR, STATE, F.col(column).alias("_value")).where("_value IS NOT NULL").distinct()
    coded = pairs.join(codes(staged, column), "_value")
    return coded.groupBy(YEAR, STATE, F.bitmap_bucket_number("_code").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_code")).alias("bitmap")
    )


def distinct_counts(states: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct values per group of ``by`` from the bitmaps, by OR."""
    blocks = states.groupBy(*by, "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return blocks.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias(name))


@dataclass(frozen=True)
class Rollups:
    """The stored states of one staged table."""

    providers: DataFrame
    drgs: DataFrame
    payments: DataFrame


def build(staged: DataFrame) -> Rollups:
    """Compute and store the states."""
    spark = staged.sparkSession
    base = scratch_path(spark, "rollups")
    frames = {"providers": distinct_states(staged, "provider_id"), "drgs": distinct_states(staged, "drg_definition"), "payments": payment_states(staged)}
    return Rollups(**{name: write_table(df, f"{base}/{name}") for name, df in frames.items()})


def rollup_distinct(rollups: Rollups, dim_region: DataFrame) -> DataFrame:
    """Distinct providers and DRGs at every level: state and region per year,
    the nation per year and over all years."""
    region = dim_region.select(F.col("state_code").alias(STATE), "census_region")

    def level(label: str, place: str | None, year: bool) -> DataFrame:
        keys = [*([place] if place else []), *([YEAR] if year else [])]
        parts = []
        for states, name in ((rollups.providers, "distinct_providers"), (rollups.drgs, "distinct_drgs")):
            rows = states.join(region, STATE) if place == "census_region" else states
            parts.append(distinct_counts(rows, keys, name))
        # stacked and folded instead of joined: a group may have values of one column only
        rows = parts[0].unionByName(parts[1], allowMissingColumns=True)
        return rows.groupBy(*keys).agg(*[F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias(n) for n in ("distinct_providers", "distinct_drgs")]).select(
            F.lit(label).alias("level"),
            (F.col(place) if place else F.lit(None)).cast("string").alias("place"),
            (F.col(YEAR) if year else F.lit(None)).cast("bigint").alias("year"),
            "distinct_providers",
            "distinct_drgs",
        )

    return stack(
        [
            level("state", STATE, True),
            level("region", "census_region", True),
            level("nation", None, True),
            level("all years", None, False),
        ]
    )
