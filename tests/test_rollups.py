"""Merged states against whole-table figures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tierline.plans import rollups

SCHEMA = "data_year bigint, provider_state string, provider_id string, drg_definition string, avg_total_payments double"


def _staged(spark, n=40_000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = rnd.random() < 0.4
        state = rnd.choice(["AL", "AK", None, "TX"])
        pay = 100.0 if hot else None if rnd.random() < 0.05 else round(rnd.lognormvariate(8, 2), 2)
        rows.append((rnd.choice([2014, 2015]), state, f"p{rnd.randint(1, 3000)}", rnd.choice([None, *(f"d{i}" for i in range(200))]), pay))
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_distinct_counts_of_every_union_are_exact(spark):
    staged = _staged(spark)
    for column in ("provider_id", "drg_definition"):
        states = rollups.distinct_states(staged, column)
        for by in ([], ["data_year"], ["provider_state"], ["data_year", "provider_state"]):
            got = rollups.distinct_counts(states, by, "n").collect()
            want = staged.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count_distinct(column).alias("n")).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want)), (column, by)


def test_codes_beyond_one_bitmap(spark):
    """More values than the 32,768 codes of a block."""
    staged = spark.range(100_000).select(
        (F.col("id") % 2 + 2014).alias("data_year"), F.lit("AL").alias("provider_state"), (F.col("id") % 70_001).cast("string").alias("provider_id")
    )
    states = rollups.distinct_states(staged, "provider_id")
    assert states.select("block").distinct().count() == 3
    assert rollups.distinct_counts(states, [], "n").first().n == 70_001


@pytest.mark.parametrize("k", [64, rollups.K])
def test_boundaries_of_every_union_keep_the_stated_rank_error(spark, k):
    staged = _staged(spark)
    states = rollups.payment_states(staged, k=k)
    for where in ("true", "data_year = 2015", "provider_state IN ('AL', 'TX')", "provider_state IS NULL AND data_year = 2014"):
        found = rollups.payment_boundaries(states.where(where)).first()
        values = sorted(r[0] for r in staged.where(where).where("avg_total_payments IS NOT NULL").select("avg_total_payments").collect())
        assert found.n == len(values) and len(found.boundaries) == rollups.PARTS + 1
        assert (found.boundaries[0], found.boundaries[-1]) == (values[0], values[-1])
        for i, bound in enumerate(found.boundaries[1:-1], 1):
            goal, slack = i / rollups.PARTS * len(values), rollups.rank_error(k) * len(values) + 1
            assert sum(v < bound for v in values) <= goal + slack and sum(v <= bound for v in values) >= goal - slack


def test_merging_reads_the_states_only(spark):
    """The report's plan scans no staged table."""
    stored = rollups.build(_staged(spark, 2000))
    plan = rollups.payment_boundaries(stored.payments, ["data_year"])._jdf.queryExecution().optimizedPlan().toString()
    assert "avg_total_payments" not in plan and "sketch" in plan


def test_empty_and_valueless_tables(spark):
    empty = _staged(spark, 10).limit(0)
    assert rollups.payment_boundaries(rollups.payment_states(empty), ["data_year"]).count() == 0
    assert rollups.distinct_counts(rollups.distinct_states(empty, "provider_id"), ["data_year"], "n").count() == 0
    nothing = spark.createDataFrame([(2015, "AL", "p", None, None)], SCHEMA)
    row = rollups.payment_boundaries(rollups.payment_states(nothing), ["data_year"]).first()
    assert row.n == 0 and row.boundaries is None
