"""The distributed global ranking equals Spark's plain (single-task) windows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tierline.operators.ranking import (
    add_positions,
    cume_dist_of,
    exact_quantiles,
    percent_rank_of,
    running_totals_by,
    with_ntiles,
    with_rank_stats,
)

SCHEMA = "id bigint, g string, v double"


def _data(n: int, seed: int, null_share: float = 0.15, hot_share: float = 0.0, groups=("a", "b", None)):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        r = rnd.random()
        if r < null_share:
            v = None
        elif r < null_share + hot_share:
            v = 7.0
        else:
            v = float(rnd.randint(0, 40))  # many ties
        rows.append((i, rnd.choice(groups), v))
    return rows


CASES = [
    pytest.param(_data(500, 1), id="ties-and-nulls"),
    pytest.param(_data(400, 2, hot_share=0.6), id="hot-value"),
    pytest.param(_data(3, 3), id="n-below-k"),
    pytest.param(_data(1, 4, null_share=0.0), id="single-row"),
    pytest.param([(i, "a", None) for i in range(20)], id="all-null"),
]


def _naive(df, partition):
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    w = Window.partitionBy(*partition).orderBy(*order)
    wv = Window.partitionBy(*partition).orderBy(F.col("v").asc_nulls_first())
    return df.select(
        "id",
        F.ntile(4).over(w).cast("bigint").alias("q4"),
        F.ntile(10).over(w).cast("bigint").alias("q10"),
        F.row_number().over(w).cast("bigint").alias("rn"),
        F.percent_rank().over(wv).alias("pr"),
        F.cume_dist().over(wv).alias("cd"),
    )


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("partition", [[], ["g"]], ids=["global", "by-group"])
def test_matches_plain_window(spark, rows, partition):
    df = spark.createDataFrame(rows, SCHEMA)
    order = ["v", "id"]
    tiles = with_ntiles(df, {"q4": 4, "q10": 10}, order, partition).select("id", "q4", "q10")
    pos = add_positions(df, order, partition).select("id", F.col("_pos").alias("rn"))
    ranks = with_rank_stats(df, "v", partition).select(
        "id", percent_rank_of().alias("pr"), cume_dist_of().alias("cd")
    )
    got = tiles.join(pos, "id").join(ranks, "id")
    want = _naive(df, partition)
    cols = ["id", "q4", "q10", "rn", "pr", "cd"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_tile_sizes_differ_by_at_most_one(spark):
    df = spark.createDataFrame(_data(1003, 9, null_share=0.0), SCHEMA)
    tiled = with_ntiles(df, {"t": 10}, ["v", "id"])
    sizes = [r[1] for r in tiled.groupBy("t").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1 and sum(sizes) == 1003


def test_rows_never_meet_in_one_partition(spark):
    """Single-partition exchanges only carry bounded aggregates, never rows."""
    df = spark.createDataFrame(_data(200, 5), SCHEMA)
    for out in (with_ntiles(df, {"t": 4}, ["v", "id"]), with_rank_stats(df, "v", ["g"])):
        out.collect()
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        singles = [i for i, line in enumerate(lines) if re.search(r"Exchange (SinglePartition|hashpartitioning\(0,)", line)]
        assert singles
        for i in singles:
            assert "Aggregate(" in "".join(lines[i + 1 : i + 4]), lines[i : i + 4]


def test_building_a_plan_runs_no_job(spark):
    df = spark.range(100).select(F.col("id"), F.lit("a").alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    tracker = spark.sparkContext.statusTracker()
    group = "ranking-build"
    spark.sparkContext.setJobGroup(group, "no job expected")
    with_ntiles(df, {"t": 4}, ["v", "id"])
    with_rank_stats(df, "v", ["g"])
    exact_quantiles(df, "v", {"p": 0.5})
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_exact_quantiles_are_percentile_disc(spark):
    rows = _data(301, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_quantiles(df, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).first()
    vals = sorted(v for _, _, v in rows if v is not None)
    n = len(vals)

    def disc(p):  # smallest value whose cumulative share reaches p
        import math

        return vals[max(1, math.ceil(p * n)) - 1]

    assert (got["p25"], got["p50"], got["p75"]) == (disc(0.25), disc(0.5), disc(0.75))


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_top_k_rank_stats_match_plain_window(spark, rows, k):
    from tierline.operators.ranking import top_k_with_rank_stats

    df = spark.createDataFrame(rows, SCHEMA)
    got = top_k_with_rank_stats(df, "v", k, [F.col("id").asc()]).select(
        "id", percent_rank_of().alias("pr"), cume_dist_of().alias("cd")
    )
    wv = Window.orderBy(F.col("v").asc_nulls_first())
    want = (
        df.select("id", "v", F.percent_rank().over(wv).alias("pr"), F.cume_dist().over(wv).alias("cd"))
        .orderBy(F.col("v").desc_nulls_last(), F.col("id").asc())
        .limit(k)
        .select("id", "pr", "cd")
    )
    assert sorted(got.collect()) == sorted(want.collect())


def _disc(vals, p):
    import math

    vals = sorted(vals)
    return vals[max(1, math.ceil(p * len(vals))) - 1] if vals else None


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_exact_quantiles_by_selection(spark, hot):
    rnd = random.Random(7)
    rows = [(i, "a", (3.5 if rnd.random() < hot else float(rnd.randint(0, 5000)) / 7) if rnd.random() > 0.05 else None)
            for i in range(30000)]
    df = spark.createDataFrame(rows, SCHEMA)
    probs = {"p0": 0.0, "p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p999": 0.999, "p1": 1.0}
    got = exact_quantiles(df, "v", probs).first()
    vals = [v for _, _, v in rows if v is not None]
    assert {k: got[k] for k in probs} == {k: _disc(vals, p) for k, p in probs.items()}


def test_exact_quantiles_empty(spark):
    empty = spark.createDataFrame([(1, "a", None)], SCHEMA)
    assert tuple(exact_quantiles(empty, "v", {"p50": 0.5}).first()) == (None,)


def test_many_rows_fill_many_buckets(spark):
    df = spark.range(20000).select(F.col("id"), (F.col("id") * 7919 % 20011).cast("double").alias("v"))
    got = add_positions(df, ["v", "id"])
    want = df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn"))
    assert got.join(want, "id").where("_pos <> rn OR _cnt <> 20000").count() == 0


def test_buckets_follow_the_partitions_and_stay_below_the_stated_size(spark):
    """Skewed values, a hot value cut by its tie-breaker, text keys with a long common prefix."""
    from tierline.operators import ranking

    n = 200_000
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.exp((F.col("id") * 7919 % 100_003) / 5000.0)).alias("v"),
        F.concat(F.lit("Supplier#0000000000"), F.col("id").cast("string")).alias("name"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, buckets in ((8, 1024), (600, 4096)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert 1 << ranking.bucket_bits(df) == buckets
            for order in (["v", "name"], ["name"], ["v", "id"]):
                sizes = [r[1] for r in ranking._bucketed(df, order).groupBy("_bucket").count().collect()]
                assert sum(sizes) == n
                assert max(sizes) <= ranking.MOST * n / buckets
                assert len(sizes) > 0.9 * buckets
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_lambda_runs_over_the_bounds_of_a_row(spark):
    df = spark.createDataFrame(_data(200, 5), SCHEMA)
    plan = with_ntiles(df, {"t": 4}, ["v", "id"])._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "_bucket" in line]
    assert rows and not any("lambdafunction" in line for line in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1023, 1024, 1025])
def test_few_rows_and_missing_bounds(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % 11).alias("v"), "id")
    got = add_positions(df, ["v", "id"])
    want = df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn"))
    assert got.join(want, "id").where(f"_pos = rn AND _cnt = {n}").count() == n


@pytest.mark.parametrize("rows", CASES)
def test_running_totals_by_equal_the_plain_window(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = running_totals_by(df, ["g"], ["v", "id"], F.col("id"), "total")
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("total", F.sum("id").over(w))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_running_totals_of_a_hot_partition(spark):
    """Half of the rows in one of three partitions: no bucket, so no task of
    the window, holds more than the stated multiple of the average."""
    from tierline.operators import ranking

    n = 300_000
    region = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 4 == 1, F.lit("b")).otherwise(F.lit("c"))
    df = spark.range(n).select("id", region.alias("g"), (F.col("id") * 7919 % 100_003).alias("v"), (F.col("id") % 13).alias("w"))
    sizes = [r[1] for r in ranking._bucketed(df, ["g", "v", "id"]).groupBy("_bucket").count().collect()]
    assert max(sizes) <= ranking.MOST * n / (1 << ranking.bucket_bits(df))
    got = running_totals_by(df, ["g"], ["v", "id"], F.col("w"), "total")
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("w").over(w).alias("want"))
    assert got.join(want, "id").where("NOT total <=> want").count() == 0
