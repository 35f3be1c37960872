"""The balanced left join: whole results, no task with a hot key's rows, nulls passed round."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tierline.operators.joins import HOT, balanced_left_join, hot_keys


def _sides(spark, n=60_000):
    """A third of the rows on one provider, a tenth without one."""
    provider = (
        F.when(F.col("id") % 10 == 0, F.lit(None).cast("string"))
        .when(F.col("id") % 3 == 1, F.lit("HOT"))
        .otherwise(F.concat(F.lit("p"), (F.col("id") % 5003).cast("string")))
    )
    left = spark.range(n).select(provider.alias("provider_id"), F.col("id").alias("line"), (F.col("id") % 50).alias("volume"))
    names = ["HOT", *[f"p{i}" for i in range(0, 5003, 2)]]  # every other provider is unknown
    right = spark.createDataFrame([(p, f"class {i % 4}") for i, p in enumerate(names)] + [(None, "nobody")], "provider_id string, size string")
    return left, right


def test_equals_the_plain_left_join(spark):
    left, right = _sides(spark)
    got = balanced_left_join(left, right, ["provider_id"])
    want = left.join(right, "provider_id", "left").select(*got.columns)
    assert got.columns == ["provider_id", "line", "volume", "size"]
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("repeats", [1, 3])
def test_two_keys_and_repeated_right_rows(spark, repeats):
    left, right = _sides(spark, 6000)
    left = left.withColumn("year", F.col("line") % 2)
    right = right.crossJoin(spark.range(2).select(F.col("id").alias("year"))).crossJoin(spark.range(repeats).select(F.col("id").alias("copy")))
    got = balanced_left_join(left, right, ["provider_id", "year"], salts=7)
    want = left.join(right, ["provider_id", "year"], "left").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_no_task_gets_the_hot_key(spark):
    """Rows per task of a shuffled join, with and without the dealing."""
    left, right = _sides(spark)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)

        def tasks(df):
            return sorted(r[1] for r in df.where("provider_id IS NOT NULL").groupBy(F.spark_partition_id()).count().collect())

        plain = tasks(left.join(right, "provider_id", "left"))
        dealt = tasks(balanced_left_join(left, right, ["provider_id"]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plain[-1] > 3 * statistics.median(plain)
    assert dealt[-1] <= 2 * statistics.median(dealt)
    assert sum(plain) == sum(dealt) == left.where("provider_id IS NOT NULL").count()


def test_hot_keys_are_few_whatever_the_data(spark):
    left, _ = _sides(spark)
    assert [r.provider_id for r in hot_keys(left.where("provider_id IS NOT NULL"), ["provider_id"]).collect()] == ["HOT"]
    few = spark.range(HOT - 1).select(F.col("id").cast("string").alias("provider_id"))
    assert hot_keys(few, ["provider_id"]).count() == HOT - 1  # all of them, and never HOT
    many = spark.range(3 * HOT).select(F.col("id").cast("string").alias("provider_id"))
    assert hot_keys(many, ["provider_id"]).count() == 0


def test_empty_sides(spark):
    left, right = _sides(spark, 100)
    none = balanced_left_join(left.limit(0), right, ["provider_id"])
    assert none.count() == 0
    unmatched = balanced_left_join(left, right.limit(0), ["provider_id"])
    assert unmatched.count() == 100 and unmatched.where("size IS NOT NULL").count() == 0
