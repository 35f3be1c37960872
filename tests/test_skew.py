"""A key holding a third of all rows: results stay whole and exact, and the
range sort spreads a hot value instead of sending it to one task."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from tierline.functions.metrics import mean_round, ratio
from tierline.operators.ranking import _bucketed, add_positions
from tierline.plans import intermediate, staging
from tierline.sources.schemas import INPATIENT


def _raw(n: int, seed: int):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        pid = "HOT" if i % 3 == 0 else f"P{rnd.randint(1, 40)}"
        drg = f"{rnd.randint(1, 12):03d} - DRG"
        rows.append((pid, f"name {pid}", "st", "city", "AL", "1", "hrr", drg, rnd.randint(1, 50),
                     round(rnd.uniform(10, 900), 2), round(rnd.uniform(10, 900), 2), round(rnd.uniform(5, 800), 2)))
    return rows


def test_hot_provider_summary_matches_brute_force(spark):
    rows = _raw(6000, 3)
    raw = spark.createDataFrame(rows, INPATIENT).repartition(16)
    got = {
        r.provider_id: r
        for r in intermediate.int_provider_inpatient_summary(staging.stg_inpatient_charges({2015: raw})).collect()
    }
    pdf = pd.DataFrame(rows, columns=INPATIENT.fieldNames())
    pdf["code"] = pdf.drg_definition.str.split(" ").str[0].astype(int)
    for pid, g in pdf.groupby("provider_id"):
        r = got[pid]
        assert r.total_discharges == g.total_discharges.sum()
        assert r.distinct_drg_count == g.code.nunique()
    hot = pdf[pdf.provider_id == "HOT"]
    assert len(hot) == 2000
    # exact mean of cent amounts, rounded half-up
    from decimal import ROUND_HALF_UP, Decimal

    exact = sum(Decimal(str(v)) for v in hot.average_covered_charges) / len(hot)
    assert got["HOT"].avg_covered_charges == float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_hot_value_is_split_across_buckets(spark):
    df = spark.range(0, 60000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise((F.col("id") % 997).cast("double")).alias("v"),
        F.col("id"),
    )
    sizes = [r[1] for r in _bucketed(df, ["v", "id"]).groupBy("_bucket").count().collect()]
    assert max(sizes) < 60000 / 100  # no bucket holds the whole hot value (20000 rows)
    pos = add_positions(df, ["v", "id"])
    assert pos.agg(F.max("_pos")).first()[0] == 60000


def test_exact_mean_independent_of_partitioning(spark):
    vals = [(round(random.Random(i).uniform(0, 1000), 2),) for i in range(5000)]
    base = spark.createDataFrame(vals, "x double")
    results = {base.repartition(n).agg(mean_round("x", 2)).first()[0] for n in (1, 3, 17, 64)}
    assert len(results) == 1


def _shuffled_records(spark, df):
    """Rows written by each shuffle of a frame, which is run."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")  # planned anew
        rows = df.collect()
        found, nodes = [], [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Exchange":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        return rows, found
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_sums_are_not_shuffled_with_every_distinct_code(spark):
    """the rows of a group and its neighbouring codes collapse map-side; before,
    each of the 600 (group, code) pairs carried the sums through the shuffle."""
    rows = spark.range(0, 6000, 1, 4).select(
        (F.col("id") % 10).cast("string").alias("provider_id"),
        *[F.lit("x").alias(c) for c in ("provider_name", "provider_state", "provider_city", "hrr_description")],
        F.lit(2015).cast("bigint").alias("data_year"),
        (F.floor(F.col("id") / 10) % 60).alias("drg_code"),
        F.lit(1).cast("bigint").alias("total_discharges"),
        *[F.lit(2.5).alias(c) for c in ("avg_covered_charges", "avg_total_payments", "avg_medicare_payments")],
    )
    got, shuffled = _shuffled_records(spark, intermediate.int_provider_inpatient_summary(rows))
    assert sorted((r.provider_id, r.distinct_drg_count, r.total_discharges, r.avg_total_payments) for r in got) == [
        (str(i), 60, 600, 2.5) for i in range(10)
    ]
    assert shuffled and max(shuffled) <= 4 * 2 * 10, shuffled  # 4 tasks, 10 groups, as measures and as values


def test_summaries_match_plain_aggregates(spark):
    """Distinct counts and means of the summaries against COUNT(DISTINCT) and the
    one-step mean, over codes of all kinds, null keys, null values and repeated rows."""
    rnd = random.Random(11)
    codes = [None, 0, 1, 63, 64, 65, -1, -64, -65, 2**62, -(2**63), 2**63 - 1]
    value = lambda: rnd.choice([None, 0.0, 0.125, 7.33, 1e13, 123456.789, -2.5])
    rows = [
        (rnd.choice([None, "a", "b"]), rnd.choice([None, "AL"]), rnd.choice([2014, 2015]), rnd.choice(codes), rnd.choice([None, 1, 5]), value(), value(), value())
        for _ in range(400)
    ]
    rows += [("only nulls", "AL", 2015, None, None, None, None, None)] + rows[:50]
    schema = "provider_id string, provider_state string, data_year bigint, code bigint, n bigint, u double, v double, w double"
    df = spark.createDataFrame(rows, schema).repartition(7)
    empty = [F.lit(None).cast("string").alias(c) for c in ("provider_name", "provider_city", "hrr_description")]
    keys = ["provider_id", "provider_name", "provider_state", "provider_city", "hrr_description", "data_year"]
    inpatient = df.select("*", *empty).withColumnsRenamed(
        {"code": "drg_code", "n": "total_discharges", "u": "avg_covered_charges", "v": "avg_total_payments", "w": "avg_medicare_payments"}
    )
    plain = inpatient.groupBy(*keys).agg(
        F.count_distinct("drg_code").alias("distinct_drg_count"),
        F.sum("total_discharges").alias("total_discharges"),
        *[mean_round(c, 2).alias(c) for c in ("avg_covered_charges", "avg_total_payments", "avg_medicare_payments")],
        F.round(ratio(F.avg("avg_medicare_payments"), F.avg("avg_covered_charges")), 4).alias("medicare_payment_ratio"),
    )
    got = intermediate.int_provider_inpatient_summary(inpatient)
    assert got.dtypes == plain.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))

    outpatient = df.select("*", *empty[:2], F.col("code").cast("string").alias("apc")).withColumnsRenamed(
        {"n": "outpatient_services", "u": "avg_submitted_charges", "v": "avg_total_payments"}
    )
    plain = outpatient.groupBy(*[k for k in keys if k != "hrr_description"]).agg(
        F.count_distinct("apc").alias("distinct_apc_count"),
        F.sum("outpatient_services").alias("total_outpatient_services"),
        *[mean_round(c, 2).alias(c) for c in ("avg_submitted_charges", "avg_total_payments")],
    )
    got = intermediate.int_provider_outpatient_summary(outpatient)
    assert got.dtypes == plain.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
