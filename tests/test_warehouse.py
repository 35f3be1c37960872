
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tierline.plans import kpis, quality, views, windows
from tierline.plans.build import materialise, table_row_counts
from tests.fixtures import fixture_warehouse


@pytest.fixture(scope="module")
def wh(spark):
    return fixture_warehouse(spark)


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_staging_filters_and_cleaning(wh):
    stg = wh.model("stg_inpatient_charges")
    assert stg.count() == 10
    names = {r.provider_name for r in stg.collect()}
    assert "ALPHA HOSP" in names and not any(n.startswith(" ") for n in names)
    assert {"NOID", "NODIS", "ZEROPAY", "NEGPAY", "MAXPAY", "NULLPAY"}.isdisjoint(names)
    assert "ZETA" in names  # 999999.99 is inside the strict bound
    codes = _rows(stg.filter(F.col("data_year") == 2015), "provider_name", "drg_code")
    assert ("ALPHA HOSP", 39) in codes and ("ALPHA HOSP", 470) in codes
    assert ("BETA", None) in codes and ("BETA INC", None) in codes
    assert stg.schema["drg_code"].dataType.simpleString() == "bigint"
    assert stg.schema["data_year"].dataType.simpleString() == "bigint"


def test_outpatient_has_no_upper_bound_and_text_zip(wh):
    out = wh.model("stg_outpatient_charges")
    assert out.count() == 3
    assert out.agg(F.max("avg_total_payments")).first()[0] == 2000000.0
    assert out.schema["provider_zipcode"].dataType.simpleString() == "string"
    assert wh.model("stg_physicians").count() == 3


def test_provider_combined_zero_fill_and_loss(wh):
    c = wh.model("int_provider_combined")
    got = _rows(
        c.filter(F.col("provider_id") == "10001"),
        "data_year", "total_outpatient_services", "avg_outpatient_payment", "total_patient_volume",
    )
    assert got == [(2014, 0, 0.0, 5000), (2015, 500, 1000025.0, 2500)]
    assert c.filter(F.col("provider_id") == "10008").count() == 0  # outpatient-only is lost
    assert c.filter(F.col("provider_id") == "10002").count() == 2  # spelling fan-out kept


def test_inpatient_summary_ratio_guards(wh):
    s = wh.model("int_provider_inpatient_summary")
    r = {(x.provider_id, x.provider_name): x for x in s.filter(F.col("data_year") == 2015).collect()}
    alpha = r[("10001", "ALPHA HOSP")]
    assert (alpha.distinct_drg_count, alpha.total_discharges, alpha.avg_covered_charges) == (2, 2000, 300.0)
    assert alpha.medicare_payment_ratio == 0.4
    assert r[("10006", "ZETA")].medicare_payment_ratio is None  # covered average 0
    assert r[("10005", "EPSILON")].medicare_payment_ratio is None  # medicare missing
    assert r[("10002", "BETA")].distinct_drg_count == 0  # unparsable DRG text


def test_state_metrics_no_zero_fill(wh):
    m = {(x.state, x.data_year): x for x in wh.model("int_state_metrics").collect()}
    assert m[("AL", 2014)].combined_cost_index is None
    al = m[("AL", 2015)]
    assert (al.inpatient_provider_count, al.total_inpatient_discharges, al.avg_inpatient_payment) == (2, 3000, 130.0)
    assert (al.outpatient_provider_count, al.total_outpatient_services) == (2, 600)
    assert al.combined_cost_index == pytest.approx(111224.445, abs=0.006)
    assert (None, 2015) in m  # NULL state is its own group, its outpatient side never matches


def test_physician_summary(wh):
    p = wh.model("int_physician_summary").first()
    assert (p.distinct_physicians, p.total_services, p.total_beneficiaries) == (2, 45.0, 3.0)
    assert (p.avg_medicare_payment, p.avg_submitted_charge, p.payment_to_charge_ratio) == (50.0, 83.33, 0.6)


def test_dim_provider_latest_and_sizes(wh):
    d = {x.provider_id: x for x in wh.model("dim_provider").collect()}
    assert len(d) == 7
    assert (d["10001"].provider_name, d["10001"].provider_city, d["10001"].lifetime_discharges) == (
        "ALPHA HOSP", "Birmingham", 2000)
    assert d["10002"].provider_name == "BETA"  # the spelling with more discharges
    sizes = {k: v.provider_size_category for k, v in d.items()}
    assert sizes == {
        "10001": "Medium", "10002": "Small", "10003": "Large", "10004": "Medium",
        "10005": "Small", "10006": "Small", "10007": "Small",
    }


def test_dim_region_defaults(wh):
    got = _rows(wh.model("dim_region"), "state_code", "state_name", "census_region")
    assert got == [
        ("AL", "Alabama", "South"),
        ("DC", "Washington DC", "South"),
        ("PR", "PR", "West"),
        ("TX", "Texas", "South"),
        ("XX", "XX", "West"),
    ]


def test_dim_date(wh):
    got = _rows(wh.model("dim_date"), "year", "quarter", "year_quarter_label", "quarter_label", "year_index")
    assert len(got) == 8
    assert got[0] == (2014, 1, "2014-Q1", "Q1 (Jan-Mar)", 1)
    assert got[-1] == (2015, 4, "2015-Q4", "Q4 (Oct-Dec)", 2)


def test_fact_blend_and_rounding(wh):
    f = wh.fact
    assert f.count() == 9
    a15 = f.filter((F.col("provider_id") == "10001") & (F.col("year") == 2015)).first()
    assert (a15.combined_avg_cost, a15.outpatient_volume_share_pct, a15.inpatient_to_medicare_ratio) == (
        200165.0, 20.0, 1.6667)
    assert (a15.provider_size_category, a15.census_region) == ("Medium", "South")
    a14 = f.filter((F.col("provider_id") == "10001") & (F.col("year") == 2014)).first()
    assert a14.combined_avg_cost == 90.0  # inpatient only
    assert f.schema["loaded_at"].dataType.simpleString() == "timestamp"


def test_dq_checks_find_the_planted_problems(wh):
    f, dp, dr = wh.fact, wh.model("dim_provider"), wh.model("dim_region")
    assert _rows(quality.dq_duplicates_fact(f), "provider_id", "year", "row_count") == [("10002", 2015, 2)]
    assert quality.dq_duplicates_provider(dp).count() == 0
    assert quality.dq_duplicates_region(dr).count() == 0
    assert quality.dq_orphans_provider(f, dp).count() == 0
    assert _rows(quality.dq_orphans_region(f, dr), "state_code", "unmatched_rows") == [(None, 1)]
    report = [tuple(r) for r in quality.dq_health_report(f, dp, dr).collect()]
    assert report == [
        ("No duplicate provider+year", "FAIL"),
        ("dim_region covers 50+ states", "FAIL"),
        ("Both years present in fact table", "PASS"),
        ("Fact table has rows", "PASS"),
        ("dim_provider has rows", "PASS"),
    ]
    nulls = {r.table_name: tuple(r)[1:] for r in quality.dq_nulls(
        wh.model("stg_inpatient_charges"), wh.model("stg_outpatient_charges"), wh.model("stg_physicians")).collect()}
    assert nulls == {
        "stg_inpatient_charges": (0, 1, 0, 0, 1, 0, 10),
        "stg_outpatient_charges": (0, 0, 0, 0, 0, None, 3),
        "stg_physicians": (0, 0, 0, 0, 0, None, 3),
    }


def test_health_report_fails_on_empty_fact(wh):
    empty = wh.fact.limit(0)
    report = dict(tuple(r) for r in quality.dq_health_report(empty, wh.model("dim_provider"), wh.model("dim_region")).collect())
    assert report["Fact table has rows"] == "FAIL"
    assert report["Both years present in fact table"] == "FAIL"
    assert report["No duplicate provider+year"] == "PASS"


def test_yoy_needs_both_years(wh):
    got = kpis.kpi_yoy_change(wh.fact, 2015, 2014).collect()
    assert [r.state_code for r in got] == ["AL"]
    assert set(got[0].asDict()) == {"state_code", "avg_cost_2014", "avg_cost_2015", "absolute_change", "pct_change"}
    v = views.vw_yoy_change(wh.fact, 2015, 2014).first()
    assert v.cost_trend in {"Increasing", "Decreasing", "Stable"}


def test_materialise_round_trip(wh, tmp_path):
    built = materialise(wh, str(tmp_path / "wh"))
    counts = dict(tuple(r) for r in table_row_counts(built).collect())
    assert counts["fact_healthcare_metrics"] == 9 and counts["dim_provider"] == 7
    again = materialise(wh, str(tmp_path / "wh2"))
    assert dict(tuple(r) for r in table_row_counts(again).collect()) == counts


# -- windows on a hand-made fact ---------------------------------------------

FACT_SCHEMA = (
    "provider_id string, provider_name string, state_code string, census_region string, "
    "provider_size_category string, year bigint, avg_inpatient_payment double, total_discharges bigint"
)


def _fact(spark, rows):
    return spark.createDataFrame(
        [(p, f"N{p}", s, "South", "Small", y, v, 10) for p, s, y, v in rows], FACT_SCHEMA
    )


def test_rank_family_and_qualify_keeps_ties(spark):
    costs = [100.0, 90.0, 90.0, 80.0, 70.0, 60.0, 50.0]
    f = _fact(spark, [(f"p{i}", "S1", 2015, c) for i, c in enumerate(costs)])
    got = _rows(windows.win_rank_topn(f, 2015, 5), "avg_cost", "row_num", "cost_rank", "cost_dense_rank")
    assert got == [(70.0, 5, 5, 4), (80.0, 4, 4, 3), (90.0, 2, 2, 2), (90.0, 3, 2, 2), (100.0, 1, 1, 1)]


def test_rank_topn_keeps_ties_at_the_cut(spark):
    f = _fact(spark, [(f"p{i}", "S1", 2015, c) for i, c in enumerate([5.0, 4.0, 3.0, 2.0, 1.0, 1.0, 0.5])])
    assert windows.win_rank_topn(f, 2015, 5).count() == 6


def test_lag_lead_by_row_not_by_year(spark):
    f = _fact(spark, [("a", "S", 2014, 10.0), ("a", "S", 2015, 12.0), ("b", "S", 2015, 5.0),
                      ("c", "S", 2013, 8.0), ("c", "S", 2015, 4.0)])
    got = {(r.provider_id, r.year): (r.prev_year_cost, r.next_year_cost, r.yoy_change, r.yoy_pct_change)
           for r in windows.win_lag_lead(f).collect()}
    assert got[("a", 2015)] == (10.0, None, 2.0, 20.0)
    assert got[("b", 2015)] == (None, None, None, None)
    assert got[("c", 2015)] == (8.0, None, -4.0, -50.0)  # gap: previous row is 2013


def test_ntile_remainders_and_small_n(spark):
    f5 = _fact(spark, [(f"p{i}", "S", 2015, float(i)) for i in range(5)])
    assert [r.cost_quartile for r in windows.win_ntile(f5, 2015).collect()] == [1, 1, 2, 3, 4]
    f3 = _fact(spark, [(f"p{i}", "S", 2015, float(i)) for i in range(3)])
    got = windows.win_ntile(f3, 2015).collect()
    assert [r.cost_quartile for r in got] == [1, 2, 3]
    assert [r.cost_quartile_label for r in got] == ["Low cost (Q1)", "Below average (Q2)", "Above average (Q3)"]
    f1 = _fact(spark, [("p", "S", 2015, 3.0)])
    assert [tuple(r)[-2:] for r in windows.win_percentiles(f1, 2015).collect()] == [(0.0, 100.0)]


def test_rolling_and_cumulative(spark):
    f = _fact(spark, [("a", "S", 2014, 10.0), ("a", "S", 2015, 20.0), ("b", "T", 2015, 30.0)])
    got = _rows(windows.win_rolling_avg(f), "state_code", "year", "rolling_2yr_avg_cost", "cumulative_discharges")
    assert got == [("S", 2014, 10.0, 10), ("S", 2015, 15.0, 20), ("T", 2015, 30.0, 10)]
    share = _rows(windows.win_cumulative_share(f), "year", "cumulative_discharges", "pct_of_national_volume")
    assert share == [(2014, 10, 100.0), (2015, 30, 100.0)]


def test_zscore_outliers(spark):
    flat = _fact(spark, [(f"p{i}", "S", 2015, 100.0) for i in range(10)])
    assert quality.dq_outliers_zscore(flat, 2015, 3.0).count() == 0  # stddev 0 -> z NULL
    spike = _fact(spark, [(f"p{i}", "S", 2015, 100.0) for i in range(20)] + [("x", "S", 2015, 10000.0)])
    got = quality.dq_outliers_zscore(spike, 2015, 3.0).collect()
    assert [r.provider_id for r in got] == ["x"] and got[0].z_score > 3


def test_materialise_into_catalog_and_query_by_name(spark, wh, tmp_path):
    from tierline.plans.build import register_tables

    spark.sql(f"CREATE DATABASE IF NOT EXISTS fixture_wh LOCATION '{tmp_path / 'db'}'")
    built = materialise(wh, database="fixture_wh")
    assert spark.table("fixture_wh.fact_healthcare_metrics").count() == 9
    assert built.fact.count() == 9
    rebuilt = materialise(wh, database="fixture_wh")  # full refresh replaces the tables
    assert rebuilt.fact.count() == 9
    register_tables(rebuilt, prefix="fx_")
    got = spark.sql(
        "SELECT census_region, COUNT(*) AS n FROM fx_fact_healthcare_metrics GROUP BY census_region"
    ).collect()
    assert sum(r.n for r in got) == 9


def test_cli_over_raw_parquet(spark, tmp_path, capsys):
    from tests.fixtures import INPATIENT_2014, INPATIENT_2015, OUTPATIENT_2015, PHYSICIANS_2014
    from tierline.__main__ import main
    from tierline.sources.schemas import INPATIENT, OUTPATIENT, PHYSICIANS

    tables = {
        "inpatient_charges:2015": (INPATIENT_2015, INPATIENT),
        "inpatient_charges:2014": (INPATIENT_2014, INPATIENT),
        "outpatient_charges:2015": (OUTPATIENT_2015, OUTPATIENT),
        "physicians_and_other_supplier:2014": (PHYSICIANS_2014, PHYSICIANS),
    }
    args = []
    for key, (rows, schema) in tables.items():
        path = str(tmp_path / key.replace(":", "_"))
        spark.createDataFrame(rows, schema).write.parquet(path)
        args += ["--raw", f"{key}={path}"]
    main(args + ["--out", str(tmp_path / "wh"), "--report", "dq_duplicates_fact", "--report", "dim_region"])
    out = capsys.readouterr().out
    assert "== dq_duplicates_fact" in out and "10002" in out
    assert "Washington DC" in out


def test_yoy_view_trend_labels(spark):
    rows = []
    for state, (prev, cur) in {"A": (100.0, 103.0), "B": (100.0, 97.0), "C": (100.0, 103.01),
                               "D": (0.0, 5.0), "E": (100.0, 96.0)}.items():
        rows += [(f"{state}1", state, 2014, prev), (f"{state}1", state, 2015, cur)]
    f = _fact(spark, rows)
    got = {r.state_code: (r.cost_trend, r.pct_change) for r in views.vw_yoy_change(f, 2015, 2014).collect()}
    assert got == {
        "A": ("Stable", 3.0), "B": ("Stable", -3.0), "C": ("Increasing", 3.01),
        "D": ("Stable", None), "E": ("Decreasing", -4.0),
    }


def test_materialise_raw_round_trip(wh, tmp_path):
    from tierline.sources.testdata import materialise_raw

    stored = materialise_raw(wh.raw, str(tmp_path / "raw"))
    assert {y: df.count() for y, df in stored.inpatient.items()} == {2015: 14, 2014: 2}
    assert stored.outpatient[2015].count() == 5 and stored.physicians[2014].count() == 6
    assert stored.inpatient[2015].columns == wh.raw.inpatient[2015].columns


def test_views_are_queryable_by_name(spark, wh):
    names = views.register_views(wh.fact, 2015, 2014)
    assert set(names) == {
        "vw_cost_by_state", "vw_provider_details", "vw_yoy_change", "vw_region_summary", "vw_size_category_comparison",
    }
    got = spark.sql(
        "SELECT census_region, SUM(provider_count) AS n FROM vw_cost_by_state WHERE year = 2015 GROUP BY census_region"
    ).collect()
    assert sum(r.n for r in got) == 6  # distinct 2015 providers; the two spellings of 10002 count once
    assert spark.sql("SELECT COUNT(*) AS c FROM vw_provider_details").first().c == 9


def test_catalog_views_are_live_and_persistent(spark, wh):
    spark.sql("CREATE DATABASE IF NOT EXISTS views_test")
    wh.fact.write.mode("overwrite").partitionBy("year").saveAsTable("views_test.fact")
    names = views.create_views(spark, "views_test.fact", 2015, 2014, database="views_test")
    frames = views.register_views(spark.read.table("views_test.fact"), 2015, 2014)
    for name, want in zip(names, frames.values()):
        got = spark.sql(f"SELECT * FROM {name}")
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name
    before = {n: sorted(map(repr, spark.newSession().sql(f"SELECT * FROM {n}").collect())) for n in names}
    new = spark.read.table("views_test.fact").select(
        *[F.concat("provider_id", F.lit("-2")).alias(c) if c == "provider_id" else (F.col(c) * 2).alias(c) if c == "avg_inpatient_payment" else F.col(c) for c in spark.read.table("views_test.fact").columns]
    )
    spark.createDataFrame(new.collect(), new.schema).write.mode("append").insertInto("views_test.fact")
    for name in names:  # the session that wrote, and one that starts later
        for session in (spark, spark.newSession()):
            assert sorted(map(repr, session.sql(f"SELECT * FROM {name}").collect())) != before[name], name
    assert spark.sql("SELECT COUNT(*) AS c FROM views_test.vw_provider_details").first().c == 18


def test_stored_fact_is_partitioned_and_superseded_builds_go(spark, wh):
    import os

    first = materialise(wh)
    second = materialise(wh, replaces=first)
    local = lambda p: p.removeprefix("file:")
    assert not os.path.exists(local(first.location)) and os.path.exists(local(second.location))
    plan = kpis.kpi_cost_by_state(second.fact, 2015)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert second.fact.dtypes == wh.fact.dtypes


def test_dim_date_covers_the_configured_years(spark):
    from tierline.plans.dimensions import dim_date, dim_date_coverage

    dates = dim_date(spark, 2014, 2015)
    staged = spark.createDataFrame([(2015,), (2015,)], "data_year bigint")
    got = _rows(dim_date_coverage(dates, staged), "year", "quarter", "year_index", "staged_rows")
    assert got == [(y, q, y - 2013, 2 if y == 2015 else 0) for y in (2014, 2015) for q in (1, 2, 3, 4)]


def test_duplicate_and_orphan_checks_find_what_is_planted(spark, wh):
    provider, region = wh.model("dim_provider"), wh.model("dim_region")
    assert [tuple(r) for r in quality.dq_duplicates_provider(provider.unionByName(provider.where("provider_id = '10001'"))).collect()] == [("10001", 2)]
    assert [tuple(r) for r in quality.dq_duplicates_region(region.unionByName(region.where("state_code = 'AL'"))).collect()] == [("AL", 2)]
    orphans = quality.dq_orphans_provider(wh.fact, provider.where("provider_id <> '10001'"))
    assert _rows(orphans, "provider_id", "year") == [("10001", 2014), ("10001", 2015)]
