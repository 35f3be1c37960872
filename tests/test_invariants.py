
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tierline.plans import windows
from tierline.plans.build import materialise
from tierline.queries import testdata_warehouse as build_warehouse

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    return materialise(build_warehouse(spark, SF_DIR), str(tmp_path_factory.mktemp("wh")))


def test_fact_grain_is_provider_year(wh):
    f = wh.fact
    assert f.count() == f.select("provider_id", "year").distinct().count() > 0


def test_shares_sum_to_100_and_running_total_ends_at_group_sum(wh):
    share = windows.win_cumulative_share(wh.fact)
    for r in share.groupBy("year").agg(F.sum("pct_of_national_volume").alias("s")).collect():
        assert r.s == pytest.approx(100.0, abs=0.05)
    last = share.groupBy("census_region").agg(
        F.max_by("cumulative_discharges", "year").alias("last"), F.sum("yearly_discharges").alias("total")
    )
    assert all(r.last == r.total for r in last.collect())


def test_ntile_buckets_balanced(wh):
    tiles = windows.win_ntile(wh.fact, 1998)
    for col, k in (("cost_quartile", 4), ("cost_decile", 10)):
        sizes = [r[1] for r in tiles.groupBy(col).count().collect()]
        assert len(sizes) == k and max(sizes) - min(sizes) <= 1


def test_every_fact_row_has_its_dimensions(wh):
    f = wh.fact
    assert f.filter(F.col("provider_size_category").isNull() | F.col("census_region").isNull()).count() == 0
