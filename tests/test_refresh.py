"""Full refreshes that readers survive."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.fixtures import fixture_warehouse
from tierline.plans import build
from tierline.plans.build import latest_build, materialise
from tierline.plans.warehouse import MODEL_ORDER, STAGED_FROM, YEARLY
from tierline.queries import testdata_warehouse as driver_warehouse
from tierline.session import small_tasks
from tierline.sources import sinks
from tierline.sources.sinks import write_table


def _version(spark, v, n=3000):
    return spark.range(n).select("id", F.lit(v).alias("v"), (F.col("id") % 3).alias("year"))


@pytest.fixture()
def database(spark, tmp_path):
    name = f"refresh_{tmp_path.name}".replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path / 'db'}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


@pytest.mark.parametrize("by", [None, ["year"]])
def test_readers_see_one_whole_version(spark, database, by):
    table, seen, failed, stop = f"{database}.t", [], [], threading.Event()
    sinks.replace_table(_version(spark, 0), table, partition_by=by)

    def read(session):
        while not stop.is_set():
            try:
                rows = session.sql(f"SELECT v, count(*) AS n, sum(id) AS s, count(DISTINCT year) AS y FROM {table} GROUP BY v").collect()
                seen.append([tuple(r) for r in rows])
            except Exception as e:  # noqa: BLE001 - the test reports it
                failed.append(repr(e)[:500])

    # the session that refreshes sees each version; another keeps the one it first read until it refreshes the table
    other = spark.newSession()
    readers = [threading.Thread(target=read, args=(s,)) for s in (spark, spark, other)]
    for r in readers:
        r.start()
    for v in range(1, 7):
        sinks.replace_table(_version(spark, v), table, partition_by=by, keep=20)
    stop.set()
    for r in readers:
        r.join()
    assert not failed, failed[0]
    whole = sum(range(3000))
    assert seen and all(len(rows) == 1 and rows[0][1:] == (3000, whole, 3) for rows in seen)
    assert len({rows[0][0] for rows in seen}) > 1
    other.sql(f"REFRESH TABLE {table}")
    for session in (spark, other, spark.newSession()):
        assert [r.v for r in session.read.table(table).select("v").distinct().collect()] == [6]


def test_old_versions_go_and_partitions_prune(spark, database, tmp_path):
    table = f"{database}.t"
    for v in range(5):
        sinks.replace_table(_version(spark, v), table, partition_by=["year"], keep=2)
    assert len(list((tmp_path / "db" / "_versions" / "t").glob("v*"))) == 2
    df = spark.read.table(table).where("year = 1")
    assert df.count() == 1000
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString()


def test_a_failed_refresh_leaves_the_table(spark, database):
    table = f"{database}.t"
    sinks.replace_table(_version(spark, 1), table)
    bad = _version(spark, 2).withColumn("id", F.when(F.col("id") == 2999, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        sinks.replace_table(bad, table)
    assert spark.read.table(table).agg(F.max("v"), F.count("*")).first() == (1, 3000)


def test_other_columns_and_foreign_tables_are_replaced(spark, database):
    table = f"{database}.t"
    _version(spark, 0).write.saveAsTable(table)  # not made here
    sinks.replace_table(_version(spark, 1), table)
    sinks.replace_table(_version(spark, 2).withColumn("more", F.lit("x")), table)
    assert spark.read.table(table).columns == ["id", "v", "year", "more"]
    assert spark.read.table(table).select("v").distinct().first().v == 2


def test_latest_build_is_the_newest_complete_one(spark, tmp_path):
    wh, out = fixture_warehouse(spark), str(tmp_path / "wh")
    with pytest.raises(FileNotFoundError):
        latest_build(wh, out)
    first = materialise(wh, out)
    spark.range(1).write.parquet(f"{sinks.new_version(out)}/fact_healthcare_metrics")  # a build that broke off
    found = latest_build(wh, out)
    assert found.location.rsplit("/", 1)[-1] == first.location.rsplit("/", 1)[-1]
    assert sorted(map(repr, found.fact.drop("loaded_at").collect())) == sorted(map(repr, first.fact.drop("loaded_at").collect()))


def test_bucketed_models_join_without_a_shuffle(spark, database):
    from tierline.plans import fact

    wh = fixture_warehouse(spark)
    plain = materialise(wh)
    for _ in range(2):  # the second replaces the first
        built = materialise(wh, database=database, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = fact.fact_healthcare_metrics(built.model("int_provider_combined"), built.model("dim_provider"), F.broadcast(built.model("dim_region")))
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        shuffled = fact.fact_healthcare_metrics(
            plain.model("int_provider_combined"), plain.model("dim_provider"), F.broadcast(plain.model("dim_region"))
        )
        assert "Exchange hashpartitioning(provider_id" in shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [provider_id" in plan and "hashpartitioning" not in plan
    assert sorted(map(repr, built.fact.drop("loaded_at").collect())) == sorted(map(repr, plain.fact.drop("loaded_at").collect()))


def test_storing_a_table_keeps_tasks_small(spark, tmp_path, monkeypatch):
    """a task that stores a table reads little and sorts nothing; the
    session has its own settings back, also after overlaps and failures."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.maxConcurrentOutputFileWriters")
    seen, save = [], DataFrameWriter.save

    def recording(writer, *args, **kwargs):
        seen.append([int(spark.conf.get(k).rstrip("b")) for k in keys])
        return save(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "save", recording)
    before = [spark.conf.get(k) for k in keys]
    rows = spark.range(40).select("id", (F.col("id") % 7).alias("year"))
    with small_tasks(spark):
        stored = write_table(rows, str(tmp_path / "t"), partition_by=["year"])
        assert [spark.conf.get(k) for k in keys] != before  # still inside
    (sizes,) = seen
    assert max(sizes[:2]) <= 32 << 20 and sizes[2] >= 7
    assert [spark.conf.get(k) for k in keys] == before
    assert sorted(tuple(r) for r in stored.collect()) == [(i, i % 7) for i in range(40)]
    with pytest.raises(Exception):
        write_table(rows, str(tmp_path / "u"), fmt="no such format")
    assert [spark.conf.get(k) for k in keys] == before
    spark.conf.set(keys[0], "1m")  # tighter settings stay
    try:
        write_table(rows, str(tmp_path / "v"))
        assert seen[-1][0] == 1 << 20 and spark.conf.get(keys[0]) == "1m"
    finally:
        spark.conf.set(keys[0], before[0])


def _driver_tables(spark, folder):
    """Small tables in the driver's shape, some lines with null or unknown keys."""
    c = F.col
    tables = {
        "region": spark.range(2).select(c("id").cast("int").alias("r_regionkey"), F.concat(F.lit("R"), "id").alias("r_name")),
        "nation": spark.range(4).select(
            c("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), (c("id") % 2).cast("int").alias("n_regionkey")
        ),
        "customer": spark.range(30).select(
            c("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), (c("id") % 4).cast("int").alias("c_nationkey"),
            F.lit(1.0).alias("c_acctbal"), F.concat(F.lit("M"), c("id") % 3).alias("c_mktsegment"),
        ),
        "supplier": spark.range(12).select(
            c("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), (c("id") % 4).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")
        ),
        "part": spark.range(40).select(
            c("id").alias("p_partkey"), F.lit("p").alias("p_name"), F.concat(F.lit("Brand#"), c("id") % 7).alias("p_brand"),
            F.concat(F.lit("T"), c("id") % 5).alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"),
        ),
        "orders": spark.range(200).select(
            c("id").alias("o_orderkey"), (c("id") % 31).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"),
            F.expr("timestamp'1997-01-01' + make_interval(0, 0, 0, CAST(id * 3 AS INT))").alias("o_orderdate"), F.lit("1").alias("o_orderpriority"),
        ),
        "lineitem": spark.range(900).select(
            F.when(c("id") % 50 != 0, c("id") % 210).alias("l_orderkey"), (c("id") % 41).alias("l_partkey"),
            F.when(c("id") % 60 != 0, c("id") % 13).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), (c("id") % 9 + 1.0).alias("l_quantity"),
            (c("id") * 1.01 + 5).alias("l_extendedprice"), (c("id") % 4 / 100).alias("l_discount"), F.lit(0.02).alias("l_tax"), F.lit("N").alias("l_returnflag"),
            F.when(c("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus"),
            F.expr("timestamp'1997-01-01' + make_interval(0, 0, 0, CAST(id AS INT))").alias("l_shipdate"),
        ),
    }
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_a_large_build_keeps_little_on_disk(spark, tmp_path, monkeypatch):
    """large models are written one after another, the staged ones slice by
    slice, and the shuffle files of a write are gone before the next one begins."""
    sf = _driver_tables(spark, tmp_path / "in")
    whole = materialise(driver_warehouse(spark, sf), str(tmp_path / "whole"))
    found, running, save = [], [], DataFrameWriter.save

    def recording(writer, *args, **kwargs):
        late = time.time() + 10
        while (left := _shuffle_files(spark) - before) and time.time() < late:  # deleted in the background
            time.sleep(0.05)
        running.append(args[0])
        found.append((args[0].rsplit("/", 1)[-1], len(left), len(running)))
        try:
            return save(writer, *args, **kwargs)
        finally:
            running.remove(args[0])

    monkeypatch.setattr(build, "SIDE_BY_SIDE", 1)
    monkeypatch.setattr(DataFrameWriter, "save", recording)
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = _shuffle_files(spark)
    try:
        sliced = materialise(driver_warehouse(spark, sf), str(tmp_path / "sliced"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert all(left == 0 and at_once == 1 for _, left, at_once in found), found
    written = [name for name, _, _ in found]
    assert set(written) == set(MODEL_ORDER)
    assert {written.count(n) for n in (*STAGED_FROM, *YEARLY)} == {build.SLICES}
    for name in MODEL_ORDER:
        a, b = (w.model(name).drop("loaded_at") for w in (whole, sliced))
        assert a.dtypes == b.dtypes and a.count() > 0
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_slices_hold_every_row_once(spark, tmp_path):
    """Also rows without a year, which are in the first slice of a yearly model."""
    sf = _driver_tables(spark, tmp_path / "in")
    wh = driver_warehouse(spark, sf)
    for name, source in STAGED_FROM.items():
        raw, parts = getattr(wh.raw, source), [wh.raw.sliced(source, i, 3) for i in range(3)]
        assert sorted(map(repr, raw.collect())) == sorted(repr(r) for p in parts for r in p.select(*raw.columns).collect())
        staged = wh.model(name)
        wh.stored[name] = staged.unionByName(staged.where("provider_state = 'N2'").withColumn("data_year", F.lit(None).cast("bigint")))
    for name in YEARLY:
        parts = [r for p in wh.slices(name, 4) for r in p.collect()]
        assert sorted(map(repr, wh.model(name).collect())) == sorted(map(repr, parts))
        assert any(r.data_year is None for r in parts)


def test_slices_make_catalog_tables_too(spark, database, tmp_path, monkeypatch):
    sf = _driver_tables(spark, tmp_path / "in")
    whole = materialise(driver_warehouse(spark, sf), str(tmp_path / "whole"))
    monkeypatch.setattr(build, "SIDE_BY_SIDE", 1)
    sliced = materialise(driver_warehouse(spark, sf), database=database, concurrent=False)
    for name in ("stg_inpatient_charges", "stg_outpatient_charges", "stg_physicians", "fact_healthcare_metrics"):
        a, b = (w.drop("loaded_at") for w in (whole.model(name), spark.read.table(f"{database}.{name}").select(*whole.model(name).columns)))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    assert sliced.fact.count() == whole.fact.count()


def test_stored_parquet_is_compressed_as_the_session_says(spark, tmp_path):
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key)
    for setting, ending in (("snappy", ".zstd.parquet"), ("gzip", ".gz.parquet")):
        spark.conf.set(key, setting)
        try:
            write_table(spark.range(5), str(tmp_path / setting))
            assert spark.conf.get(key) == setting
        finally:
            spark.conf.set(key, before)
        assert {p.name.endswith(ending) for p in (tmp_path / setting).glob("part-*")} == {True}
