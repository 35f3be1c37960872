"""Full-refresh build of the warehouse, layer by layer (staging -> fact)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators.quality import stack
from tierline.plans.warehouse import MODEL_LEVELS, MODEL_ORDER, Warehouse
from tierline.session import scratch_path
from tierline.sources.sinks import drop_folder, drop_versions, latest_version, mark_complete, new_version, replace_table, write_table

#: Stored partition columns.
PARTITIONS = {
    "stg_inpatient_charges": ["data_year"],
    "stg_outpatient_charges": ["data_year"],
    "stg_physicians": ["data_year"],
    "fact_healthcare_metrics": ["year"],
}

#: Models joined on the provider, which catalog tables may be bucketed by.
BUCKETED = {
    "int_provider_inpatient_summary": "provider_id",
    "int_provider_outpatient_summary": "provider_id",
    "int_provider_combined": "provider_id",
    "dim_provider": "provider_id",
}


#: Models that read at most so many bytes are written beside others of their level, and in one go.
SIDE_BY_SIDE = 64 << 20
#: Parts at most in which a larger model is written that ``Warehouse.slices`` can cut.
SLICES = 4


def _bytes_read(df: DataFrame) -> int:
    """Size of the tables that a plan reads, as Spark knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def materialise(
    wh: Warehouse,
    out_dir: str | None = None,
    fmt: str = "parquet",
    concurrent: bool = True,
    database: str | None = None,
    replaces: Warehouse | None = None,
    buckets: int | None = None,
) -> Warehouse:
    """Write every model in dependency order and rebind it to the stored
    table, so each layer reads the previous layer's table, like CTAS files
    run in order.  ``out_dir`` holds one folder per build, of which the newest
    ``sinks.KEPT`` stay; it defaults to a fresh place under the shared checkpoint
    location.  A build counts once it is complete: ``latest_build`` reads the newest
    such one, whatever is being written or has failed beside it.
    Staging is stored by data year and the fact by year, so reports on a year
    read that year only.  ``replaces`` is an earlier build in a folder of its own
    that nothing reads any more: it is deleted once the new one is complete.

    With ``concurrent`` the independent models of one build level are
    submitted as parallel Spark jobs; levels still run in order.  Models that read
    more than ``SIDE_BY_SIDE`` bytes each fill the cluster alone: they are written
    one after another, the largest first, and where ``Warehouse.slices`` can cut
    them slice by slice, so the shuffle files of one are gone before the next begins.

    With ``database`` the models become catalog tables ``database.<model>``
    instead, each replaced in one step (``sinks.replace_table``), so reports by
    name keep working while a refresh runs.  With ``buckets`` the models joined on
    the provider are stored in so many buckets of it: the fact joins them in place.
    """
    built = Warehouse(wh.spark, wh.raw, wh.params, wh.state_names, wh.state_regions)
    if database is None:
        root = (out_dir or scratch_path(wh.spark, "warehouse")).rstrip("/")
        base = built.location = new_version(root)

    def write(name: str, n: int = 1) -> tuple[str, DataFrame]:
        # one scheduler pool per model: under spark.scheduler.mode=FAIR the
        # concurrent models of a level share the slots instead of queueing
        sc = built.spark.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", f"build_{name}")
        parts = built.slices(name, n) if n > 1 else None
        try:
            if database is not None:
                by = (buckets, BUCKETED[name]) if buckets and name in BUCKETED else None
                return name, replace_table(built.model(name), f"{database}.{name}", fmt=fmt, partition_by=PARTITIONS.get(name), buckets=by, slices=parts)
            return name, write_table(built.model(name), f"{base}/{name}", fmt, PARTITIONS.get(name), parts)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    for level in MODEL_LEVELS:
        sizes = {name: _bytes_read(built.model(name)) for name in level}  # also resolves the memoised plans
        large = sorted((n for n in level if sizes[n] > SIDE_BY_SIDE), key=lambda n: -sizes[n])
        small = [n for n in level if n not in large]
        with ThreadPoolExecutor(max_workers=len(level) if concurrent else 1) as pool:
            beside = [pool.submit(write, n) for n in small]
            if not concurrent:
                wait(beside)
            done = [write(n, min(SLICES, -(-sizes[n] // SIDE_BY_SIDE))) for n in large] + [f.result() for f in beside]
        built.stored.update(done)
    if database is None:
        mark_complete(wh.spark, base)
        drop_versions(wh.spark, root, base)
    if replaces is not None and replaces.location and replaces.location != built.location:
        drop_folder(wh.spark, replaces.location)
    return built


def latest_build(wh: Warehouse, out_dir: str, fmt: str = "parquet") -> Warehouse:
    """The newest complete build that ``materialise`` left in ``out_dir``."""
    base = latest_version(wh.spark, out_dir)
    if base is None:
        raise FileNotFoundError(f"no complete build in {out_dir}")
    built = Warehouse(wh.spark, wh.raw, wh.params, wh.state_names, wh.state_regions, location=base)
    for name in MODEL_ORDER:
        built.stored[name] = wh.spark.read.format(fmt).schema(wh.model(name).schema).load(f"{base}/{name}").select(*wh.model(name).columns)
    return built


def table_row_counts(wh: Warehouse) -> DataFrame:
    """(table_name, row_count) of every model, in build order."""
    return stack(
        [wh.model(n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n in MODEL_ORDER]
    )


def register_tables(wh: Warehouse, prefix: str = "") -> list[str]:
    """Publish every model as a temporary view named after it, so the
    warehouse can be queried with ``spark.sql`` by table name."""
    names = []
    for name in MODEL_ORDER:
        wh.model(name).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
