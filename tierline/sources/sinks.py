"""Sinks: full-refresh materialisation (CREATE OR REPLACE TABLE ... AS).

A model is always written to a *new* location and then read back, so a refresh never
overwrites a table that somebody still reads, and downstream models start from the
stored table (lineage cut, like a CTAS).

*Catalog tables* (``replace_table``) are external tables over versioned folders.  A
refresh writes a whole new version and then moves the table to it with one ALTER TABLE
... SET LOCATION: a reader sees the old or the new version, never a mixture or nothing,
and a refresh that fails leaves the table as it was.  The newest ``KEPT`` versions stay,
so readers that started on an older one finish; a Spark session other than the one that
refreshes keeps reading the version it has cached until it runs REFRESH TABLE, so keep
as many versions as such sessions may lag behind.  Partitions are found in the folder, not
listed in the catalog, for a list could not be exchanged in one step.

*Folders* hold one build each (``new_version``); a build counts once it is marked
complete, and ``latest_version`` is the newest that is.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tierline.session import small_tasks

#: Versions of a table or build that stay, the current one included.
KEPT = 2
_OURS = "tierline.versioned"
_COMPLETE = "_COMPLETE"
_create = threading.Lock()


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, slices: list[DataFrame] | None = None
) -> DataFrame:
    """Overwrite ``path`` with ``df`` and return the stored table.  ``slices`` are
    frames whose union is ``df``: written one after another, so that the shuffle
    files of one are gone before the next begins."""
    for i, part in enumerate(slices or [df]):
        writer = part.select(*df.columns).write.mode("append" if i else "overwrite").format(fmt)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with small_tasks(df.sparkSession):
            writer.save(path)
    # the declared schema: partition columns keep their type and place
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path).select(*df.columns)


def new_version(root: str) -> str:
    """A folder under ``root`` that sorts after all earlier ones."""
    return f"{root.rstrip('/')}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _versions(spark: SparkSession, root: str) -> list[str]:
    """The version folders under ``root``, oldest first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return sorted(s.getPath().toString() for s in files.listStatus(target) if s.isDirectory() and s.getPath().getName().startswith("v"))


def mark_complete(spark: SparkSession, version: str) -> None:
    """From now on ``latest_version`` may return this folder."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{version}/{_COMPLETE}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()


def latest_version(spark: SparkSession, root: str) -> str | None:
    """The newest complete version folder under ``root``."""
    for version in reversed(_versions(spark, root)):
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{version}/{_COMPLETE}")
        if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return version
    return None


def drop_versions(spark: SparkSession, root: str, current: str, keep: int = KEPT) -> None:
    """Delete the versions before the newest ``keep`` up to ``current``; later
    ones belong to refreshes that still run."""
    name = current.rstrip("/").rsplit("/", 1)[-1]
    older = [v for v in _versions(spark, root) if v.rsplit("/", 1)[-1] <= name]
    for version in older[: max(0, len(older) - keep)]:
        drop_folder(spark, version)


def replace_table(
    df: DataFrame,
    table: str,
    root: str | None = None,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    keep: int = KEPT,
    buckets: tuple[int, str] | None = None,
    slices: list[DataFrame] | None = None,
) -> DataFrame:
    """CREATE OR REPLACE TABLE ``table`` AS ``df`` without a moment at which
    readers see less than a whole table; returns the version written.

    Versions go to ``root``, by default a folder beside the database's tables.
    ``slices`` are as in ``write_table``; a bucketed table is written at once.
    With ``buckets`` (number, column) the rows are stored hashed by that column, so
    joins and aggregates on it need no shuffle of this table.
    A table that has other columns, or that was not made here, is dropped and
    made anew: the only case in which readers may miss it for a moment."""
    spark = df.sparkSession
    if root is None:
        database = table.rsplit(".", 1)[0] if "." in table else spark.catalog.currentDatabase()
        root = f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/_versions/{table.rsplit('.', 1)[-1]}"
    version = new_version(root)
    by = partition_by or []
    clustered = ""
    if buckets:
        n, column = buckets
        helper = f"{table}_{uuid.uuid4().hex[:12]}"  # buckets are written through a table only
        with small_tasks(spark):
            df.repartition(n, column).write.format(fmt).bucketBy(n, column).sortBy(column).option("path", version).saveAsTable(helper)
        spark.sql(f"DROP TABLE {helper}")  # external: its files stay
        stored = spark.read.schema(df.schema).format(fmt).load(version)
        clustered = f"CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {n} BUCKETS "
    else:
        stored = write_table(df.select(*[c for c in df.columns if c not in by], *by), version, fmt, by, slices)
    mark_complete(spark, version)
    exists = spark.catalog.tableExists(table)
    same = exists and spark.read.table(table).schema.simpleString() == stored.schema.simpleString()
    kept = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()} if exists else {}
    if same and kept.get(_OURS) == (clustered or "plain"):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{version}'")
    else:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
        parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in by)}) " if by else ""
        listed = "spark.sql.hive.manageFilesourcePartitions"
        with _create:  # the setting is the session's
            before = spark.conf.get(listed)
            spark.conf.set(listed, "false")
            try:
                if exists:
                    spark.sql(f"DROP TABLE {table}")
                spark.sql(
                    f"CREATE TABLE {table} ({columns}) USING {fmt} {parts}{clustered}"
                    f"LOCATION '{version}' TBLPROPERTIES ('{_OURS}' = '{clustered or 'plain'}')"
                )
            finally:
                spark.conf.set(listed, before)
    spark.catalog.refreshTable(table)
    drop_versions(spark, root, version, keep)
    return (spark.read.table(table) if buckets else stored).select(*df.columns)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of stored tables on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
