"""Raw sources, read with a declared schema: one DataFrame per (source, year),
or one per source with a year column."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.sources.schemas import RAW_SCHEMAS

#: The year column of a source stored as one table.
YEAR = "data_year"


@dataclass(frozen=True)
class RawSources:
    """The raw layer: the three sources, each as yearly tables or as one table
    with a ``data_year`` column.

    Mappings are ordered; the staging union keeps that order (the reference
    stacks the newest year first).
    """

    inpatient: Mapping[int, DataFrame] | DataFrame
    outpatient: Mapping[int, DataFrame] | DataFrame = field(default_factory=dict)
    physicians: Mapping[int, DataFrame] | DataFrame = field(default_factory=dict)
    #: (source, i, n) -> the rows of slice i of n of a source that is computed by joins, so
    #: that it can be stored with a part of their shuffles on disk at a time
    sliced: Callable[[str, int, int], DataFrame] | None = None

    def profiled(self, source: str, year: int) -> DataFrame:
        """What exploration looks at: the whole table of a source stored as
        one table, else the table of ``year``."""
        tables = getattr(self, source)
        return tables.drop(YEAR) if isinstance(tables, DataFrame) else tables[year]

    def table_names(self) -> list[tuple[str, DataFrame]]:
        """(name, frame) per raw table, named like the public source tables; a
        source stored as one table has its plain name."""
        out: list[tuple[str, DataFrame]] = []
        for name, tables in zip(RAW_SCHEMAS, (self.inpatient, self.outpatient, self.physicians)):
            if isinstance(tables, DataFrame):
                out.append((name, tables))
            else:
                out += [(f"{name}_{year}", df) for year, df in tables.items()]
        return out


def year_parts(tables: Mapping[int, DataFrame] | DataFrame) -> list[tuple[Column, DataFrame]]:
    """(year as a column, table) of every part of a source."""
    if isinstance(tables, DataFrame):
        return [(F.col(YEAR), tables)]
    return [(F.lit(year), df) for year, df in tables.items()]


def read_raw_table(spark: SparkSession, source: str, location: str, fmt: str = "parquet") -> DataFrame:
    """Read one raw table (a path, or a catalog table when ``fmt == 'table'``)."""
    schema = RAW_SCHEMAS[source]
    if fmt == "table":
        return spark.read.table(location).select(*schema.fieldNames())
    return spark.read.schema(schema).format(fmt).load(location)


def read_raw_sources(
    spark: SparkSession,
    locations: Mapping[str, Mapping[int, str]],
    fmt: str = "parquet",
) -> RawSources:
    """``locations[source][year] -> path``; sources are the keys of RAW_SCHEMAS."""

    def load(source: str) -> dict[int, DataFrame]:
        return {
            year: read_raw_table(spark, source, loc, fmt)
            for year, loc in locations.get(source, {}).items()
        }

    return RawSources(
        inpatient=load("inpatient_charges"),
        outpatient=load("outpatient_charges"),
        physicians=load("physicians_and_other_supplier"),
    )
