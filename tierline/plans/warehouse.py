"""A warehouse: raw sources + parameters -> every model as a lazy DataFrame.

Models are built on first access and memoised, so one query plan reuses the
same sub-plans (Spark then reuses identical exchanges).  ``materialise``
(see ``build``) swaps the models for stored tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import lookups
from tierline.plans import dimensions, fact, intermediate, staging
from tierline.sources.readers import RawSources


@dataclass(frozen=True)
class Params:
    """Every constant of the reference models, defaulting to its value."""

    current_year: int = 2015
    previous_year: int = 2014
    max_inpatient_payment: float = staging.MAX_INPATIENT_PAYMENT
    large_at: float = dimensions.LARGE_AT
    medium_at: float = dimensions.MEDIUM_AT
    default_region: str = lookups.DEFAULT_REGION
    top_providers: int = 20
    top_rank: int = 5
    top_percentiles: int = 50
    top_explore: int = 20
    sample_rows: int = 10
    trend_pct: float = 3.0
    z_threshold: float = 3.0
    min_states: int = 50
    expected_years: int = 2
    quartiles: int = 4
    deciles: int = 10


MODEL_ORDER = (
    "stg_inpatient_charges",
    "stg_outpatient_charges",
    "stg_physicians",
    "int_provider_inpatient_summary",
    "int_provider_outpatient_summary",
    "int_physician_summary",
    "int_state_metrics",
    "int_provider_combined",
    "dim_provider",
    "dim_region",
    "dim_date",
    "fact_healthcare_metrics",
)


# Build levels: every model depends only on models of earlier levels, so the
# models of one level can be written concurrently.
MODEL_LEVELS = (
    ("stg_inpatient_charges", "stg_outpatient_charges", "stg_physicians"),
    (
        "int_provider_inpatient_summary",
        "int_provider_outpatient_summary",
        "int_physician_summary",
        "int_state_metrics",
        "dim_provider",
        "dim_region",
        "dim_date",
    ),
    ("int_provider_combined",),
    ("fact_healthcare_metrics",),
)


#: The raw source of each staging model.  Staging works row by row, so a model is the
#: union of what it makes of the source's slices.
STAGED_FROM = {
    "stg_inpatient_charges": "inpatient",
    "stg_outpatient_charges": "outpatient",
    "stg_physicians": "physicians",
}

#: The staging model of each model that groups by year.  Staging is stored by year, so a
#: slice of the years reads its own files only.
YEARLY = {
    "int_provider_inpatient_summary": "stg_inpatient_charges",
    "int_provider_outpatient_summary": "stg_outpatient_charges",
    "int_physician_summary": "stg_physicians",
}


@dataclass
class Warehouse:
    spark: SparkSession
    raw: RawSources
    params: Params = field(default_factory=Params)
    state_names: DataFrame | None = None
    state_regions: DataFrame | None = None
    stored: dict[str, DataFrame] = field(default_factory=dict)
    #: folder of the stored models, if they are in one
    location: str | None = None

    def model(self, name: str) -> DataFrame:
        if name in self.stored:
            return self.stored[name]
        return getattr(self, name)

    def slices(self, name: str, n: int) -> list[DataFrame]:
        """Frames whose union is the model: ``n`` where its source can be sliced or
        its staging is stored, else the model itself."""
        if name not in self.stored and (staged := YEARLY.get(name)) in self.stored:
            year = F.pmod(F.coalesce("data_year", F.lit(0)), F.lit(n))
            parts = [self.stored[staged].where(year == i) for i in range(n)]
            return [Warehouse(self.spark, self.raw, self.params, stored={staged: part}).model(name) for part in parts]
        if name in self.stored or name not in STAGED_FROM or self.raw.sliced is None:
            return [self.model(name)]
        source = STAGED_FROM[name]
        raws = [replace(self.raw, **{source: self.raw.sliced(source, i, n)}) for i in range(n)]
        return [Warehouse(self.spark, raw, self.params).model(name) for raw in raws]

    # -- staging -----------------------------------------------------------
    @cached_property
    def stg_inpatient_charges(self) -> DataFrame:
        return staging.stg_inpatient_charges(self.raw.inpatient, self.params.max_inpatient_payment)

    @cached_property
    def stg_outpatient_charges(self) -> DataFrame:
        return staging.stg_outpatient_charges(self.raw.outpatient)

    @cached_property
    def stg_physicians(self) -> DataFrame:
        return staging.stg_physicians(self.raw.physicians)

    # -- intermediate ------------------------------------------------------
    @cached_property
    def int_provider_inpatient_summary(self) -> DataFrame:
        return intermediate.int_provider_inpatient_summary(self.model("stg_inpatient_charges"))

    @cached_property
    def int_provider_outpatient_summary(self) -> DataFrame:
        return intermediate.int_provider_outpatient_summary(self.model("stg_outpatient_charges"))

    @cached_property
    def int_physician_summary(self) -> DataFrame:
        return intermediate.int_physician_summary(self.model("stg_physicians"))

    @cached_property
    def int_state_metrics(self) -> DataFrame:
        return intermediate.int_state_metrics(
            self.model("stg_inpatient_charges"), self.model("stg_outpatient_charges")
        )

    @cached_property
    def int_provider_combined(self) -> DataFrame:
        return intermediate.int_provider_combined(
            self.model("int_provider_inpatient_summary"), self.model("int_provider_outpatient_summary")
        )

    # -- dimensions and fact ----------------------------------------------
    @cached_property
    def dim_provider(self) -> DataFrame:
        p = self.params
        return dimensions.dim_provider(self.model("stg_inpatient_charges"), p.large_at, p.medium_at)

    @cached_property
    def dim_region(self) -> DataFrame:
        names = self.state_names if self.state_names is not None else lookups.state_name_lookup(self.spark)
        regions = (
            self.state_regions if self.state_regions is not None else lookups.census_region_lookup(self.spark)
        )
        return dimensions.dim_region(self.model("stg_inpatient_charges"), names, regions, self.params.default_region)

    @cached_property
    def dim_date(self) -> DataFrame:
        return dimensions.dim_date(self.spark, self.params.previous_year, self.params.current_year)

    @cached_property
    def fact_healthcare_metrics(self) -> DataFrame:
        return fact.fact_healthcare_metrics(
            self.model("int_provider_combined"), self.model("dim_provider"), self.model("dim_region")
        )

    @property
    def fact(self) -> DataFrame:
        return self.model("fact_healthcare_metrics")
