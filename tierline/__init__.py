"""tierline — a layered analytics warehouse (raw -> staging -> intermediate ->
star schema -> KPIs / views / window analytics / data quality) built on
Spark DataFrames.  Every model is a function DataFrame(s) -> DataFrame."""

__version__ = "0.1.0"
