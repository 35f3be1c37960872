"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.session import scratch_path

#: ASCII white space as the operators define it (fixed value).
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Code points of text that a task works on at a time.
SLICE_CHARS = 1 << 21


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and return the stored
    table.  Lineage ends there, so a lost executor costs one reread, and data
    that tasks produced once is not produced again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    """The text column with null read as the empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[pa.Array]:
    """The texts in runs of at most ``chars`` code points, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64))
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + chars, side="right")))
        yield texts.slice(low, high - low)
        low = high
