"""Left join that keeps its balance when a key is hot or missing.

``balanced_left_join`` measures the keys of the left side: one partial aggregate counts
them, and a key with more than a ``HOT``-th of the rows is hot.  There are fewer than
``HOT`` such keys whatever the data, so their list may be broadcast.

* Rows of a hot key are dealt over ``salts`` sub-keys by a hash of the row, and the
  right rows of that key are repeated once per sub-key.  Other rows have sub-key 0.
* Rows whose key holds a null match nothing.  They do not enter the join at all, but
  pass round it with nulls in the right columns.

Everything is one lazy plan.  What AQE splits at run time it may still split; this
operator does not depend on it, nor on the size of a partition in bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this fraction of the rows is hot; so fewer keys than this are.
HOT = 200


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def hot_keys(df: DataFrame, on: Sequence[str], hot: int = HOT) -> DataFrame:
    """The key values of more than a ``hot``-th of the rows: fewer than ``hot``."""
    counts = df.groupBy(*[_name(c) for c in on]).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return counts.join(F.broadcast(total)).where(F.col("_n") * hot > F.col("_total")).drop("_n", "_total")


def balanced_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int = 64, hot: int = HOT) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on equal columns ``on``: the left columns,
    then the right ones without ``on``.  The two sides share no other names."""
    known = reduce(Column.__and__, [_name(c).isNotNull() for c in on])
    extra = [c for c in right.columns if c not in on]
    keyed = left.where(known)
    marks = hot_keys(keyed, on, hot).withColumn("_hot", F.lit(True))
    row = F.xxhash64(*[_name(c) for c in left.columns])
    dealt = keyed.join(F.broadcast(marks), list(on), "left").withColumn(  # fewer than ``hot`` rows
        "_salt", F.when(F.col("_hot"), F.pmod(row, F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    spread = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.where(known).join(F.broadcast(marks), list(on), "left").withColumn("_salt", F.explode(spread)).drop("_hot")
    joined = dealt.drop("_hot").join(repeated, [*on, "_salt"], "left").select(*[_name(c) for c in [*left.columns, *extra]])
    types = dict(right.dtypes)
    unmatched = left.where(~known).select(*[_name(c) for c in left.columns], *[F.lit(None).cast(types[c]).alias(c) for c in extra])
    return joined.unionByName(unmatched)
