"""Global ranking without a single-partition window.

``NTILE(k) OVER (ORDER BY x)``, ``PERCENT_RANK()`` and ``CUME_DIST()`` with no (or a
low-cardinality) PARTITION BY make Spark move every row into one task.  Here one
lazy plan serves every input size:

1. *Bounds.*  The rows' order keys are hashed into cells and each cell keeps one key:
   a sample of the distinct keys, drawn by a partial aggregate, the same on every run.
   Every ``EVERY``-th of the sorted sample keys is a bucket bound; the bounds are one
   row of the plan.  Their number follows the session's shuffle partitions, which are
   sized from the data (``session.partitions_for``).
2. *Buckets.*  A row's bucket is the number of bounds at or below its key, a pure
   function of the row: a search written out as three comparisons per quartering, so it
   stays inside generated code and no lambda runs over the bounds.  The key holds the
   tie-breakers, so a hot value is cut by them.
3. *Running totals.*  A window inside each bucket, plus the total of the buckets
   before it (one row per bucket, a partial aggregate).

Of N different keys and B buckets, a bucket holds N / B on average.  Each lies between
``EVERY`` neighbours of a uniform sample, so the chance that one exceeds 8 N / B is
below B * e^-21: ``MOST`` states that factor and the tests hold buckets to it.

Nothing runs while a plan is built and nothing is stored, so views over these
plans stay live.  Ranks of values need no row order: ``with_rank_stats`` and
``exact_quantiles`` run on the counts per distinct value, where a hot value is one
row.

Use the plain partitioned window when the PARTITION BY key has many values: it is
already distributed by that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"
CNT = "_cnt"
RANK = "_rank"
LE = "_le"

#: Sample keys per bound, buckets per shuffle partition, fewest and most buckets,
#: and the factor by which a bucket may exceed the average.
EVERY = 4
PER_PARTITION = 4
FEWEST, LARGEST = 1024, 1 << 18
MOST = 8


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def _key(cols: Sequence[str]) -> Column:
    """The order key: structs compare field by field, NULLs first."""
    return F.struct(*[F.col(c) for c in cols])


def bucket_bits(df: DataFrame) -> int:
    """An even number of bits: 2^bits buckets, ``PER_PARTITION`` or more for
    each of the session's shuffle partitions, ``LARGEST`` at most."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = (min(LARGEST, max(FEWEST, PER_PARTITION * partitions)) - 1).bit_length()
    return bits + bits % 2


def _bounds(df: DataFrame, cols: Sequence[str], bits: int) -> DataFrame:
    """One row with the bucket bounds as ``_bounds``: 2^bits - 1 keys at most."""
    digest = F.xxhash64(F.lit("bounds"), *cols)
    cell = F.pmod(digest, F.lit(EVERY << bits)).alias("_cell")
    keys = df.groupBy(cell).agg(F.min(F.struct(digest.alias("h"), _key(cols).alias("k")))["k"].alias("_k"))
    ordered = keys.agg(F.array_sort(F.collect_list("_k")).alias("_all"))
    # every EVERY-th key of a full sample; of fewer keys as many as make bounds
    picked = F.transform(
        F.sequence(F.lit(1), F.lit((1 << bits) - 1)), lambda i: F.get("_all", F.floor(i * F.size("_all") / (1 << bits)).cast("int"))
    )
    return ordered.select(F.array_distinct(F.filter(picked, lambda k: k.isNotNull())).alias("_bounds"))


def _bucketed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with ``_bucket``, the number of bounds at or below the key."""
    bits = bucket_bits(df)
    with_bounds = df.join(F.broadcast(_bounds(df, cols, bits)))  # one row
    steps = [_key(cols).alias("_key"), F.lit(0).alias(f"_at{bits}")]
    for bit in range(bits - 2, -1, -2):  # each step quarters what is left and refers to the one before, a lateral alias
        at = f"_at{bit + 2}"
        reached = [f"IF(get(_bounds, {at} + {(k << bit) - 1}) <= _key, {1 << bit}, 0)" for k in (1, 2, 3)]
        steps.append(F.expr(f"{at} + {' + '.join(reached)} AS _at{bit}"))
    return with_bounds.select("*", *steps).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_at0").alias("_bucket"))


def running_totals(df: DataFrame, order: Sequence[str], weight: Column, name: str, total: str | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over all rows up to and
    including this one in the order of the columns ``order`` (ascending, NULLs
    first), and the sum over all rows as ``total`` if it is named.  Rows equal
    in all of ``order`` come in any order."""
    cut = _bucketed(df, order).withColumn("_weight", weight.cast("bigint"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy("_bucket").agg(F.sum("_weight").alias("_total"))  # one row per bucket
        .select(
            F.col("_bucket").alias("_b"),
            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"),
            *([F.sum("_total").over(everything).alias(total)] if total else []),
        )
    )
    inside = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        cut.withColumn("_inside", F.sum("_weight").over(inside))
        .join(F.broadcast(totals), F.col("_bucket") == F.col("_b"))  # LARGEST rows at most
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .select(*df.columns, name, *([total] if total else []))
    )


def _group_starts(df: DataFrame, partition_by: Sequence[str], size: Column) -> DataFrame:
    """(partition columns, _start, _cnt): rows before each group in the order
    of the groups and rows in it; one row per group."""
    groups = df.groupBy(*partition_by).agg(size.cast("bigint").alias(CNT))
    before = Window.partitionBy(F.lit(0)).orderBy(*[F.col(c).asc_nulls_first() for c in partition_by]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return groups.withColumn("_start", F.coalesce(F.sum(CNT).over(before), F.lit(0)))


def running_totals_by(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], weight: Column, name: str) -> DataFrame:
    """``df`` with ``name``: SUM(weight) OVER (PARTITION BY .. ORDER BY ..
    ROWS UNBOUNDED PRECEDING), columns ascending with NULLs first, for few
    partitions that may hold any share of the rows: each is cut into ranges whose
    totals are added up apart.  Null weights count as 0.  ``name`` less the row's
    weight is the frame that ends before the row; the difference of two such
    totals is any frame from the start."""
    whole = F.coalesce(weight.cast("bigint"), F.lit(0))
    upto = running_totals(df, [*partition_by, *order_by], whole, "_upto")
    starts = _group_starts(df, partition_by, F.sum(whole))
    l, r = upto.alias("_l"), starts.alias("_r")
    return l.join(r, _null_safe_on(l, r, partition_by)).select(
        *[F.col(f"_l.`{c}`") for c in df.columns], (F.col("_l._upto") - F.col("_r._start")).alias(name)
    )


def add_positions(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Append ``_pos`` (1-based position in the order of the columns
    ``order_by``, ascending with NULLs first, within ``partition_by``) and
    ``_cnt`` (rows in the group).

    Equals ``row_number()`` / ``count(*)`` over the same window; make
    ``order_by`` total (add tie-breakers) for a deterministic numbering.
    """
    if not partition_by:
        return running_totals(df, order_by, F.lit(1), POS, total=CNT)
    numbered = running_totals(df, [*partition_by, *order_by], F.lit(1), POS)
    starts = _group_starts(df, partition_by, F.count(F.lit(1)))
    l, r = numbered.alias("_l"), starts.alias("_r")
    return l.join(r, _null_safe_on(l, r, partition_by)).select(
        *[F.col(f"_l.`{c}`") for c in df.columns],
        (F.col(f"_l.{POS}") - F.col("_r._start")).alias(POS),
        F.col(f"_r.{CNT}"),
    )


def ntile_of(pos: Column | str, cnt: Column | str, k: int) -> Column:
    """NTILE(k) from a 1-based position and the group size.

    With b = n div k and e = n mod k the first e tiles hold b+1 rows.
    """
    p = F.col(pos) if isinstance(pos, str) else pos
    n = F.col(cnt) if isinstance(cnt, str) else cnt
    kk = F.lit(k).cast("long")
    b = F.floor(n / kk).cast("long")
    e = n - b * kk
    big = e * (b + 1)
    first = F.floor((p - 1) / (b + 1)).cast("long") + 1
    rest = e + F.floor((p - 1 - big) / F.when(b > 0, b)).cast("long") + 1
    return F.when(p <= big, first).otherwise(rest)


def with_ntiles(
    df: DataFrame,
    tiles: dict[str, int],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Add one NTILE column per ``{name: k}`` (bigint)."""
    positioned = add_positions(df, order_by, partition_by)
    cols = [ntile_of(POS, CNT, k).alias(name) for name, k in tiles.items()]
    return positioned.select(*df.columns, *cols)


def value_ranks(df: DataFrame, value: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """One row per (partition, value): ``_rank`` (RANK of the value in
    ascending order, NULLs first), ``_le`` (rows at or below it) and ``_cnt``
    (rows of the group).  Works on the counts per value."""
    keys = [*partition_by, value]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if not partition_by:
        upto = running_totals(counts, keys, F.col("_n"), LE, total=CNT)
        return upto.select(value, (F.col(LE) - F.col("_n") + 1).alias(RANK), LE, CNT)
    upto = running_totals(counts, keys, F.col("_n"), "_upto")
    starts = _group_starts(counts, partition_by, F.sum("_n"))
    l, r = upto.alias("_l"), starts.alias("_r")
    le = F.col("_l._upto") - F.col("_r._start")
    return l.join(r, _null_safe_on(l, r, partition_by)).select(
        *[F.col(f"_l.`{c}`") for c in keys], (le - F.col("_l._n") + 1).alias(RANK), le.alias(LE), F.col(f"_r.{CNT}")
    )


def with_rank_stats(df: DataFrame, value: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Append ``_rank`` (RANK), ``_le`` (rows <= value) and ``_cnt`` of the
    ascending order of ``value``, NULLs first, within ``partition_by``."""
    keys = [*partition_by, value]
    l, r = df.alias("_p"), value_ranks(df, value, partition_by).alias("_t")
    return l.join(r, _null_safe_on(l, r, keys)).select(
        *[F.col(f"_p.`{c}`") for c in df.columns], F.col(f"_t.{RANK}"), F.col(f"_t.{LE}"), F.col(f"_t.{CNT}")
    )


def percent_rank_of(rank: Column | str = RANK, cnt: Column | str = CNT) -> Column:
    """(rank - 1) / (n - 1); 0.0 for a single row."""
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.col(cnt) if isinstance(cnt, str) else cnt
    return F.when(n > 1, (r - 1) / (n - 1)).otherwise(F.lit(0.0))


def cume_dist_of(le: Column | str = LE, cnt: Column | str = CNT) -> Column:
    """rows <= value / n."""
    a = F.col(le) if isinstance(le, str) else le
    n = F.col(cnt) if isinstance(cnt, str) else cnt
    return a / n


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One row of PERCENTILE_DISC values: the smallest x whose cumulative
    share of the non-NULL values reaches p (NULL without values)."""
    ranks = value_ranks(df.where(F.col(value).isNotNull()), value)
    reached = {k: F.col(LE) >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col(CNT))) for k, p in probs.items()}
    return ranks.agg(*[F.min(F.when(r, F.col(value))).alias(k) for k, r in reached.items()])


def top_k_with_rank_stats(
    df: DataFrame,
    value: str,
    k: int,
    tie_breakers: Sequence[Column] = (),
) -> DataFrame:
    """The ``k`` rows with the largest ``value`` (NULLs last, then
    ``tie_breakers``) with ``_rank``, ``_le`` and ``_cnt`` of the *ascending*
    order over all rows (NULLs first) — PERCENT_RANK / CUME_DIST of a top-k
    report without ranking every row.

    A top row's statistics depend only on the rows at or above its value, and
    every such row is itself in the top k.  So: one top-k pass (per-task top
    k, no sort of the data), one aggregate for the counts, and one count per
    distinct value at or above the smallest top value, at most k values.
    """
    v = F.col(value)
    top = df.orderBy(v.desc_nulls_last(), *tie_breakers).limit(k)
    threshold = top.agg(F.min(value).alias("_threshold"))  # one row; null without values
    sizes = df.agg(F.count(F.lit(1)).alias(CNT), F.count_if(v.isNull()).alias("_nulls"))  # one row
    above = Window.partitionBy(F.lit(0)).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (
        df.select(value).join(F.broadcast(threshold), v >= F.col("_threshold"))
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(value, F.sum("_n").over(above).alias("_ge"), "_n")
        .select(value, "_ge", (F.col("_ge") - F.col("_n")).alias("_gt"))
    )
    t, c = top.join(F.broadcast(sizes)).alias("_top"), F.broadcast(counts).alias("_c")  # at most k rows
    is_null = F.col(f"_top.`{value}`").isNull()
    total = F.col(f"_top.{CNT}")
    return t.join(c, F.col(f"_top.`{value}`") == F.col(f"_c.`{value}`"), "left").select(
        *[F.col(f"_top.`{col}`") for col in df.columns],
        F.when(is_null, F.lit(1).cast("bigint")).otherwise(total - F.col("_c._ge") + 1).alias(RANK),
        F.when(is_null, F.col("_top._nulls")).otherwise(total - F.col("_c._gt")).alias(LE),
        total.alias(CNT),
    )
