"""Business formulae as Column -> Column functions.

Every function is null-propagating like the SQL it stands for, never raises
under ANSI mode, and takes its thresholds as parameters whose defaults are
the reference values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SQL of an aggregate from its function and argument.
Put = Callable[[str, str], str]

#: Values of so many decimal digits, below this magnitude, are summed as integers.
EXACT_DIGITS, EXACT_BELOW = 8, "9e10D"
#: Bits of the lower of the two integers such a value is summed in: 2^41 rows fit.
LIMB = 22
#: Digits that other values are summed with, below this magnitude.
FINE_DIGITS, FINE_BELOW = 18, "1e12D"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullif_zero(c: Column | str) -> Column:
    """NULLIF(x, 0)."""
    return F.nullif(_col(c), F.lit(0))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """SAFE_DIVIDE(a, b): double quotient, NULL when b is 0 or NULL."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """SAFE_DIVIDE(a, NULLIF(b, 0)) — the guarded ratio used throughout."""
    return safe_divide(a, nullif_zero(b))


def pct_change(new: Column | str, old: Column | str) -> Column:
    """Unrounded percentage change; NULL when the old value is 0 or NULL."""
    return ratio(_col(new) - _col(old), old) * F.lit(100)


def weighted_blend(
    a: Column | str, n: Column | str, b: Column | str, m: Column | str
) -> Column:
    """(a*n + b*m) / NULLIF(n + m, 0): volume-weighted mean of two sources."""
    return ratio(_col(a) * _col(n) + _col(b) * _col(m), _col(n) + _col(m))


def trend_label(
    pct: Column | str,
    threshold: float = 3.0,
    up: str = "Increasing",
    down: str = "Decreasing",
    flat: str = "Stable",
) -> Column:
    """Strict > threshold / < -threshold on the unrounded change; NULL is flat."""
    p = _col(pct)
    return (
        F.when(p > F.lit(threshold), F.lit(up))
        .when(p < F.lit(-threshold), F.lit(down))
        .otherwise(F.lit(flat))
    )


def size_category(
    volume: Column | str,
    large_at: float = 10000,
    medium_at: float = 2000,
) -> Column:
    """'Large' / 'Medium' / 'Small' with inclusive lower thresholds."""
    v = _col(volume)
    return (
        F.when(v >= F.lit(large_at), F.lit("Large"))
        .when(v >= F.lit(medium_at), F.lit("Medium"))
        .otherwise(F.lit("Small"))
    )


def z_score(x: Column | str, mean: Column | str, stddev: Column | str) -> Column:
    """(x - mean) / NULLIF(stddev, 0); NULL when the spread is 0 or NULL."""
    return (_col(x) - _col(mean)) / nullif_zero(stddev)


def pass_fail(condition: Column) -> Column:
    """CASE WHEN condition THEN 'PASS' ELSE 'FAIL' END."""
    return F.when(condition, F.lit("PASS")).otherwise(F.lit("FAIL"))


def mean_value(c: Column | str) -> Column:
    """AVG(c)."""
    return F.avg(_col(c))


def scaled_sql(c: str) -> str:
    """c as a whole number of 1e-8; NULL where that does not fit."""
    return f"CASE WHEN abs({c}) < {EXACT_BELOW} THEN CAST(rint({c} * 1e{EXACT_DIGITS}D) AS BIGINT) END"


def exact_sum_sql(c: str, over: str = "") -> str:
    """The sum of ``scaled_sql(c)``, exact in any order of the rows: two sums
    of 64-bit integers, put together once per group."""
    return _limbs(scaled_sql(c), _over(over))


def _over(over: str) -> Put:
    return lambda function, x: f"{function}({x}){over}"


def _limbs(v: str, put: Put) -> str:
    high, low = put("sum", f"shiftright({v}, {LIMB})"), put("sum", f"({v}) & {(1 << LIMB) - 1}")
    return f"(CAST({high} AS DECIMAL(38,0)) * {1 << LIMB} + CAST({low} AS DECIMAL(38,0)))"


def round_ratio_sql(numerator: str, denominator: str, digits: int, scale: int = 0) -> str:
    """numerator / (denominator * 10^scale) of whole numbers, denominator
    positive, rounded once, half away from zero, in whole numbers all the way."""
    up, unit = 10 ** max(0, digits - scale), 10 ** max(0, scale - digits)
    n = f"(abs({numerator}) * CAST({2 * up} AS DECIMAL(20,0)))"
    d = f"(CAST({denominator} AS DECIMAL(38,0)) * CAST({unit} AS DECIMAL(20,0)))"
    whole = f"({n} + {d})"
    floor = f"(({whole} - {whole} % ({d} * 2)) / ({d} * 2))"
    return f"(CASE WHEN {numerator} < 0 THEN -1D ELSE 1D END * CAST({floor} AS DOUBLE) / 1e{digits}D)"


class Steps:
    """Counts and sums in two steps: ``first`` has the aggregates of the first, and
    ``put`` gives the SQL that adds up their results in the second."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}

    def put(self, function: str, x: str) -> str:
        return f"sum({self.names.setdefault(f'{function}({x})', f'_step{len(self.names)}')})"

    @property
    def first(self) -> list[Column]:
        return [F.expr(sql).alias(name) for sql, name in self.names.items()]


def mean_sql(c: str, digits: int, over: str = "", put: Put | None = None) -> str:
    """ROUND(AVG(c), digits) as SQL: the mean of the values' shortest decimals,
    summed exactly and rounded once, so the same for every order and partitioning
    of the rows.  Values of up to 8 decimal digits, as amounts are, add up as
    integers; others as decimals of 18 digits.  Values of 1e12 and more, NaN and
    infinity have no such decimals: a group with one of them gets the mean of
    doubles.  ``put`` says how its counts and sums are taken, by default at once."""
    put = put or _over(over)
    few = f"(abs({c}) < {EXACT_BELOW} AND rint({c} * 1e{EXACT_DIGITS}D) / 1e{EXACT_DIGITS}D = {c})"
    whole = _limbs(f"CASE WHEN {few} THEN CAST(rint({c} * 1e{EXACT_DIGITS}D) AS BIGINT) END", put)
    fine = put("sum", f"CASE WHEN NOT {few} AND abs({c}) < {FINE_BELOW} THEN CAST({c} AS DECIMAL(38,{FINE_DIGITS})) END")
    up = f"CAST({10**FINE_DIGITS} AS DECIMAL(19,0))"
    total = (
        f"(coalesce({whole}, 0) * CAST({10 ** (FINE_DIGITS - EXACT_DIGITS)} AS DECIMAL(11,0)) "
        f"+ coalesce(CAST({fine} * {up} AS DECIMAL(38,0)), 0))"
    )
    n = put("count", c)
    odd = put("sum", f"CASE WHEN NOT abs({c}) < {FINE_BELOW} THEN CAST({c} AS DOUBLE) END")
    doubles = f"round(({odd} + CAST({total} AS DOUBLE) / 1e{FINE_DIGITS}D) / {n}, {digits})"
    exact = round_ratio_sql(total, n, digits, FINE_DIGITS)
    return f"CASE WHEN {n} = 0 THEN CAST(NULL AS DOUBLE) WHEN {odd} IS NULL THEN {exact} ELSE {doubles} END"


def mean_round(c: str, digits: int, over: str = "") -> Column:
    """``mean_sql`` as a Column; ``over`` is an OVER clause."""
    return F.expr(mean_sql(c, digits, over))
