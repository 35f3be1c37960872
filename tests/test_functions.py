"""Column helpers: text cleaning, safe casts, business formulae, exact means."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tierline.functions import metrics as M
from tierline.functions.text import first_token_int, safe_int, trim_ws


def _one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("v")).collect()]


def test_trim_strips_unicode_whitespace(spark):
    got = _one(
        spark,
        trim_ws("s"),
        "s string",
        [("  a b  ",), ("\t\na\r\n",), ("\u00a0x\u3000",), (None,), ("",)],
    )
    assert got == ["a b", "a", "x", None, ""]


def test_safe_int_cases(spark):
    got = _one(
        spark,
        safe_int("s"),
        "s string",
        [("039",), ("ABC",), ("",), ("1.5",), ("0x1A",), ("-0x1a",), ("+7",), ("99999999999999999999",), (None,)],
    )
    assert got == [39, None, None, None, 26, -26, 7, None, None]


def test_drg_code_parsing_after_trim(spark):
    got = _one(
        spark,
        first_token_int(trim_ws("s")),
        "s string",
        [("039 - X",), ("ABC - X",), ("",), (" 470 X",), ("470",), (None,)],
    )
    assert got == [39, None, None, 470, 470, None]


def test_safe_divide_and_ratio(spark):
    rows = [(1.0, 0.0), (1.0, None), (None, 2.0), (3.0, 2.0)]
    assert _one(spark, M.safe_divide("a", "b"), "a double, b double", rows) == [None, None, None, 1.5]
    assert _one(spark, M.ratio("a", "b"), "a double, b double", rows) == [None, None, None, 1.5]


def test_trend_label_boundaries(spark):
    got = _one(spark, M.trend_label("p"), "p double", [(3.0,), (-3.0,), (3.01,), (-3.01,), (None,), (0.0,)])
    assert got == ["Stable", "Stable", "Increasing", "Decreasing", "Stable", "Stable"]


def test_size_category_inclusive(spark):
    got = _one(spark, M.size_category("v"), "v bigint", [(1999,), (2000,), (9999,), (10000,), (None,)])
    assert got == ["Small", "Medium", "Medium", "Large", "Small"]


def test_weighted_blend_and_zscore(spark):
    rows = [(10.0, 1, 20.0, 3, 5.0, 0.0), (10.0, 0, 20.0, 0, 5.0, 2.0)]
    schema = "a double, n bigint, b double, m bigint, x double, s double"
    assert _one(spark, M.weighted_blend("a", "n", "b", "m"), schema, rows) == [17.5, None]
    assert _one(spark, M.z_score("x", F.lit(1.0), "s"), schema, rows) == [None, 2.0]


def test_exact_mean_rounds_half_way_cases_up(spark):
    # 61249.235 is a half-way case; a double sum may land on either side.
    df = spark.createDataFrame([(61249.23,), (61249.24,)] * 7, "x double").repartition(5)
    assert df.agg(M.mean_round("x", 2)).first()[0] == 61249.24
    neg = spark.createDataFrame([(-1.01,), (-1.02,)], "x double")
    assert neg.agg(M.mean_round("x", 2)).first()[0] == -1.02
    empty = spark.createDataFrame([(None,)], "x double")
    assert empty.agg(M.mean_round("x", 2), M.mean_value("x")).first() == (None, None)


def test_trim_fast_path_equals_full_set_trim(spark):
    import random

    from tierline.functions.text import UNICODE_WHITESPACE

    rnd = random.Random(5)
    alphabet = list(UNICODE_WHITESPACE) + list("ab c")
    rows = [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 6))),) for _ in range(2000)]
    got = _one(spark, trim_ws("s"), "s string", rows)
    assert got == [s.strip(UNICODE_WHITESPACE) for (s,) in rows]


def _safe_int_reference(s):
    import re

    if s is None:
        return None
    if re.fullmatch(r"[+-]?[0-9]+", s):
        v = int(s)
    elif re.fullmatch(r"[+-]?0[xX][0-9a-fA-F]+", s):
        sign = -1 if s.startswith("-") else 1
        v = sign * int(s.lstrip("+-")[2:], 16)
    else:
        return None
    return v if -(2**63) <= v < 2**63 else None


def test_safe_int_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    token = st.text(alphabet="0123456789+-xXabfAF. ", max_size=22)
    edges = st.sampled_from(
        ["9223372036854775807", "9223372036854775808", "-9223372036854775808", "0x7FFFFFFFFFFFFFFF",
         "-0x8000000000000000", "0x8000000000000000", "+0", "-0", "007", "0x", "+-1"]
    )

    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.one_of(token, edges), min_size=40, max_size=120))
    def check(strings):
        got = _one(spark, safe_int("s"), "s string", [(x,) for x in strings])
        assert got == [_safe_int_reference(x) for x in strings]

    check()


def test_partitions_for_sizes_by_input():
    from tierline.session import partitions_for

    assert partitions_for(0) == 200
    assert partitions_for(100 << 40) == 100_000  # bounded
    assert partitions_for(10 << 30, target_bytes=128 << 20) == 200


@pytest.mark.parametrize("values", [[1e13, 3e13], [1e20], [3e-7, 3e-7], [float("nan"), 1.0], [float("inf"), 1.0], [None, 2.5]])
def test_mean_is_avg(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.agg(M.mean_value("x").alias("a"), F.avg("x").alias("b"), M.mean_round("x", 2).alias("c"), F.round(F.avg("x"), 2).alias("d")).first()
    assert repr(got.a) == repr(got.b) and repr(got.c) == repr(got.d)


def test_mean_is_the_exact_mean_rounded_once(spark):
    """Against rationals: cents, noisy products, many digits, half-way cases, several partitions."""
    import random
    from decimal import ROUND_HALF_UP, Decimal, localcontext
    from fractions import Fraction

    def want(values, digits):
        with localcontext(prec=80):
            mean = sum(Fraction(repr(v)) for v in values) / len(values)
            scaled = abs(mean) * 10**digits
            whole = int(scaled + Fraction(1, 2))
            return float(Decimal(whole if mean >= 0 else -whole).scaleb(-digits))

    rnd = random.Random(7)
    groups = {
        0: [0.124999999996],
        1: [round(rnd.uniform(-1e6, 1e6), 2) for _ in range(301)],
        2: [round(rnd.uniform(0, 1e5), 2) * (1 - 0.07) * (1 + 0.03) for _ in range(200)],
        3: [rnd.random() for _ in range(77)],
        4: [0.005, 0.015, 0.025, -0.045],
        5: [61249.23, 61249.24] * 50,
        6: [89_999_999_999.12, 1e11, 123456789012.75],
        7: [-1.005] * 3,
        8: [1 / 3, 2 / 3, 0.1 + 0.2],
        9: [0.0, -0.0, 5e-324],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, x double").repartition(7)
    digits = (0, 1, 2, 4, 6)
    got = {r.g: r for r in df.groupBy("g").agg(*[M.mean_round("x", d).alias(f"m{d}") for d in digits]).collect()}
    for g, values in groups.items():
        for d in digits:
            assert got[g][f"m{d}"] == want(values, d), (g, d)


def test_windowed_mean_is_the_grouped_one(spark):
    df = spark.createDataFrame([(i % 3, i / 7, i) for i in range(30)], "g int, x double, n bigint")
    over = " OVER (PARTITION BY g)"
    got = {(r.g, r.a, r.b) for r in df.select("g", M.mean_round("x", 3, over).alias("a"), M.mean_round("n", 1, over).alias("b")).collect()}
    want = {(r.g, r.a, r.b) for r in df.groupBy("g").agg(M.mean_round("x", 3).alias("a"), M.mean_round("n", 1).alias("b")).collect()}
    assert got == want
