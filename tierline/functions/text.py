"""String cleaning expressions used by the staging layer (JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points (Unicode standard,
# PropList.txt). GoogleSQL TRIM without a character argument strips exactly
# these; Spark's one-argument trim strips only U+0020.
UNICODE_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_WS_CHARS = tuple(UNICODE_WHITESPACE)

DECIMAL_INT_PATTERN = r"^[+-]?[0-9]+$"
HEX_INT_PATTERN = r"^[+-]?0[xX][0-9a-fA-F]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip leading/trailing Unicode whitespace; NULL stays NULL.

    Spark's space-only ``trim`` runs first (fast); the character-set trim
    (about 4x slower per string) runs only when another whitespace code
    point is left at an edge, which real text rarely has.
    """
    spaced = F.trim(_col(c))
    edge = F.substring(spaced, 1, 1).isin(*_WS_CHARS) | F.substring(spaced, -1, 1).isin(*_WS_CHARS)
    return F.when(edge, F.trim(spaced, F.lit(UNICODE_WHITESPACE))).otherwise(spaced)


def safe_int(c: Column | str) -> Column:
    """SAFE_CAST(string AS INT64): decimal or 0x-hex integer text, else NULL.

    ``'1.5'``, ``''`` and out-of-range values give NULL, as in GoogleSQL.
    The pattern guard keeps engines that round ``'1.5'`` to 2 out of it.
    """
    s = _col(c)
    sign = F.when(F.substring(s, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hex_digits = F.regexp_replace(s, r"^[+-]?0[xX]", "")
    # conv() yields unsigned decimal text; above 2^63-1 the bigint try_cast
    # turns into NULL, which is the INT64 overflow of SAFE_CAST.
    hex_value = (F.conv(hex_digits, 16, 10).try_cast("decimal(21,0)") * sign).try_cast(
        "bigint"
    )
    return (
        F.when(s.rlike(DECIMAL_INT_PATTERN), s.try_cast("bigint"))
        .when(s.rlike(HEX_INT_PATTERN), hex_value)
        .otherwise(F.lit(None).cast("bigint"))
    )


def first_token_int(c: Column | str) -> Column:
    """SAFE_CAST(SPLIT(s, ' ')[OFFSET(0)] AS INT64) with a literal delimiter."""
    return safe_int(F.split_part(_col(c), F.lit(" "), F.lit(1)))
