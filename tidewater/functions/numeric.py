"""Numeric column helpers shared by operators and query plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_NUDGE = 0.000314159
# floor() gives a BIGINT: from here on a scaled value would leave it
_WHOLE = float(2 ** 53)


def fixed(c: Column | str, digits: int = 6) -> Column:
    """Round half-up to ``digits`` decimals as ``floor(x * 10^d + 0.5) / 10^d``.

    Written with plain IEEE multiply/floor/divide so that any engine running the
    same arithmetic lands on the same double; also clears negative zero. The
    boundary sits a little off the exact half (``+ 0.5 + _NUDGE``): data with
    few decimals often averages to an exact ``...5`` at digit d+1, and there
    the last-ulp noise of a different summation order would decide the digit.

    Small values get more decimals (three more below 1, six more below 1e-3),
    large ones none, and those with no room for a fraction, NaN and the
    infinities pass unchanged.
    """
    c = F.col(c) if isinstance(c, str) else c

    def at(d: int) -> Column:
        scale = float(10 ** d)
        return (F.floor(c * F.lit(scale) + F.lit(0.5 + _NUDGE)) / F.lit(scale)).cast("double")

    size = F.abs(c)
    return (F.when(size < 1e-3, at(digits + 6)).when(size < 1, at(digits + 3))
            .when(size < _WHOLE / 10 ** digits, at(digits)).when(size < _WHOLE, at(0)).otherwise(c.cast("double")))


def fixed_sql(expr: str, digits: int = 6) -> str:
    """SQL text of :func:`fixed` for an oracle query."""
    def at(d: int) -> str:
        return f"FLOOR(x * {10 ** d}.0::DOUBLE + {0.5 + _NUDGE!r}::DOUBLE) / {10 ** d}.0::DOUBLE"

    return (f"list_transform([CAST({expr} AS DOUBLE)], lambda x: CASE WHEN x IS NULL OR isnan(x) THEN x "
            f"WHEN ABS(x) < 0.001 THEN {at(digits + 6)} WHEN ABS(x) < 1 THEN {at(digits + 3)} "
            f"WHEN ABS(x) < {_WHOLE / 10 ** digits!r} THEN {at(digits)} WHEN ABS(x) < {_WHOLE!r} THEN {at(0)} ELSE x END)[1]")
