"""Feature standardisation and sample projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.common import attach_scalars, salted_join


def standardise(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), eps: float = 1e-5) -> DataFrame:
    """PRJ16: (v - mean) / sqrt(population variance + eps) per column, over the
    whole table or per ``by`` group (batch-norm statistics, no learned scale).
    Statistics are a partial + final aggregate joined back (salted: a group may hold most rows), not a window."""
    by = list(by)
    stats = (df.groupBy(*by) if by else df.groupBy()).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.var_pop(c).alias(f"_v_{c}") for c in cols],
        F.count(F.lit(1)).alias("_rows"))
    j = salted_join(df, stats, by, list(cols), weight="_rows") if by else attach_scalars(df, stats)
    for c in cols:
        j = j.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.sqrt(F.col(f"_v_{c}") + F.lit(eps)))
    return j.drop(*[f"_m_{c}" for c in cols], *[f"_v_{c}" for c in cols], "_rows")


def to_struct(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = (), out: str = "sample") -> DataFrame:
    """PRJ17: project the named columns of a sample into one struct column."""
    return df.select(*keep, F.struct(*fields).alias(out))
