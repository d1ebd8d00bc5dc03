"""Positional feature columns: polar coordinates and octave (sin/cos)
encodings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the centre offset of the polar features.
POLAR_CENTER = 0.0001


def polar(x: Column | str, y: Column | str, center: float = POLAR_CENTER) -> tuple[Column, Column]:
    """PRJ14: (angle, radius) about (center, center): atan2(y - c, x - c) and
    the Euclidean norm."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    dx, dy = x - F.lit(center), y - F.lit(center)
    return F.atan2(dy, dx), F.sqrt(dx * dx + dy * dy)


def octave(values: Sequence[Column], n: int) -> Column:
    """PRJ15: array of structs (input, i, s, c) with s = sin(pi 2^i v),
    c = cos(pi 2^i v) for i = 0..n-1 and every input v (input-major)."""
    items = []
    for d, v in enumerate(values):
        for i in range(n):
            f = F.lit(math.pi * 2.0 ** i)
            items.append(F.struct(F.lit(d).cast("bigint").alias("input"), F.lit(i).cast("bigint").alias("i"),
                                  F.sin(f * v).alias("s"), F.cos(f * v).alias("c")))
    return F.array(*items)
