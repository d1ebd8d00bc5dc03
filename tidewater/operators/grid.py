"""Operators on regular grids ``(sample, gx, gy, value)`` of size W x H.

Stencils and padding are written as "each cell sends its value to the
cells it contributes to" (an explode bounded by the kernel or the pad width)
followed by a grouped sum, so there is no self-join and a sample of any size
is spread over all tasks. The spectral low-pass is a separable DFT over the
kept modes only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def stencil(grid: DataFrame, kernel: Mapping[tuple[int, int], float], width: int, height: int,
            sample: str = "sample_id", value: str = "value") -> DataFrame:
    """SP8: periodic (circular) stencil, cross-correlation form:
    out(i, j) = sum_{(di, dj)} w(di, dj) * v((i + di) mod W, (j + dj) mod H).
    Output cells are those that receive at least one contribution."""
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w"))
                     for (dx, dy), w in kernel.items()])
    x = grid.select(sample, "gx", "gy", value, F.explode(offs).alias("_o"))
    x = x.select(sample, F.pmod(F.col("gx") - F.col("_o.dx"), F.lit(width)).cast("int").alias("gx"),
                 F.pmod(F.col("gy") - F.col("_o.dy"), F.lit(height)).cast("int").alias("gy"),
                 (F.col("_o.w") * F.col(value)).alias("_c"))
    return x.groupBy(sample, "gx", "gy").agg(F.sum("_c").alias(value))


def pad_grid(grid: DataFrame, pad: int, width: int, height: int, sample: str = "sample_id") -> DataFrame:
    """SET6: replicate padding by ``pad`` cells on every side; padded
    coordinates (px, py) run from 0 to W + 2 pad - 1. A border cell is copied
    to every padded position that clamps onto it."""
    def span(c: str, n: int) -> Column:
        lo = F.when(F.col(c) == 0, F.lit(-pad)).otherwise(F.col(c))
        hi = F.when(F.col(c) == n - 1, F.lit(n - 1 + pad)).otherwise(F.col(c))
        return F.sequence(lo, hi)
    x = grid.select("*", F.explode(span("gx", width)).alias("_px"))
    x = x.select("*", F.explode(span("gy", height)).alias("_py"))
    return x.select(sample, (F.col("_px") + pad).cast("int").alias("px"), (F.col("_py") + pad).cast("int").alias("py"),
                    *[c for c in grid.columns if c not in (sample, "gx", "gy")])


def crop_grid(padded: DataFrame, pad: int, width: int, height: int, sample: str = "sample_id") -> DataFrame:
    """SET6 inverse: keep the interior and shift back to (gx, gy)."""
    inner = padded.where((F.col("px") >= pad) & (F.col("px") < pad + width) &
                         (F.col("py") >= pad) & (F.col("py") < pad + height))
    return inner.select(sample, (F.col("px") - pad).cast("int").alias("gx"), (F.col("py") - pad).cast("int").alias("gy"),
                        *[c for c in padded.columns if c not in (sample, "px", "py")])


def grid_to_cloud(grid: DataFrame, width: int, height: int) -> DataFrame:
    """SET4: each cell becomes a point with id gx * H + gy and coordinates on
    the unit square with both ends included (gx / (W - 1), gy / (H - 1))."""
    return grid.select("*", (F.col("gx") * height + F.col("gy")).cast("bigint").alias("point_id"),
                       (F.col("gx") / F.lit(float(width - 1))).alias("x"),
                       (F.col("gy") / F.lit(float(height - 1))).alias("y"))


def lattice(samples: DataFrame, nx: int, ny: int, sample: str = "sample_id") -> DataFrame:
    """SET5: the uniform nx x ny lattice on [0, 1]^2 (both endpoints) for
    every sample row: (sample, ix, iy, x, y)."""
    s = samples.select(sample).distinct()
    s = s.select(sample, F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("ix"))
    # spread the lattice rows before expanding them, so a large lattice is not
    # generated by the single task that holds its sample row
    s = s.repartition(sample, "ix")
    s = s.select(sample, "ix", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("iy"))
    return s.select(sample, "ix", "iy", (F.col("ix") / F.lit(float(nx - 1))).alias("x"),
                    (F.col("iy") / F.lit(float(ny - 1))).alias("y"))


def low_pass(grid: DataFrame, n1: int, n2: int, width: int, height: int, sample: str = "sample_id",
             value: str = "value", multipliers: Mapping[tuple[int, int], complex] | None = None) -> DataFrame:
    """SP7: real 2-D FFT, keep the first and last ``n1`` rows and the first
    ``n2`` columns of the half spectrum (times optional multipliers), inverse
    real FFT back to every lattice cell.

    Forward: a DFT along x for the kept kx (cells x 2 n1 rows, grouped by
    (sample, kx, gy)), then along y for ky < n2. Inverse: the kept spectrum of
    a sample (2 n1 x n2 values) is one array joined to its W x H cells and
    summed inside the row; Hermitian weights 1 for ky = 0 (and the Nyquist
    column), 2 otherwise, real part, 1 / (W H).
    """
    kxs = sorted(set(range(n1)) | set(range(width - n1, width)))
    kys = list(range(n2))
    x = grid.select(sample, "gx", "gy", value, F.explode(F.array(*[F.lit(k) for k in kxs])).alias("kx"))
    th = F.lit(TWO_PI) * F.col("kx") * F.col("gx") / F.lit(float(width))
    a = x.groupBy(sample, "kx", "gy").agg(F.sum(F.col(value) * F.cos(th)).alias("ar"),
                                          F.sum(-F.col(value) * F.sin(th)).alias("ai"))
    y = a.select("*", F.explode(F.array(*[F.lit(k) for k in kys])).alias("ky"))
    ph = F.lit(TWO_PI) * F.col("ky") * F.col("gy") / F.lit(float(height))
    fq = y.groupBy(sample, "kx", "ky").agg(
        F.sum(F.col("ar") * F.cos(ph) + F.col("ai") * F.sin(ph)).alias("re"),
        F.sum(F.col("ai") * F.cos(ph) - F.col("ar") * F.sin(ph)).alias("im"))
    if multipliers:
        mre = F.create_map(*[x for (kx, ky), m in multipliers.items() for x in (F.lit(f"{kx},{ky}"), F.lit(complex(m).real))])
        mim = F.create_map(*[x for (kx, ky), m in multipliers.items() for x in (F.lit(f"{kx},{ky}"), F.lit(complex(m).imag))])
        key = F.concat_ws(",", F.col("kx").cast("string"), F.col("ky").cast("string"))
        r, i = F.coalesce(mre[key], F.lit(1.0)), F.coalesce(mim[key], F.lit(0.0))
        fq = fq.select(sample, "kx", "ky", (F.col("re") * r - F.col("im") * i).alias("re"),
                       (F.col("re") * i + F.col("im") * r).alias("im"))
    w = F.when((F.col("ky") == 0) | ((F.lit(height % 2) == 0) & (F.col("ky") == height // 2)), F.lit(1.0)).otherwise(F.lit(2.0))
    arr = fq.groupBy(sample).agg(F.collect_list(F.struct(
        F.col("kx").cast("double").alias("kx"), F.col("ky").cast("double").alias("ky"),
        (F.col("re") * w).alias("re"), (F.col("im") * w).alias("im"))).alias("_c"))
    cells = lattice(grid, width, height, sample).select(sample, F.col("ix").alias("gx"), F.col("iy").alias("gy"))
    t = cells.join(arr, sample)

    def add(acc, c):
        ang = F.lit(TWO_PI) * c["kx"] * F.col("gx") / F.lit(float(width)) + \
            F.lit(TWO_PI) * c["ky"] * F.col("gy") / F.lit(float(height))
        return acc + c["re"] * F.cos(ang) - c["im"] * F.sin(ang)
    out = t.select(sample, F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"),
                   (F.aggregate("_c", F.lit(0.0), add) / F.lit(float(width * height))).alias(value))
    return out
