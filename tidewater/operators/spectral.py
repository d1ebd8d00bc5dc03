"""Fourier bases, least-squares Fourier fits and non-uniform DFTs on point
clouds, as joins, exploded wavenumber literals and grouped sums.

Complex numbers are (re, im) column pairs. A wavenumber set is a fixed
parameter (e.g. 9 x 9), so it is an array literal exploded next to each
point -- never a join with a data-sized table. Sums over points are
partial + final hash aggregates per (sample, wavenumber).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.common import salted_join

TWO_PI = 2.0 * math.pi


def wavenumbers(n: int, d: int = 2) -> list[tuple[int, ...]]:
    """SP1: integer lattice per axis -- odd n: -(n-1)/2 .. (n-1)/2, even n:
    -n/2 .. n/2 - 1 -- and its d-fold product (first axis slowest)."""
    ks = list(range(-(n // 2), n // 2)) if n % 2 == 0 else list(range(-(n - 1) // 2, (n - 1) // 2 + 1))
    return list(itertools.product(ks, repeat=d))


def nudft_modes(modes1: int, modes2: int) -> list[tuple[int, int]]:
    """Wavenumbers of the non-uniform DFT: k1 in 0..m1-1, -m1..-1 and k2 in
    0..m2-1, -(m2-1)..-1."""
    k1 = list(range(0, modes1)) + list(range(-modes1, 0))
    k2 = list(range(0, modes2)) + list(range(-(modes2 - 1), 0))
    return [(a, b) for a in k1 for b in k2]


def _ks_literal(ks: Sequence[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("k1"), F.lit(b).alias("k2")) for a, b in ks])


def with_wavenumbers(df: DataFrame, ks: Sequence[tuple[int, int]]) -> DataFrame:
    """Each row once per wavenumber (columns k1, k2 as BIGINT)."""
    x = df.select("*", F.explode(_ks_literal(ks)).alias("_k"))
    return x.select(*df.columns, F.col("_k.k1").cast("bigint").alias("k1"), F.col("_k.k2").cast("bigint").alias("k2"))


def _phase(x: str, y: str, center: float) -> Column:
    return F.lit(TWO_PI) * ((F.col(x) - center) * F.col("k1") + (F.col(y) - center) * F.col("k2"))


def fourier_basis(points: DataFrame, n: int, x: str = "x", y: str = "y", center: float = 0.5) -> DataFrame:
    """SP2: exp(i 2 pi (p - center) . k) for every point and wavenumber of
    :func:`wavenumbers` (n per axis): adds k1, k2, re, im."""
    b = with_wavenumbers(points, wavenumbers(n, 2))
    ph = _phase(x, y, center)
    return b.withColumn("re", F.cos(ph)).withColumn("im", F.sin(ph))


def fourier_project(points: DataFrame, value: str, n: int, by: Sequence[str] = ("cloud",), x: str = "x",
                    y: str = "y", center: float = 0.5) -> DataFrame:
    """Adjoint coefficients (1/N) sum_p u_p exp(-i theta_k(p)) per sample:
    the least-squares solution when the points form an exact lattice."""
    by = list(by)
    b = fourier_basis(points, n, x, y, center)
    return b.groupBy(*by, "k1", "k2").agg((F.sum(F.col(value) * F.col("re")) / F.count(F.lit(1))).alias("re"),
                                         (-F.sum(F.col(value) * F.col("im")) / F.count(F.lit(1))).alias("im"))


def fourier_fit(points: DataFrame, value: str, n: int, by: Sequence[str] = ("cloud",), x: str = "x",
                y: str = "y", center: float = 0.5, rcond: float = 1e-10) -> DataFrame:
    """SP3: least-squares Fourier coefficients per sample (minimum norm when
    rank deficient), as (by..., k1, k2, re, im).

    The Gram matrix entry for (k, k') depends only on k' - k, so Spark sums
    exp(i theta) over the (2n-1)^2 wavenumber differences and the right-hand
    side over the n^2 wavenumbers, per sample, with partial aggregates. Only
    those small per-sample tables (bounded by n, not by the points) go to one
    ``applyInPandas`` call per sample, which assembles the Hermitian system
    and solves it with a pseudo-inverse.
    """
    by = list(by)
    ks = wavenumbers(n, 2)
    diffs = sorted({(b1 - a1, b2 - a2) for (a1, a2) in ks for (b1, b2) in ks})
    g = with_wavenumbers(points.select(*by, x, y), diffs)
    ph = _phase(x, y, center)
    gram = g.groupBy(*by, "k1", "k2").agg(F.sum(F.cos(ph)).alias("re"), F.sum(F.sin(ph)).alias("im"))
    gram = gram.withColumn("part", F.lit("g"))
    r = with_wavenumbers(points.select(*by, x, y, value), ks)
    ph = _phase(x, y, center)
    rhs = r.groupBy(*by, "k1", "k2").agg(F.sum(F.col(value) * F.cos(ph)).alias("re"),
                                         (-F.sum(F.col(value) * F.sin(ph))).alias("im"))
    rhs = rhs.withColumn("part", F.lit("b"))
    both = gram.unionByName(rhs)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in points.select(*by).schema.fields]
                       + ["k1 bigint", "k2 bigint", "re double", "im double"])
    index = {k: i for i, k in enumerate(ks)}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = {b: pdf[b].iloc[0] for b in by}
        gd = pdf[pdf["part"] == "g"]
        s = {(int(a), int(b)): complex(re, im) for a, b, re, im in zip(gd.k1, gd.k2, gd.re, gd.im)}
        m = len(ks)
        # G[k, k'] = sum_p conj(B_pk) B_pk' = S(k' - k)
        G = np.empty((m, m), dtype=complex)
        for i, (a1, a2) in enumerate(ks):
            for j, (b1, b2) in enumerate(ks):
                G[i, j] = s.get((b1 - a1, b2 - a2), 0.0)
        bd = pdf[pdf["part"] == "b"]
        rhs_v = np.zeros(m, dtype=complex)
        for a, b, re, im in zip(bd.k1, bd.k2, bd.re, bd.im):
            rhs_v[index[(int(a), int(b))]] = complex(re, im)
        c = np.linalg.pinv(G, rcond=rcond, hermitian=True) @ rhs_v
        out = pd.DataFrame({"k1": [k[0] for k in ks], "k2": [k[1] for k in ks], "re": c.real, "im": c.imag})
        for b, v in key.items():
            out.insert(0, b, v)
        return out[[*by, "k1", "k2", "re", "im"]]

    return both.groupBy(*by).applyInPandas(solve, schema)


def _coef_array(coef: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    w = weight if weight is not None else F.lit(1.0)
    return coef.groupBy(*by).agg(F.collect_list(F.struct(
        F.col("k1").cast("double").alias("k1"), F.col("k2").cast("double").alias("k2"),
        (F.col("re") * w).alias("re"), (F.col("im") * w).alias("im"))).alias("_c"))


def _series(x: Column, y: Column, center: float) -> Column:
    """Re sum_k c_k exp(i theta_k) = sum_k re cos(theta) - im sin(theta)."""
    def add(acc, c):
        ph = F.lit(TWO_PI) * ((x - center) * c["k1"] + (y - center) * c["k2"])
        return acc + c["re"] * F.cos(ph) - c["im"] * F.sin(ph)
    return F.aggregate(F.col("_c"), F.lit(0.0), add)


def fourier_eval(coef: DataFrame, targets: DataFrame, by: Sequence[str] = ("cloud",), x: str = "x",
                 y: str = "y", center: float = 0.5, out: str = "value") -> DataFrame:
    """SP4: real part of sum_k c_k exp(i 2 pi (p - center) . k) at each target.

    A sample's coefficients (bounded by the wavenumber count) are packed into
    one array and joined to its targets; the sum is a higher-order
    ``aggregate`` inside the row, so no targets x wavenumbers table is built.
    """
    by = list(by)
    arr = _coef_array(coef, by)
    t = salted_join(targets, arr, by, [x, y])
    return t.withColumn(out, _series(F.col(x), F.col(y), center)).drop("_c")


def nudft(points: DataFrame, value: str, modes1: int, modes2: int, by: Sequence[str] = ("cloud",),
          x: str = "x", y: str = "y") -> DataFrame:
    """SP5: sum_n u_n exp(-i 2 pi k . x_n) over each sample's points (no 1/N)
    -> (by..., k1, k2, re, im)."""
    by = list(by)
    b = with_wavenumbers(points.select(*by, x, y, value), nudft_modes(modes1, modes2))
    ph = _phase(x, y, 0.0)
    return b.groupBy(*by, "k1", "k2").agg(F.sum(F.col(value) * F.cos(ph)).alias("re"),
                                         (-F.sum(F.col(value) * F.sin(ph))).alias("im"))


def inudft(coef: DataFrame, targets: DataFrame, by: Sequence[str] = ("cloud",), x: str = "x",
           y: str = "y", out: str = "value") -> DataFrame:
    """SP6: inverse from the half spectrum (k2 >= 0): the conjugate mirror
    c(-k) = conj(c(k)) is added for k2 >= 1 and the real part taken. The
    mirror uses -k1 (the exact conjugate partner); since Re(conj(c) e^{-i t})
    = Re(c e^{i t}), it enters as weight 2 on the k2 >= 1 terms."""
    by = list(by)
    half = coef.where(F.col("k2") >= 0)
    w = F.when(F.col("k2") == 0, F.lit(1.0)).otherwise(F.lit(2.0))
    arr = _coef_array(half, by, w)
    t = salted_join(targets, arr, by, [x, y])
    return t.withColumn(out, _series(F.col(x), F.col(y), 0.0)).drop("_c")
