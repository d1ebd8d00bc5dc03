"""Spectral, stencil, lattice and positional-feature queries over
``v_points`` and ``v_grid`` (15 x 15 per return flag)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import encoding as enc
from tidewater.functions.numeric import fixed, fixed_sql
from tidewater.operators import features as ft
from tidewater.operators import grid as gd
from tidewater.operators import spectral as sp
from tidewater.plans.registry import register
from tidewater.plans.sql_views import with_views
from tidewater.sources.views import GRID_N, v_grid, v_points

TP = f"CAST({2.0 * math.pi!r} AS DOUBLE)"
N = GRID_N


def _values(rows, names):
    body = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(names)}))"


def _psql(body: str, **extra: str) -> str:
    return with_views(body, "v_points", extra=extra or None)


def _gsql(body: str, **extra: str) -> str:
    return with_views(body, "v_grid", extra=extra or None)


# ------------------------------------------------------------ SP1 / SP2
_KS3 = _values(sp.wavenumbers(3, 2), ["k1", "k2"])


@register("sp2_fourier_basis", _psql(f"""
SELECT p.cloud, p.point_id, CAST(k.k1 AS BIGINT) AS k1, CAST(k.k2 AS BIGINT) AS k2,
       {fixed_sql(f'COS({TP} * ((p.x - 0.5) * k.k1 + (p.y - 0.5) * k.k2))')} AS re,
       {fixed_sql(f'SIN({TP} * ((p.x - 0.5) * k.k1 + (p.y - 0.5) * k.k2))')} AS im
FROM v_points p CROSS JOIN {_KS3} k"""), ops=("SP1", "SP2"))
def basis_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sp.fourier_basis(v_points(spark, sf_dir), 3)
    return b.select("cloud", "point_id", "k1", "k2", fixed("re").alias("re"), fixed("im").alias("im"))


# ------------------------------------------------------------ SP3 (solve: no SQL)
@register("sp3_fourier_fit", None, ops=("SP3", "SP1"))
def fit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares 5 x 5 Fourier coefficients of f1 per cloud."""
    c = sp.fourier_fit(v_points(spark, sf_dir), "f1", 5)
    return c.select("cloud", "k1", "k2", fixed("re", 4).alias("re"), fixed("im", 4).alias("im"))


# a real field: the coefficients of -k are the conjugates of those of k
_KNOWN = {(0, 0): (0.5, 0.0), (1, 0): (0.25, -0.125), (-1, 0): (0.25, 0.125), (1, 2): (-0.0625, 0.3125), (-1, -2): (-0.0625, -0.3125)}
_KNOWN_SQL = " UNION ALL ".join(
    f"SELECT CAST({a} AS BIGINT) AS k1, CAST({b} AS BIGINT) AS k2, "
    f"CAST({_KNOWN.get((a, b), (0.0, 0.0))[0]} AS DOUBLE) AS re, CAST({_KNOWN.get((a, b), (0.0, 0.0))[1]} AS DOUBLE) AS im"
    for a in range(-2, 3) for b in range(-2, 3))


@register("sp3_fourier_fit_known", with_views(f"""
SELECT c.cloud, k.k1, k.k2, k.re, k.im FROM (SELECT DISTINCT cloud FROM v_points) c CROSS JOIN ({_KNOWN_SQL}) k""", "v_points"),
          ops=("SP3", "SP1"))
def fit_known_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 x 5 fit of a field with known coefficients, at the given positions
    spread over the unit square, gives those coefficients back."""
    p = v_points(spark, sf_dir).select("cloud", "point_id", *[((F.col(c) - 0.5) * 4 + 0.5).alias(c) for c in ("x", "y")])

    def term(k, c):
        ph = F.lit(2 * math.pi) * ((F.col("x") - 0.5) * k[0] + (F.col("y") - 0.5) * k[1])
        return c[0] * F.cos(ph) - c[1] * F.sin(ph)

    field = sum((term(k, c) for k, c in _KNOWN.items()), F.lit(0.0))
    c = sp.fourier_fit(p.withColumn("v", field), "v", 5)
    # six decimals, for zeros as well: what is left of them is the solver's noise
    return c.select("cloud", "k1", "k2", *[(F.round(x, 6) + 0.0).alias(x) for x in ("re", "im")])


# ------------------------------------------------------------ SP4
_PROJ = f"""SELECT p.cloud, k.k1, k.k2,
    SUM(p.f1 * COS({TP} * ((p.x - 0.5) * k.k1 + (p.y - 0.5) * k.k2))) / COUNT(*) AS re,
    -SUM(p.f1 * SIN({TP} * ((p.x - 0.5) * k.k1 + (p.y - 0.5) * k.k2))) / COUNT(*) AS im
  FROM v_points p CROSS JOIN {_KS3} k GROUP BY 1, 2, 3"""


@register("sp4_fourier_eval", _psql(f"""
SELECT p.cloud, p.point_id,
       {fixed_sql(f'SUM(c.re * COS({TP} * ((p.x - 0.5) * c.k1 + (p.y - 0.5) * c.k2)) - c.im * SIN({TP} * ((p.x - 0.5) * c.k1 + (p.y - 0.5) * c.k2)))')} AS value
FROM v_points p JOIN c ON c.cloud = p.cloud GROUP BY p.cloud, p.point_id""", c=_PROJ), ops=("SP4", "SP2"))
def eval_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected 3 x 3 coefficients of f1 evaluated back at every point."""
    p = v_points(spark, sf_dir)
    out = sp.fourier_eval(sp.fourier_project(p, "f1", 3), p)
    return out.select("cloud", "point_id", fixed("value").alias("value"))


# ------------------------------------------------------------ SP5 / SP6
_MODES = _values(sp.nudft_modes(4, 4), ["k1", "k2"])
_NUDFT = f"""SELECT p.cloud, CAST(k.k1 AS BIGINT) AS k1, CAST(k.k2 AS BIGINT) AS k2,
    SUM(p.f1 * COS({TP} * ((p.x - 0.0) * k.k1 + (p.y - 0.0) * k.k2))) AS re,
    -SUM(p.f1 * SIN({TP} * ((p.x - 0.0) * k.k1 + (p.y - 0.0) * k.k2))) AS im
  FROM v_points p CROSS JOIN {_MODES} k GROUP BY 1, 2, 3"""


@register("sp5_nudft", _psql(f"SELECT cloud, k1, k2, {fixed_sql('re')} AS re, {fixed_sql('im')} AS im FROM d",
                             d=_NUDFT), ops=("SP5",))
def nudft_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sp.nudft(v_points(spark, sf_dir), "f1", 4, 4)
    return d.select("cloud", "k1", "k2", fixed("re").alias("re"), fixed("im").alias("im"))


@register("sp6_inudft", _psql(f"""
SELECT p.cloud, p.point_id,
       {fixed_sql(f'SUM(CASE WHEN d.k2 = 0 THEN 1.0 ELSE 2.0 END * (d.re * COS({TP} * ((p.x - 0.0) * d.k1 + (p.y - 0.0) * d.k2)) - d.im * SIN({TP} * ((p.x - 0.0) * d.k1 + (p.y - 0.0) * d.k2))))')} AS value
FROM v_points p JOIN d ON d.cloud = p.cloud AND d.k2 >= 0 GROUP BY p.cloud, p.point_id""", d=_NUDFT),
          ops=("SP6", "SP5"))
def inudft_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v_points(spark, sf_dir)
    out = sp.inudft(sp.nudft(p, "f1", 4, 4), p)
    return out.select("cloud", "point_id", fixed("value").alias("value"))


# ------------------------------------------------------------ SP7
N1, N2 = 3, 3
_KX = sorted(set(range(N1)) | set(range(N - N1, N)))


@register("sp7_low_pass", _gsql(f"""
SELECT pos.sample_id, CAST(pos.gx AS INT) AS gx, CAST(pos.gy AS INT) AS gy,
       {fixed_sql(f'SUM(CASE WHEN f.ky = 0 THEN 1.0 ELSE 2.0 END * (f.re * COS({TP} * f.kx * pos.gx / {float(N)!r} + {TP} * f.ky * pos.gy / {float(N)!r}) - f.im * SIN({TP} * f.kx * pos.gx / {float(N)!r} + {TP} * f.ky * pos.gy / {float(N)!r}))) / {float(N * N)!r}')} AS value
FROM pos JOIN f USING (sample_id) GROUP BY 1, 2, 3""",
                                 a=f"""SELECT g.sample_id, kx.kx, g.gy,
        SUM(g.value * COS({TP} * kx.kx * g.gx / {float(N)!r})) AS ar, SUM(-g.value * SIN({TP} * kx.kx * g.gx / {float(N)!r})) AS ai
        FROM v_grid g CROSS JOIN {_values([(k,) for k in _KX], ['kx'])} kx GROUP BY 1, 2, 3""",
                                 f=f"""SELECT a.sample_id, a.kx, ky.ky,
        SUM(a.ar * COS({TP} * ky.ky * a.gy / {float(N)!r}) + a.ai * SIN({TP} * ky.ky * a.gy / {float(N)!r})) AS re,
        SUM(a.ai * COS({TP} * ky.ky * a.gy / {float(N)!r}) - a.ar * SIN({TP} * ky.ky * a.gy / {float(N)!r})) AS im
        FROM a CROSS JOIN {_values([(k,) for k in range(N2)], ['ky'])} ky GROUP BY 1, 2, 3""",
                                 pos=f"""SELECT s.sample_id, gx.range AS gx, gy.range AS gy FROM (SELECT DISTINCT sample_id FROM v_grid) s
        CROSS JOIN range(0, {N}) gx CROSS JOIN range(0, {N}) gy"""), ops=("SP7",))
def low_pass_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep 3 + 3 rows and 3 columns of the real 2-D spectrum of each grid."""
    lp = gd.low_pass(v_grid(spark, sf_dir), N1, N2, N, N)
    return lp.withColumn("value", fixed("value"))


# ------------------------------------------------------------ SP8
_KERNEL = {(1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}


@register("sp8_stencil", _gsql(f"""
SELECT g.sample_id, CAST(((g.gx - o.dx) % {N} + {N}) % {N} AS INT) AS gx,
       CAST(((g.gy - o.dy) % {N} + {N}) % {N} AS INT) AS gy, {fixed_sql('SUM(o.w * g.value)')} AS value
FROM v_grid g CROSS JOIN {_values([(dx, dy, w) for (dx, dy), w in _KERNEL.items()], ['dx', 'dy', 'w'])} o
GROUP BY 1, 2, 3"""), ops=("SP8",))
def stencil_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic 4-neighbour sum on each 15 x 15 grid."""
    s = gd.stencil(v_grid(spark, sf_dir), _KERNEL, N, N)
    return s.withColumn("value", fixed("value"))


# ------------------------------------------------------------ SET4 / SET5 / SET6
@register("set4_grid_to_cloud", _gsql(f"""
SELECT sample_id, CAST(gx * {N} + gy AS BIGINT) AS point_id, {fixed_sql(f'gx / {float(N - 1)!r}')} AS x,
       {fixed_sql(f'gy / {float(N - 1)!r}')} AS y, {fixed_sql('value')} AS value FROM v_grid"""), ops=("SET4",))
def g2c_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = gd.grid_to_cloud(v_grid(spark, sf_dir), N, N)
    return c.select("sample_id", "point_id", fixed("x").alias("x"), fixed("y").alias("y"), fixed("value").alias("value"))


@register("set5_lattice", _gsql(f"""
SELECT l.sample_id, CAST(l.ix AS BIGINT) AS ix, CAST(l.iy AS BIGINT) AS iy, {fixed_sql(f'l.ix / {float(N - 1)!r}')} AS x,
       {fixed_sql(f'l.iy / {float(N - 1)!r}')} AS y, {fixed_sql('g.value')} AS value
FROM (SELECT s.sample_id, a.range AS ix, b.range AS iy FROM (SELECT DISTINCT sample_id FROM v_grid) s
      CROSS JOIN range(0, {N}) a CROSS JOIN range(0, {N}) b) l
LEFT JOIN v_grid g ON g.sample_id = l.sample_id AND g.gx = l.ix AND g.gy = l.iy"""), ops=("SET5",))
def lattice_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 x 15 lattice of every sample with its cell value (NULL when empty)."""
    g = v_grid(spark, sf_dir)
    lat = gd.lattice(g, N, N)
    j = lat.join(g.select("sample_id", F.col("gx").alias("ix"), F.col("gy").alias("iy"), "value"),
                 ["sample_id", "ix", "iy"], "left")
    return j.select("sample_id", F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"),
                    fixed("x").alias("x"), fixed("y").alias("y"), fixed("value").alias("value"))


PAD = 2
_PAD_SQL = f"""SELECT g.sample_id, CAST(a.px + {PAD} AS INT) AS px, CAST(b.py + {PAD} AS INT) AS py, g.value
  FROM v_grid g,
  LATERAL (SELECT range AS px FROM range(CASE WHEN g.gx = 0 THEN -{PAD} ELSE g.gx END,
                                         CASE WHEN g.gx = {N - 1} THEN {N - 1 + PAD} ELSE g.gx END + 1)) a,
  LATERAL (SELECT range AS py FROM range(CASE WHEN g.gy = 0 THEN -{PAD} ELSE g.gy END,
                                         CASE WHEN g.gy = {N - 1} THEN {N - 1 + PAD} ELSE g.gy END + 1)) b"""


@register("set6_pad_grid", _gsql(f"SELECT sample_id, px, py, {fixed_sql('value')} AS value FROM p", p=_PAD_SQL),
          ops=("SET6",))
def pad_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gd.pad_grid(v_grid(spark, sf_dir), PAD, N, N)
    return p.withColumn("value", fixed("value"))


@register("set6_crop_grid", _gsql(f"""
SELECT sample_id, CAST(px - {PAD} AS INT) AS gx, CAST(py - {PAD} AS INT) AS gy, {fixed_sql('value')} AS value FROM p
WHERE px >= {PAD} AND px < {PAD + N} AND py >= {PAD} AND py < {PAD + N}""", p=_PAD_SQL), ops=("SET6",))
def crop_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = gd.crop_grid(gd.pad_grid(v_grid(spark, sf_dir), PAD, N, N), PAD, N, N)
    return c.withColumn("value", fixed("value"))


# ------------------------------------------------------------ PRJ14 / PRJ15 / PRJ16 / PRJ17
_C = repr(enc.POLAR_CENTER)
_POLAR = f"""SELECT cloud, point_id, x, y, ATAN2(y - {_C}, x - {_C}) AS angle,
                    SQRT((x - {_C}) * (x - {_C}) + (y - {_C}) * (y - {_C})) AS radius FROM v_points"""


def _polar_df(spark, sf_dir):
    p = v_points(spark, sf_dir)
    a, r = enc.polar("x", "y")
    return p.select("cloud", "point_id", "x", "y", a.alias("angle"), r.alias("radius"))


@register("prj14_polar", _psql(f"SELECT cloud, point_id, {fixed_sql('angle')} AS angle, "
                               f"{fixed_sql('radius')} AS radius FROM pl", pl=_POLAR), ops=("PRJ14",))
def polar_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polar_df(spark, sf_dir).select("cloud", "point_id", fixed("angle").alias("angle"),
                                           fixed("radius").alias("radius"))


_OCT = 8
_OCT_ROWS = [(d, i, repr(math.pi * 2.0 ** i)) for d in range(4) for i in range(_OCT)]


@register("prj15_octave", _psql(f"""
SELECT pl.cloud, pl.point_id, CAST(o.d AS BIGINT) AS input, CAST(o.i AS BIGINT) AS i,
       {fixed_sql('SIN(o.f * CASE o.d WHEN 0 THEN pl.x WHEN 1 THEN pl.y WHEN 2 THEN pl.angle ELSE pl.radius END)')} AS s,
       {fixed_sql('COS(o.f * CASE o.d WHEN 0 THEN pl.x WHEN 1 THEN pl.y WHEN 2 THEN pl.angle ELSE pl.radius END)')} AS c
FROM pl CROSS JOIN (SELECT * FROM (VALUES {', '.join(f'({d}, {i}, {f})' for d, i, f in _OCT_ROWS)}) t(d, i, f)) o""",
                                pl=_POLAR), ops=("PRJ15", "PRJ14"))
def octave_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sin / cos of pi 2^i v, i < 8, for v in (x, y, angle, radius)."""
    p = _polar_df(spark, sf_dir)
    o = p.select("cloud", "point_id", F.explode(enc.octave([F.col(c) for c in ("x", "y", "angle", "radius")],
                                                           _OCT)).alias("e"))
    return o.select("cloud", "point_id", "e.input", "e.i", fixed("e.s").alias("s"), fixed("e.c").alias("c"))


@register("prj16_standardise", _psql(f"""
SELECT p.cloud, p.point_id, {fixed_sql('(p.f1 - s.m1) / SQRT(s.v1 + 1e-05)')} AS f1,
       {fixed_sql('(p.f2 - s.m2) / SQRT(s.v2 + 1e-05)')} AS f2
FROM v_points p JOIN (SELECT cloud, AVG(f1) AS m1, VAR_POP(f1) AS v1, AVG(f2) AS m2, VAR_POP(f2) AS v2
                      FROM v_points GROUP BY cloud) s USING (cloud)"""), ops=("PRJ16",))
def standardise_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ft.standardise(v_points(spark, sf_dir), ["f1", "f2"], ["cloud"])
    return s.select("cloud", "point_id", fixed("f1").alias("f1"), fixed("f2").alias("f2"))


@register("prj17_to_struct", _psql(f"SELECT cloud, point_id, {fixed_sql('x')} AS x, {fixed_sql('y')} AS y, "
                                   f"{fixed_sql('f1')} AS f1 FROM v_points"), ops=("PRJ17",))
def struct_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples packed as struct(x, y, f1) and read back by field."""
    s = ft.to_struct(v_points(spark, sf_dir), ["x", "y", "f1"], ["cloud", "point_id"])
    return s.select("cloud", "point_id", fixed("sample.x").alias("x"), fixed("sample.y").alias("y"),
                    fixed("sample.f1").alias("f1"))
