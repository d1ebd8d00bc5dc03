"""Voxel, curve-code, pooling and patch queries over ``v_points`` (cloud =
batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import curves as cv
from tidewater.functions.numeric import fixed, fixed_sql
from tidewater.operators import pooling as pl
from tidewater.plans.registry import register
from tidewater.plans.sql_views import with_views
from tidewater.sources.views import v_points

GRID = 0.01
STRIDE = 4          # pooling stride -> 2 bits per axis
LEVEL = 2           # octree level


def _zkey_sql(x: str, y: str, z: str) -> str:
    terms = []
    for i in range(cv.MAX_DEPTH):
        for c, off in ((x, 2), (y, 1), (z, 0)):
            terms.append(f"(((CAST({c} AS BIGINT) >> {i}) & 1) << {3 * i + off})")
    return "(" + " | ".join(terms) + ")"


def _deint_sql(key: str, axis: int) -> str:
    off = 2 - axis
    return "(" + " | ".join(f"(((({key}) >> {3 * i + off}) & 1) << {i})" for i in range(cv.MAX_DEPTH)) + ")"


def _bitlen_sql(m: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {m} >= {1 << i} THEN 1 ELSE 0 END" for i in range(40)) + ")"


def _vox_sql(grid: float) -> str:
    return f"""SELECT cloud AS batch, point_id, x, y, f1, f2,
       CAST(FLOOR((x - (SELECT MIN(x) FROM v_points)) / {grid!r}) AS INT) AS ix,
       CAST(FLOOR((y - (SELECT MIN(y) FROM v_points)) / {grid!r}) AS INT) AS iy, 0 AS iz FROM v_points"""


def _hilbert_ctes(src: str, x: str, y: str, z: str, tag: str) -> tuple[dict[str, str], str]:
    """Chained CTEs computing the Hilbert key of (x, y, z) at ``depth`` for
    every row of ``src`` (which carries ``depth``); returns (ctes, last)."""
    ctes: dict[str, str] = {}
    prev = f"{tag}0"
    ctes[prev] = (f"SELECT *, CAST({x} AS BIGINT) AS a0, CAST({y} AS BIGINT) AS a1, "
                  f"CAST({z} AS BIGINT) AS a2 FROM {src}")
    n = 0
    for level in range(cv.MAX_DEPTH - 1, -1, -1):
        q, p = 1 << level, (1 << level) - 1
        act = f"{level} < depth"
        for axis in range(3):
            ai = f"a{axis}"
            if axis == 0:
                body = f"CASE WHEN {act} AND (a0 & {q}) <> 0 THEN xor(a0, {p}) ELSE a0 END AS a0"
            else:
                t = f"(xor(a0, {ai}) & {p})"
                body = (f"CASE WHEN {act} THEN (CASE WHEN ({ai} & {q}) <> 0 THEN xor(a0, {p}) ELSE xor(a0, {t}) END) "
                        f"ELSE a0 END AS a0, "
                        f"CASE WHEN {act} AND ({ai} & {q}) = 0 THEN xor({ai}, {t}) ELSE {ai} END AS {ai}")
            n += 1
            cur = f"{tag}{n}"
            ctes[cur] = f"SELECT * REPLACE ({body}) FROM {prev}"
            prev = cur
    n += 1
    cur = f"{tag}{n}"
    ctes[cur] = f"SELECT *, {_zkey_sql('a0', 'a1', 'a2')} AS hk FROM {prev}"
    prev = cur
    for sh in (1, 2, 4, 8, 16, 32):
        n += 1
        cur = f"{tag}{n}"
        ctes[cur] = f"SELECT * REPLACE (xor(hk, hk >> {sh}) AS hk) FROM {prev}"
        prev = cur
    return ctes, prev


def _hilbert_coded(tag: str, trans: bool = False) -> tuple[dict[str, str], str]:
    """CTEs: voxels with depth and ``code`` = Hilbert key | (batch << 3 depth)."""
    x, y = ("iy", "ix") if trans else ("ix", "iy")
    src = f"{tag}src"
    ctes = {src: "SELECT vox.*, dep.depth FROM vox CROSS JOIN dep"}
    more, last = _hilbert_ctes(src, x, y, "iz", tag)
    ctes.update(more)
    out = f"{tag}out"
    ctes[out] = (f"SELECT batch, point_id, ix, iy, iz, depth, hk | (CAST(batch AS BIGINT) << (3 * depth)) AS code "
                 f"FROM {last}")
    return ctes, out


_CTE = {
    "vox": _vox_sql(GRID),
    "dep": f"""SELECT m AS max_coord, {_bitlen_sql('m')} AS depth, {_bitlen_sql('mb')} AS batch_bits FROM (
               SELECT CAST(GREATEST(MAX(ix), MAX(iy), MAX(iz)) AS BIGINT) AS m, CAST(MAX(batch) AS BIGINT) AS mb
               FROM vox) t""",
    "zc": f"""SELECT vox.*, dep.depth, {_zkey_sql('ix', 'iy', 'iz')} AS key,
              {_zkey_sql('ix', 'iy', 'iz')} | (CAST(batch AS BIGINT) << (3 * dep.depth)) AS code
              FROM vox CROSS JOIN dep""",
}


def _sql(body: str, **extra: str) -> str:
    return with_views(body, "v_points", extra={**_CTE, **extra})


def vox(spark: SparkSession, sf_dir: str, grid: float = GRID) -> DataFrame:
    return pl.voxelise(v_points(spark, sf_dir).withColumnRenamed("cloud", "batch"), grid)


def zcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with depth, the z key without batch bits (``key``) and with them (``code``)."""
    v = pl.with_depth(vox(spark, sf_dir))
    v = v.withColumn("key", cv.z_order("ix", "iy", "iz"))
    return v.withColumn("code", cv.with_batch("key", "batch", "depth"))


def _ints(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


# ------------------------------------------------------------ PC1 / PC2 / AGG16
@register("pc1_voxelise", _sql("""
SELECT batch, point_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, CAST(iz AS BIGINT) AS iz FROM vox"""),
          ops=("PC1",))
def vox_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ints(vox(spark, sf_dir).select("batch", "point_id", "ix", "iy", "iz"), "ix", "iy", "iz")


@register("pc2_curve_depth", _sql("SELECT max_coord, CAST(depth AS BIGINT) AS depth, "
                                  "CAST(batch_bits AS BIGINT) AS batch_bits FROM dep"), ops=("PC2",))
def depth_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.curve_depth(vox(spark, sf_dir))


@register("agg16_sparse_shape", _sql("""
SELECT CAST(MAX(ix) + 96 AS BIGINT) AS sx, CAST(MAX(iy) + 96 AS BIGINT) AS sy, CAST(MAX(iz) + 96 AS BIGINT) AS sz
FROM vox"""), ops=("AGG16",))
def shape_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.sparse_shape(vox(spark, sf_dir))


# ------------------------------------------------------------ PC3 / PC9
@register("pc3_zorder_cluster", _sql("SELECT batch, point_id, CAST(ix AS BIGINT) AS ix, "
                                     "CAST(iy AS BIGINT) AS iy, code FROM zc"), ops=("PC3", "PC9"))
def zorder_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pl.cluster_points(vox(spark, sf_dir), "z")
    return _ints(c.select("batch", "point_id", "ix", "iy", "code"), "ix", "iy")


@register("pc9_multi_cloud_key", _sql("""
SELECT batch, point_id, code, code >> (3 * depth) AS batch_back, code & ((CAST(1 AS BIGINT) << (3 * depth)) - 1) AS key
FROM zc"""), ops=("PC9",))
def multikey_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zcoded(spark, sf_dir)
    return z.select("batch", "point_id", "code", cv.batch_of("code", "depth").alias("batch_back"),
                    F.col("code").bitwiseXOR(cv.shift_left("batch", F.lit(3) * F.col("depth"))).alias("key"))


# ------------------------------------------------------------ PC4
@register("pc4_octree_rollup", _sql(f"""
SELECT batch, node, n, {fixed_sql('mean_f1')} AS mean_f1,
       {_deint_sql('node', 0)} AS cx, {_deint_sql('node', 1)} AS cy, {_deint_sql('node', 2)} AS cz FROM (
  SELECT batch, key >> {3 * LEVEL} AS node, CAST(COUNT(*) AS BIGINT) AS n, AVG(f1) AS mean_f1
  FROM zc GROUP BY 1, 2) t"""), ops=("PC4",))
def octree_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = pl.octree_rollup(zcoded(spark, sf_dir), LEVEL, ["f1"], key="key")
    return o.withColumn("mean_f1", fixed("mean_f1"))


# ------------------------------------------------------------ PC10 / AGG11 / JN11
_POOL = f"""SELECT code >> (3 * (CASE WHEN {STRIDE - 1:d} > 0 AND {pl.pool_shift(STRIDE)} > depth THEN 0
                                      ELSE {pl.pool_shift(STRIDE)} END)) AS pooled_code, *
            FROM zc"""


@register("pc10_serial_pool", _sql(f"""
SELECT pooled_code, MIN(batch) AS batch, CAST(COUNT(*) AS BIGINT) AS n, {fixed_sql('MAX(f1)')} AS f1,
       {fixed_sql('MAX(f2)')} AS f2, {fixed_sql('AVG(x)')} AS x, {fixed_sql('AVG(y)')} AS y,
       CAST(MIN(ix >> {pl.pool_shift(STRIDE)}) AS BIGINT) AS ix, CAST(MIN(iy >> {pl.pool_shift(STRIDE)}) AS BIGINT) AS iy,
       CAST(MIN(iz >> {pl.pool_shift(STRIDE)}) AS BIGINT) AS iz, CAST(MIN(depth) - {pl.pool_shift(STRIDE)} AS BIGINT) AS depth
FROM pool GROUP BY pooled_code""", pool=_POOL), ops=("PC10", "AGG11"))
def pool_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pl.serial_pool(zcoded(spark, sf_dir), STRIDE, ["f1", "f2"], "max")
    return p.select("pooled_code", "batch", "n", fixed("f1").alias("f1"), fixed("f2").alias("f2"),
                    fixed("x").alias("x"), fixed("y").alias("y"), *[F.col(c).cast("bigint").alias(c)
                                                                       for c in ("ix", "iy", "iz", "depth")])


@register("agg11_segment_reduce", _sql(f"""
SELECT 'sum' AS reduce, batch, node, {fixed_sql('SUM(f1)')} AS f1, {fixed_sql('AVG(x)')} AS x FROM s GROUP BY 2, 3
UNION ALL SELECT 'mean', batch, node, {fixed_sql('AVG(f1)')}, {fixed_sql('AVG(x)')} FROM s GROUP BY 2, 3
UNION ALL SELECT 'min', batch, node, {fixed_sql('MIN(f1)')}, {fixed_sql('AVG(x)')} FROM s GROUP BY 2, 3
UNION ALL SELECT 'max', batch, node, {fixed_sql('MAX(f1)')}, {fixed_sql('AVG(x)')} FROM s GROUP BY 2, 3""",
                                         s=f"SELECT batch, key >> {3 * LEVEL} AS node, f1, x FROM zc"),
          ops=("AGG11", "EX3"))
def reduce_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zcoded(spark, sf_dir).withColumn("node", F.shiftright("key", 3 * LEVEL))
    parts = [pl.segment_reduce(z, ["batch", "node"], ["f1"], r, ["x"]).select(
        F.lit(r).alias("reduce"), "batch", "node", fixed("f1").alias("f1"), fixed("x").alias("x"))
        for r in ("sum", "mean", "min", "max")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("jn11_unpool", _sql(f"""
SELECT p.batch, p.point_id, {fixed_sql('p.f1 + c.m')} AS f1
FROM pool p JOIN (SELECT pooled_code, AVG(f1) AS m FROM pool GROUP BY 1) c USING (pooled_code)""", pool=_POOL),
          ops=("JN11", "PC10"))
def unpool_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zcoded(spark, sf_dir)
    pooled = pl.serial_pool(z, STRIDE, ["f1"], "mean")
    p = pl.pool_shift(STRIDE)
    parent = z.withColumn("pooled_code", cv.shift_right("code", F.lit(3) * F.when(F.lit(p) > F.col("depth"), 0)
                                                        .otherwise(p)))
    u = pl.unpool(parent.select("batch", "point_id", "pooled_code", "f1"), pooled, "pooled_code", ["f1"])
    return u.select("batch", "point_id", fixed("f1").alias("f1"))


# ------------------------------------------------------------ AGG12 / AGG13
@register("agg12_unique_clusters", _sql(f"""
SELECT batch, code, count, CAST(DENSE_RANK() OVER (PARTITION BY batch ORDER BY code) - 1 AS BIGINT) AS cluster
FROM (SELECT batch, key >> {3 * LEVEL} AS code, CAST(COUNT(*) AS BIGINT) AS count FROM zc GROUP BY 1, 2) t"""),
          ops=("AGG12",))
def unique_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zcoded(spark, sf_dir).withColumn("code", F.shiftright("key", 3 * LEVEL))
    return pl.unique_clusters(z, "code", ["batch"]).select("batch", "code", "count", "cluster")


@register("agg13_batch_offsets", _sql("""
SELECT batch, n, CAST("end" - n AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM (
  SELECT batch, n, SUM(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "end"
  FROM (SELECT batch, CAST(COUNT(*) AS BIGINT) AS n FROM vox GROUP BY batch) c) t"""), ops=("AGG13",))
def offsets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.batch_counts(vox(spark, sf_dir)).select("batch", "n", "start", "end")


@register("agg13_batch_ids", _sql("""
SELECT batch, CAST(COUNT(*) AS BIGINT) AS n, CAST(MIN(idx) AS BIGINT) AS first_index, CAST(MAX(idx) AS BIGINT) AS last_index
FROM (SELECT batch, ROW_NUMBER() OVER (ORDER BY batch, point_id) - 1 AS idx FROM vox) t GROUP BY batch"""),
          ops=("AGG13",))
def ids_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pl.batch_ids(pl.batch_counts(vox(spark, sf_dir)))
    return ids.groupBy("batch").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                    F.min("index").alias("first_index"), F.max("index").alias("last_index"))


# ------------------------------------------------------------ WIN13 / WIN15 / JN12
_ORDER_SQL = "SELECT batch, point_id, ix, iy, iz, CAST(ROW_NUMBER() OVER (PARTITION BY batch ORDER BY code, point_id) - 1 AS BIGINT) AS pos FROM zc"


@register("win13_serial_order", _sql("SELECT batch, point_id, pos FROM o", o=_ORDER_SQL), ops=("WIN13",))
def order_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.serial_order(zcoded(spark, sf_dir), "code", ["batch"]).select("batch", "point_id", "pos")


def _patch_sql(k_max: int) -> dict[str, str]:
    return {
        "o": _ORDER_SQL,
        "nb": "SELECT batch, COUNT(*) AS n FROM o GROUP BY batch",
        "kk": f"SELECT CAST(LEAST(MIN(n), {k_max}) AS BIGINT) AS K FROM nb",
        "pt": """SELECT batch, pos, pos AS src_pos, FALSE AS is_pad FROM o UNION ALL
                 SELECT nb.batch, CAST(g.pos AS BIGINT), CAST(g.pos - kk.K AS BIGINT), TRUE
                 FROM nb CROSS JOIN kk, LATERAL (SELECT range AS pos FROM range(nb.n, CAST(CEIL(nb.n / kk.K) * kk.K AS BIGINT))) g
                 WHERE nb.n > kk.K""",
        "pk": "SELECT pt.*, kk.K, CAST(pt.pos // kk.K AS BIGINT) AS patch FROM pt CROSS JOIN kk",
    }


@register("win15_patches", _sql("SELECT batch, pos, src_pos, patch, is_pad, K FROM pk", **_patch_sql(16)),
          ops=("WIN15", "WIN13"))
def patches_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = pl.serial_order(zcoded(spark, sf_dir), "code", ["batch"])
    return pl.patches(o, 16).select("batch", "pos", "src_pos", "patch", "is_pad", "K")


@register("jn12_patch_rel_pos", _sql("""
SELECT a.batch, a.patch, a.pos AS pos_i, b.pos AS pos_j,
       CAST(GREATEST(LEAST(va.ix - vb.ix, 2), -2) + 2 AS BIGINT) AS rx,
       CAST(GREATEST(LEAST(va.iy - vb.iy, 2), -2) + 2 AS BIGINT) AS ry,
       CAST(GREATEST(LEAST(va.iz - vb.iz, 2), -2) + 2 AS BIGINT) AS rz
FROM pk a JOIN pk b ON a.batch = b.batch AND a.patch = b.patch
JOIN o va ON va.batch = a.batch AND va.pos = a.src_pos JOIN o vb ON vb.batch = b.batch AND vb.pos = b.src_pos""",
                                     **_patch_sql(4)), ops=("JN12", "WIN15"))
def relpos_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = pl.serial_order(zcoded(spark, sf_dir), "code", ["batch"])
    pt = pl.patches(o, 4)
    vox_at = o.select("batch", F.col("pos").alias("src_pos"), "ix", "iy", "iz")
    return pl.patch_rel_pos(pt.join(vox_at, ["batch", "src_pos"]), 2)


@register("jn12_patch_offset_counts", _sql("""
SELECT batch, patch, axis, CAST(GREATEST(LEAST(d, 3), -3) + 3 AS BIGINT) AS index, CAST(COUNT(*) AS BIGINT) AS pairs FROM (
  SELECT a.batch, a.patch, unnest(['ix', 'iy', 'iz']) AS axis, unnest([va.ix - vb.ix, va.iy - vb.iy, va.iz - vb.iz]) AS d
  FROM pk a JOIN pk b ON a.batch = b.batch AND a.patch = b.patch
  JOIN o va ON va.batch = a.batch AND va.pos = a.src_pos JOIN o vb ON vb.batch = b.batch AND vb.pos = b.src_pos) t
GROUP BY 1, 2, 3, 4""", **_patch_sql(64)), ops=("JN12", "WIN15"))
def relpos_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each patch of 64 points by clamped offset and axis, without the pairs."""
    o = pl.serial_order(zcoded(spark, sf_dir), "code", ["batch"])
    pt = pl.patches(o, 64)
    vox_at = o.select("batch", F.col("pos").alias("src_pos"), "ix", "iy", "iz")
    return pl.patch_offset_counts(pt.join(vox_at, ["batch", "src_pos"]), 3)


# ------------------------------------------------------------ JN10
_W = {(dx, dy, dz): 1.0 / (1 + abs(dx) + abs(dy) + abs(dz))
      for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)}
_W_SQL = ", ".join(f"({dx}, {dy}, {dz}, {w!r})" for (dx, dy, dz), w in _W.items())


@register("jn10_voxel_stencil", _sql(f"""
SELECT a.batch, CAST(a.ix AS BIGINT) AS ix, CAST(a.iy AS BIGINT) AS iy, CAST(a.iz AS BIGINT) AS iz,
       {fixed_sql('SUM(w.w * b.v)')} AS out
FROM occ a CROSS JOIN (VALUES {_W_SQL}) w(dx, dy, dz, w)
JOIN occ b ON b.batch = a.batch AND b.ix = a.ix + w.dx AND b.iy = a.iy + w.dy AND b.iz = a.iz + w.dz
GROUP BY 1, 2, 3, 4""", v2=_vox_sql(0.02), occ="SELECT batch, ix, iy, iz, SUM(f1) AS v FROM v2 GROUP BY 1, 2, 3, 4"),
          ops=("JN10",))
def stencil_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 3 x 3 submanifold stencil on occupied 0.02 voxels (value = sum f1)."""
    v = vox(spark, sf_dir, 0.02)
    occ = v.groupBy("batch", "ix", "iy", "iz").agg(F.sum("f1").alias("v"))
    s = pl.voxel_stencil(occ, "v", _W)
    return _ints(s, "ix", "iy", "iz").withColumn("out", fixed("out"))


# ------------------------------------------------------------ PC5 / PC6 / PC8 (Hilbert: unit-checked, no SQL)
_H, _HOUT = _hilbert_coded("h")


@register("pc5_hilbert_cluster", _sql(f"""
SELECT batch, point_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, code FROM {_HOUT}""", **_H),
          ops=("PC5",))
def hilbert_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pl.cluster_points(vox(spark, sf_dir), "hilbert")
    return _ints(c.select("batch", "point_id", "ix", "iy", "code"), "ix", "iy")


@register("pc6_curve_range", _sql(f"""
SELECT batch, point_id, code, CAST(ix AS BIGINT) AS cx, CAST(iy AS BIGINT) AS cy, CAST(iz AS BIGINT) AS cz,
       TRUE AS match
FROM {_HOUT} WHERE code >= (CAST(2 AS BIGINT) << (3 * depth)) AND code < (CAST(6 AS BIGINT) << (3 * depth))""", **_H),
          ops=("PC6", "PC5"))
def range_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of clouds 2..5 (code range [2 << 3d, 6 << 3d)) read from the
    clustered Hilbert table, cells decoded from the key; ``match`` checks the
    decode against the voxel."""
    c = pl.cluster_points(vox(spark, sf_dir), "hilbert")
    d = c.select("depth").limit(1).collect()[0][0]
    r = pl.curve_range(c, 2 << (3 * d), 6 << (3 * d), "hilbert")
    return r.select("batch", "point_id", "code", "cx", "cy", "cz",
                    ((F.col("cx") == F.col("ix")) & (F.col("cy") == F.col("iy")) & (F.col("cz") == F.col("iz")))
                    .alias("match"))


_T, _TOUT = _hilbert_coded("t", trans=True)
_SER = {**_H, **_T,
        "zt": f"""SELECT batch, point_id, {_zkey_sql('iy', 'ix', 'iz')} | (CAST(batch AS BIGINT) << (3 * depth)) AS code
                  FROM zc""",
        "ser": f"""SELECT z.batch, z.point_id, z.code AS code_z, zt.code AS code_z_trans, h.code AS code_hilbert,
                          t.code AS code_hilbert_trans
                   FROM zc z JOIN zt USING (batch, point_id) JOIN {_HOUT} h USING (batch, point_id)
                   JOIN {_TOUT} t USING (batch, point_id)"""}


@register("pc8_serialise", _sql("""
SELECT batch, point_id,
       code_z, CAST(ROW_NUMBER() OVER (ORDER BY code_z, point_id) - 1 AS BIGINT) AS pos_z,
       code_z_trans, CAST(ROW_NUMBER() OVER (ORDER BY code_z_trans, point_id) - 1 AS BIGINT) AS pos_z_trans,
       code_hilbert, CAST(ROW_NUMBER() OVER (ORDER BY code_hilbert, point_id) - 1 AS BIGINT) AS pos_hilbert,
       code_hilbert_trans,
       CAST(ROW_NUMBER() OVER (ORDER BY code_hilbert_trans, point_id) - 1 AS BIGINT) AS pos_hilbert_trans
FROM ser""", **_SER), ops=("PC8", "WIN13", "PC3", "PC5"))
def serialise_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pl.serialise(vox(spark, sf_dir))
    return s.select("batch", "point_id", "code_z", "pos_z", "code_z_trans", "pos_z_trans",
                    "code_hilbert", "pos_hilbert", "code_hilbert_trans", "pos_hilbert_trans")
