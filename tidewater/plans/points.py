"""Neighbour queries over ``v_points`` (label = cloud, embedding dims 1-2 =
position in [0, 1], dims 3-4 = features)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numeric import fixed, fixed_sql
from tidewater.operators import neighbours as nb
from tidewater.plans.registry import register
from tidewater.plans.sql_views import with_views
from tidewater.sources.views import v_points

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
PD2 = ("LEAST(ABS(a.x - b.x), 1 - ABS(a.x - b.x)) * LEAST(ABS(a.x - b.x), 1 - ABS(a.x - b.x)) + "
       "LEAST(ABS(a.y - b.y), 1 - ABS(a.y - b.y)) * LEAST(ABS(a.y - b.y), 1 - ABS(a.y - b.y))")


def _knn_sql(k: int, self_: bool = True, d2: str = D2) -> str:
    cond = "" if self_ else " AND a.point_id <> b.point_id"
    return f"""SELECT * FROM (
  SELECT a.cloud, a.point_id AS qid, b.point_id AS nid, {d2} AS d2,
         CAST(ROW_NUMBER() OVER (PARTITION BY a.cloud, a.point_id ORDER BY {d2}, b.point_id) AS BIGINT) AS rank
  FROM v_points a JOIN v_points b ON a.cloud = b.cloud{cond}) t WHERE rank <= {k}"""


def _ball_sql(r: float, ns: int) -> str:
    return f"""
  SELECT cloud, qid, rn - 1 AS slot, nid FROM (
    SELECT a.cloud, a.point_id AS qid, b.point_id AS nid,
           CAST(ROW_NUMBER() OVER (PARTITION BY a.cloud, a.point_id ORDER BY b.point_id) AS BIGINT) AS rn
    FROM v_points a JOIN v_points b ON a.cloud = b.cloud AND {D2} <= {r * r!r}) h WHERE rn <= {ns}
  UNION ALL
  SELECT c.cloud, c.qid, s.slot, c.f FROM (
    SELECT a.cloud, a.point_id AS qid, LEAST(COUNT(*), {ns}) AS c, MIN(b.point_id) AS f
    FROM v_points a JOIN v_points b ON a.cloud = b.cloud AND {D2} <= {r * r!r} GROUP BY 1, 2) c
  JOIN (SELECT CAST(range AS BIGINT) AS slot FROM range(0, {ns})) s ON s.slot >= c.c"""


def _sql(body: str, **extra: str) -> str:
    return with_views(body, "v_points", extra=extra or None)


def _pts(spark, sf_dir):
    return v_points(spark, sf_dir)


# ------------------------------------------------------------ JN5 / JN4
@register("jn5_knn", _sql(f"SELECT cloud, qid, nid, rank, {fixed_sql('d2')} AS d2 FROM k",
                          k=_knn_sql(4)), ops=("JN5", "JN4"))
def knn_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 nearest points of every point, self included, ties by id."""
    p = _pts(spark, sf_dir)
    return nb.knn(p, p, 4).withColumn("d2", fixed("d2"))


@register("jn4_radius_pairs", _sql(f"""
SELECT a.cloud, a.point_id AS qid, b.point_id AS nid, {fixed_sql(D2)} AS d2
FROM v_points a JOIN v_points b ON a.cloud = b.cloud AND {D2} <= 0.0025"""), ops=("JN4",))
def pairs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pts(spark, sf_dir)
    return nb.radius_pairs(p, p, 0.05).withColumn("d2", fixed("d2"))


# ------------------------------------------------------------ JN6 / JN7
@register("jn6_ball_query", _sql(f"SELECT * FROM ({_ball_sql(0.05, 8)}) t"), ops=("JN6",))
def ball_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pts(spark, sf_dir)
    return nb.ball_query(p, p, 0.05, 8)


@register("jn7_multi_scale_group", _sql(f"""
SELECT CAST(0 AS BIGINT) AS scale, * FROM ({_ball_sql(0.03, 4)}) t0
UNION ALL SELECT CAST(1 AS BIGINT) AS scale, * FROM ({_ball_sql(0.06, 8)}) t1"""), ops=("JN7",))
def multi_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pts(spark, sf_dir)
    return nb.multi_scale_group(p, p, [(0.03, 4), (0.06, 8)])


@register("jn7_multi_scale_knn", _sql(f"""
SELECT CAST(0 AS BIGINT) AS scale, cloud, qid, nid, rank, {fixed_sql('d2')} AS d2 FROM k WHERE rank <= 4
UNION ALL SELECT CAST(1 AS BIGINT) AS scale, cloud, qid, nid, rank, {fixed_sql('d2')} AS d2 FROM k""", k=_knn_sql(8)),
          ops=("JN7", "JN5"))
def multi_knn_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 and 8 nearest points of every point."""
    p = _pts(spark, sf_dir)
    return nb.multi_scale_knn(p, p, [4, 8]).withColumn("d2", fixed("d2"))


# ------------------------------------------------------------ JN3
@register("jn3_gather", _sql(f"""
SELECT k.cloud, k.qid, k.rank, k.nid, {fixed_sql('p.f1')} AS f1, {fixed_sql('p.f2')} AS f2
FROM k JOIN v_points p ON p.cloud = k.cloud AND p.point_id = k.nid""", k=_knn_sql(4)), ops=("JN3",))
def gather_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pts(spark, sf_dir)
    g = nb.gather(nb.knn(p, p, 4), p, ["f1", "f2"])
    return g.select("cloud", "qid", "rank", "nid", fixed("f1").alias("f1"), fixed("f2").alias("f2"))


# ------------------------------------------------------------ JN8 / JN9
@register("jn8_edge_list", _sql("SELECT cloud, nid AS src, qid AS dst FROM k", k=_knn_sql(16, False)),
          ops=("JN8",))
def edges_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.edge_list(_pts(spark, sf_dir), 16)


@register("jn9_periodic_knn", _sql(f"SELECT cloud, qid, nid, rank, {fixed_sql('d2')} AS d2 FROM k",
                                   k=_knn_sql(4, False, PD2)), ops=("JN9",))
def periodic_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pts(spark, sf_dir)
    return nb.knn(p, p, 4, include_self=False, periodic=True).withColumn("d2", fixed("d2"))


# ------------------------------------------------------------ WIN16
@register("win16_group_softmax", _sql(f"""
SELECT cloud, qid, {fixed_sql('SUM(e * f2) / SUM(e)')} AS att FROM (
  SELECT k.cloud, k.qid, p.f2, EXP(p.f1 * 0.5 - MAX(p.f1 * 0.5) OVER (PARTITION BY k.cloud, k.qid)) AS e
  FROM k JOIN v_points p ON p.cloud = k.cloud AND p.point_id = k.nid) t GROUP BY cloud, qid""",
                                      k=_knn_sql(8)), ops=("WIN16",))
def softmax_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax(f1 / 2) attention over the 8 nearest points, weighted mean of f2."""
    p = _pts(spark, sf_dir)
    g = nb.gather(nb.knn(p, p, 8), p, ["f1", "f2"])
    s = nb.group_softmax(g, ["cloud", "qid"], "f1", 0.5)
    return s.groupBy("cloud", "qid").agg(fixed(F.sum(F.col("weight") * F.col("f2"))).alias("att"))


# ------------------------------------------------------------ WIN19
@register("win19_normalise_cloud", _sql(f"""
SELECT cloud, point_id, {fixed_sql('x / m')} AS x, {fixed_sql('y / m')} AS y FROM (
  SELECT cloud, point_id, x, y, MAX(SQRT(x * x + y * y)) OVER (PARTITION BY cloud) AS m FROM (
    SELECT cloud, point_id, x - AVG(x) OVER (PARTITION BY cloud) AS x, y - AVG(y) OVER (PARTITION BY cloud) AS y
    FROM v_points) c) n"""), ops=("WIN19",))
def normalise_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nb.normalise_cloud(_pts(spark, sf_dir))
    return n.select("cloud", "point_id", fixed("x").alias("x"), fixed("y").alias("y"))


# ------------------------------------------------------------ PC11
COARSE = 0.05
_COARSE_SQL = f"""
SELECT cloud, CAST(FLOOR(x / {COARSE}) AS BIGINT) * 1000 + CAST(FLOOR(y / {COARSE}) AS BIGINT) AS point_id,
       AVG(x) AS x, AVG(y) AS y, AVG(f1) AS f1 FROM v_points GROUP BY 1, 2"""


def coarse_sources(points: DataFrame) -> DataFrame:
    """Centroid and mean feature per 0.05 cell: the coarse level of a pooling."""
    key = F.floor(F.col("x") / COARSE).cast("bigint") * 1000 + F.floor(F.col("y") / COARSE).cast("bigint")
    return points.groupBy("cloud", key.alias("point_id")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("f1").alias("f1"))


@register("pc11_idw3", _sql(f"""
SELECT cloud, point_id, {fixed_sql('SUM(w * f1) / SUM(w)')} AS f1 FROM (
  SELECT a.cloud, a.point_id, b.f1, 1.0 / ({D2} + 1e-8) AS w,
         ROW_NUMBER() OVER (PARTITION BY a.cloud, a.point_id ORDER BY {D2}, b.point_id) AS rn
  FROM v_points a JOIN s b ON a.cloud = b.cloud) t WHERE rn <= 3 GROUP BY cloud, point_id""",
                            s=_COARSE_SQL), ops=("PC11",))
def idw_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse (0.05 cell) mean of f1 interpolated back to every point."""
    p = _pts(spark, sf_dir)
    out = nb.idw3(p, coarse_sources(p), ["f1"])
    return out.select("cloud", "point_id", fixed("f1").alias("f1"))


@register("pc11_idw3_concat", _sql(f"""
SELECT t.cloud, t.point_id, {fixed_sql('p.f2')} AS own_f2, {fixed_sql('t.f1')} AS f1 FROM (
  SELECT cloud, point_id, SUM(w * f1) / SUM(w) AS f1 FROM (
    SELECT a.cloud, a.point_id, b.f1, 1.0 / ({D2} + 1e-8) AS w,
           ROW_NUMBER() OVER (PARTITION BY a.cloud, a.point_id ORDER BY {D2}, b.point_id) AS rn
    FROM v_points a JOIN s b ON a.cloud = b.cloud) q WHERE rn <= 3 GROUP BY cloud, point_id) t
JOIN v_points p ON p.cloud = t.cloud AND p.point_id = t.point_id""", s=_COARSE_SQL), ops=("PC11",))
def idw_concat_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target's own f2 beside the interpolated f1."""
    p = _pts(spark, sf_dir)
    out = nb.idw3(p, coarse_sources(p), ["f1"], own=["f2"])
    return out.select("cloud", "point_id", fixed("own_f2").alias("own_f2"), fixed("f1").alias("f1"))


# ------------------------------------------------------------ AGG14 / AGG15
@register("agg14_set_abstraction", _sql(f"""
SELECT b.cloud, b.qid AS centre, {fixed_sql('MAX(p.f1)')} AS max_f1, {fixed_sql('MAX(p.f2)')} AS max_f2
FROM ({_ball_sql(0.05, 8)}) b JOIN v_points p ON p.cloud = b.cloud AND p.point_id = b.nid
GROUP BY b.cloud, b.qid"""), ops=("AGG14", "JN6", "JN3"))
def sa_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pts(spark, sf_dir)
    groups = nb.gather(nb.ball_query(p, p, 0.05, 8), p, ["f1", "f2"]).withColumnRenamed("qid", "centre")
    sa = nb.set_abstraction(groups, ["f1", "f2"])
    return sa.select("cloud", "centre", fixed("max_f1").alias("max_f1"), fixed("max_f2").alias("max_f2"))


@register("agg15_group_all", _sql(f"""
SELECT cloud, CAST(0.0 AS DOUBLE) AS centre_x, CAST(0.0 AS DOUBLE) AS centre_y, CAST(COUNT(*) AS BIGINT) AS n, {fixed_sql('MAX(x)')} AS max_x,
       {fixed_sql('MAX(y)')} AS max_y, {fixed_sql('MAX(f1)')} AS max_f1, {fixed_sql('MAX(f2)')} AS max_f2
FROM v_points GROUP BY cloud"""), ops=("AGG15",))
def group_all_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nb.group_all(_pts(spark, sf_dir), ["f1", "f2"])
    return g.select("cloud", "centre_x", "centre_y", "n",
                    *[fixed(c).alias(c) for c in ("max_x", "max_y", "max_f1", "max_f2")])


# ------------------------------------------------------------ WIN17 / WIN18
def _fps_sql(picks: int) -> str:
    """Farthest-point picks as a recursive CTE: each step appends, per cloud,
    the point with the largest minimum squared distance to the picks so far
    (ties: lowest id), starting at the lowest id."""
    from tidewater.plans.sql_views import V_POINTS
    return f"""WITH RECURSIVE v_points AS ({V_POINTS}),
fps(cloud, pick, pid, ids) AS (
  SELECT cloud, 0, MIN(point_id), [MIN(point_id)] FROM v_points GROUP BY cloud
  UNION ALL
  SELECT f.cloud, f.pick + 1, nxt.pid, list_append(f.ids, nxt.pid)
  FROM fps f, LATERAL (
    SELECT q.point_id AS pid FROM v_points q WHERE q.cloud = f.cloud
    ORDER BY (SELECT MIN((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) FROM v_points r
              WHERE r.cloud = f.cloud AND list_contains(f.ids, r.point_id)) DESC, q.point_id
    LIMIT 1) nxt
  WHERE f.pick < {picks - 1})"""


@register("win17_farthest_points", _fps_sql(8) + f"""
SELECT f.cloud, CAST(f.pick AS BIGINT) AS pick, f.pid AS point_id, {fixed_sql('p.x')} AS x, {fixed_sql('p.y')} AS y
FROM fps f JOIN v_points p ON p.cloud = f.cloud AND p.point_id = f.pid""", ops=("WIN17",))
def fps_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 farthest-point picks per cloud from the lowest id."""
    f = nb.farthest_points(_pts(spark, sf_dir), 8)
    return f.select("cloud", "pick", "point_id", fixed("x").alias("x"), fixed("y").alias("y"))


@register("win18_sample_and_group", _fps_sql(4) + f""",
c AS (SELECT f.cloud, f.pid AS centre, p.x AS cx, p.y AS cy FROM fps f
      JOIN v_points p ON p.cloud = f.cloud AND p.point_id = f.pid),
m AS (SELECT c.cloud, c.centre, c.cx, c.cy, q.point_id AS nid, q.x, q.y, q.f1, q.f2,
             CAST(ROW_NUMBER() OVER (PARTITION BY c.cloud, c.centre
                  ORDER BY (c.cx - q.x) * (c.cx - q.x) + (c.cy - q.y) * (c.cy - q.y), q.point_id) AS BIGINT) AS rank
      FROM c JOIN v_points q ON q.cloud = c.cloud)
SELECT cloud, centre, rank, nid, {fixed_sql('x - cx')} AS rel_x, {fixed_sql('y - cy')} AS rel_y,
       {fixed_sql('f1')} AS f1, {fixed_sql('f2')} AS f2
FROM m WHERE rank <= 8""", ops=("WIN18", "WIN17", "JN5", "JN3"))
def sag_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 FPS centres per cloud, 8 nearest members each, relative positions."""
    g = nb.sample_and_group(_pts(spark, sf_dir), 4, 8, ["f1", "f2"])
    return g.select("cloud", "centre", "rank", "nid", fixed("rel_x").alias("rel_x"),
                    fixed("rel_y").alias("rel_y"), fixed("f1").alias("f1"), fixed("f2").alias("f2"))


@register("win18_sample_and_group_radius", _fps_sql(4) + f""",
c AS (SELECT f.cloud, f.pid AS centre, p.x AS cx, p.y AS cy FROM fps f
      JOIN v_points p ON p.cloud = f.cloud AND p.point_id = f.pid),
m AS (SELECT c.cloud, c.centre, q.point_id AS nid,
             ROW_NUMBER() OVER (PARTITION BY c.cloud, c.centre ORDER BY q.point_id) AS rn,
             COUNT(*) OVER (PARTITION BY c.cloud, c.centre) AS hits,
             MIN(q.point_id) OVER (PARTITION BY c.cloud, c.centre) AS f
      FROM c JOIN v_points q ON q.cloud = c.cloud
       AND (c.cx - q.x) * (c.cx - q.x) + (c.cy - q.y) * (c.cy - q.y) <= {0.1 * 0.1!r}),
g AS (SELECT cloud, centre, rn AS rank, nid FROM m WHERE rn <= 8
      UNION ALL SELECT cloud, centre, s.rank, f FROM (SELECT DISTINCT cloud, centre, f, LEAST(hits, 8) AS hits FROM m) d
      JOIN (SELECT range AS rank FROM range(1, 9)) s ON s.rank > d.hits)
SELECT g.cloud, g.centre, CAST(g.rank AS BIGINT) AS rank, g.nid, {fixed_sql('q.x - c.cx')} AS rel_x,
       {fixed_sql('q.y - c.cy')} AS rel_y, {fixed_sql('q.f1')} AS f1, {fixed_sql('q.f2')} AS f2
FROM g JOIN c ON c.cloud = g.cloud AND c.centre = g.centre
JOIN v_points q ON q.cloud = g.cloud AND q.point_id = g.nid""", ops=("WIN18", "WIN17", "JN6", "JN3"))
def sag_radius_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 FPS centres per cloud, up to 8 members within 0.1 each (padded)."""
    g = nb.sample_and_group(_pts(spark, sf_dir), 4, 8, ["f1", "f2"], radius=0.1)
    return g.select("cloud", "centre", "rank", "nid", fixed("rel_x").alias("rel_x"),
                    fixed("rel_y").alias("rel_y"), fixed("f1").alias("f1"), fixed("f2").alias("f2"))
