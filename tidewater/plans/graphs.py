"""Message-passing queries on the 8-nearest-neighbour graph of ``v_points``
(edges from :func:`tidewater.operators.neighbours.edge_list`: src =
neighbour, dst = point)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numeric import fixed, fixed_sql
from tidewater.operators import graph as gr
from tidewater.operators import neighbours as nb
from tidewater.plans.points import _knn_sql
from tidewater.plans.registry import register
from tidewater.plans.sql_views import with_views
from tidewater.sources.views import v_points

K = 8
_E = {"e": f"SELECT cloud, nid AS src, qid AS dst FROM ({_knn_sql(K, False)}) k"}
_J = """JOIN v_points i ON i.cloud = e.cloud AND i.point_id = e.{a}
        JOIN v_points j ON j.cloud = e.cloud AND j.point_id = e.{b}"""


def _sql(body: str, **extra: str) -> str:
    return with_views(body, "v_points", extra={**_E, **extra})


def _graph(spark: SparkSession, sf_dir: str):
    p = v_points(spark, sf_dir)
    return p, nb.edge_list(p, K)


# ------------------------------------------------------------ GR1
@register("gr1_propagate_mean", _sql(f"""
SELECT p.cloud, p.point_id, {fixed_sql('p.f1 + 0.5 * COALESCE(a.du, 0) + COALESCE(a.dx, 0)')} AS f1
FROM v_points p LEFT JOIN (
  SELECT e.cloud, e.src AS point_id, AVG(j.f1 - i.f1) AS du, AVG(i.x - j.x) AS dx
  FROM e {_J.format(a='src', b='dst')} GROUP BY 1, 2) a USING (cloud, point_id)"""), ops=("GR1",))
def gr1_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of (u_j - u_i, x_i - x_j) gathered at the source node."""
    p, e = _graph(spark, sf_dir)
    out = gr.propagate(p, e, lambda i, j: {"du": j("f1") - i("f1"), "dx": i("x") - j("x")}, "mean",
                       lambda n, a: {"f1": n("f1") + 0.5 * F.coalesce(a("du"), F.lit(0.0))
                                     + F.coalesce(a("dx"), F.lit(0.0))}, at="src")
    return out.select("cloud", "point_id", fixed("f1").alias("f1"))


# ------------------------------------------------------------ GR2
@register("gr2_propagate_max", _sql(f"""
SELECT p.cloud, p.point_id, {fixed_sql('p.f1 + COALESCE(a.m2, 0)')} AS f1, {fixed_sql('a.m1')} AS shift
FROM v_points p LEFT JOIN (
  SELECT e.cloud, e.dst AS point_id, MAX(j.x - i.x + 0.1 * i.f2) AS m1, MAX(j.f1) AS m2
  FROM e {_J.format(a='dst', b='src')} GROUP BY 1, 2) a USING (cloud, point_id)"""), ops=("GR2",))
def gr2_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Max of (x_j - x_i + delta_i, f1_j) at the target, residual update."""
    p, e = _graph(spark, sf_dir)
    out = gr.propagate(p, e, lambda i, j: {"m1": j("x") - i("x") + 0.1 * i("f2"), "m2": j("f1")}, "max",
                       lambda n, a: {"f1": n("f1") + F.coalesce(a("m2"), F.lit(0.0)), "shift": a("m1")})
    return out.select("cloud", "point_id", fixed("f1").alias("f1"), fixed("shift").alias("shift"))


# ------------------------------------------------------------ GR3
@register("gr3_pointnet_pool", _sql(f"""
SELECT e.cloud, e.dst AS point_id, {fixed_sql('MAX(j.f1)')} AS pool_f1, {fixed_sql('MAX(j.x - i.x)')} AS pool_dx,
       {fixed_sql('MAX(j.y - i.y)')} AS pool_dy
FROM e {_J.format(a='dst', b='src')} GROUP BY 1, 2"""), ops=("GR3",))
def gr3_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local max-pool of neighbour features with relative positions."""
    p, e = _graph(spark, sf_dir)
    out = gr.propagate(p, e, lambda i, j: {"f1": j("f1"), "dx": j("x") - i("x"), "dy": j("y") - i("y")}, "max",
                       lambda n, a: {"pool_f1": a("f1"), "pool_dx": a("dx"), "pool_dy": a("dy")})
    return out.select("cloud", "point_id", *[fixed(c).alias(c) for c in ("pool_f1", "pool_dx", "pool_dy")])


# ------------------------------------------------------------ GR4
@register("gr4_gcn_smooth", _sql(f"""
SELECT p.cloud, p.point_id, {fixed_sql('s.smooth')} AS smooth FROM v_points p LEFT JOIN (
  SELECT el.cloud, el.dst AS point_id, SUM(v.f1 / SQRT(di.d * dj.d)) AS smooth
  FROM el JOIN deg di ON di.cloud = el.cloud AND di.dst = el.dst
          JOIN deg dj ON dj.cloud = el.cloud AND dj.dst = el.src
          JOIN v_points v ON v.cloud = el.cloud AND v.point_id = el.src GROUP BY 1, 2) s USING (cloud, point_id)""",
                                 el="SELECT cloud, src, dst FROM e UNION ALL SELECT cloud, point_id, point_id FROM v_points",
                                 deg="SELECT cloud, dst, COUNT(*) AS d FROM el GROUP BY 1, 2"), ops=("GR4",))
def gr4_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = _graph(spark, sf_dir)
    return gr.gcn_smooth(p, e, "f1").select("cloud", "point_id", fixed("smooth").alias("smooth"))


# ------------------------------------------------------------ GR5
@register("gr5_attend", _sql(f"""
SELECT p.cloud, p.point_id, {fixed_sql('a.att')} AS att FROM v_points p LEFT JOIN (
  SELECT cloud, point_id, SUM(ex * v) / SUM(ex) AS att FROM (
    SELECT e.cloud, e.dst AS point_id, j.f2 AS v,
           EXP(2.0 * i.f1 * j.f1 - MAX(2.0 * i.f1 * j.f1) OVER (PARTITION BY e.cloud, e.dst)) AS ex
    FROM e {_J.format(a='dst', b='src')}) t GROUP BY 1, 2) a USING (cloud, point_id)"""), ops=("GR5", "WIN16"))
def gr5_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax(2 f1_i f1_j) over incoming edges, weighted mean of f2_j."""
    p, e = _graph(spark, sf_dir)
    out = gr.attend(p, e, lambda i, j: {"score": i("f1") * j("f1")}, "f2", scale=2.0)
    return out.select("cloud", "point_id", fixed("att").alias("att"))


# ------------------------------------------------------------ GR6
@register("gr6_hstack_pos", _sql(f"""
SELECT cloud, point_id, CAST(0 AS BIGINT) AS pos, {fixed_sql('f1')} AS v FROM v_points UNION ALL
SELECT cloud, point_id, 1, {fixed_sql('f2')} FROM v_points UNION ALL
SELECT cloud, point_id, 2, {fixed_sql('x')} FROM v_points UNION ALL
SELECT cloud, point_id, 3, {fixed_sql('y')} FROM v_points"""), ops=("GR6",))
def gr6_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v_points(spark, sf_dir).withColumn("feat", gr.hstack_pos(F.array("f1", "f2")))
    x = p.select("cloud", "point_id", F.posexplode("feat").alias("pos", "v"))
    return x.select("cloud", "point_id", F.col("pos").cast("bigint").alias("pos"), fixed("v").alias("v"))


# ------------------------------------------------------------ SET7
_BATCH_SQL = {
    "loc": "SELECT cloud, point_id, CAST(ROW_NUMBER() OVER (PARTITION BY cloud ORDER BY point_id) - 1 AS BIGINT) AS local_id FROM v_points",
    "off": """SELECT cloud, CAST(SUM(n) OVER (ORDER BY cloud ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS off
              FROM (SELECT cloud, COUNT(*) AS n FROM v_points GROUP BY cloud) c""",
    "gn": "SELECT loc.cloud, loc.point_id, loc.local_id, CAST(off.off + loc.local_id AS BIGINT) AS global_id FROM loc JOIN off USING (cloud)",
}


@register("set7_batch_graphs", _sql("SELECT cloud, point_id, local_id, global_id FROM gn", **_BATCH_SQL),
          ops=("SET7", "AGG13"))
def batch_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = _graph(spark, sf_dir)
    n, _ = gr.batch_graphs(p, e)
    return n.select("cloud", "point_id", "local_id", "global_id")


@register("set7_split_graphs", _sql("""
SELECT e.cloud, e.src, e.dst, s.global_id AS src_global, d.global_id AS dst_global,
       s.local_id AS src_local, d.local_id AS dst_local
FROM e JOIN gn s ON s.cloud = e.cloud AND s.point_id = e.src JOIN gn d ON d.cloud = e.cloud AND d.point_id = e.dst""",
                                    **_BATCH_SQL), ops=("SET7",))
def split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = _graph(spark, sf_dir)
    n, ge = gr.batch_graphs(p, e)
    back = gr.split_graphs(ge.select("cloud", "src", "dst", "src_global", "dst_global"), n)
    return back.select("cloud", "src", "dst", "src_global", "dst_global", "src_local", "dst_local")


# ------------------------------------------------------------ SET8
@register("set8_normalised_adjacency", _sql(f"""
SELECT u.cloud, u.src, u.dst, {fixed_sql('1.0 / d.n')} AS w FROM u
JOIN (SELECT cloud, src, COUNT(*) AS n FROM u GROUP BY 1, 2) d USING (cloud, src)""",
                                            u="SELECT cloud, src, dst FROM e UNION SELECT cloud, dst, src FROM e"),
          ops=("SET8",))
def adj_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _graph(spark, sf_dir)
    return gr.normalised_adjacency(e).withColumn("w", fixed("w"))


# ------------------------------------------------------------ FC4
def _round_sql(prev: str) -> str:
    return f"""SELECT p.cloud, p.point_id, p.x, p.y, p.f1 + 0.5 * COALESCE(a.du, 0) AS f1 FROM {prev} p LEFT JOIN (
      SELECT e.cloud, e.dst AS point_id, AVG(j.f1 - i.f1) AS du FROM e
      JOIN {prev} i ON i.cloud = e.cloud AND i.point_id = e.dst
      JOIN {prev} j ON j.cloud = e.cloud AND j.point_id = e.src GROUP BY 1, 2) a USING (cloud, point_id)"""


@register("fc4_graph_rollout", _sql(f"SELECT cloud, point_id, {fixed_sql('f1')} AS f1 FROM r3",
                                    r0="SELECT cloud, point_id, x, y, f1 FROM v_points",
                                    r1=_round_sql("r0"), r2=_round_sql("r1"), r3=_round_sql("r2")), ops=("FC4", "GR1"))
def rollout_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three diffusion rounds u <- u + 0.5 mean_j(u_j - u_i) on fixed edges."""
    p, e = _graph(spark, sf_dir)
    nodes = p.select("cloud", "point_id", "x", "y", "f1")
    out = gr.graph_rollout(nodes, e, lambda i, j: {"du": j("f1") - i("f1")}, "mean",
                           lambda n, a: {"f1": n("f1") + 0.5 * F.coalesce(a("du"), F.lit(0.0))}, 3)
    return out.select("cloud", "point_id", fixed("f1").alias("f1"))
