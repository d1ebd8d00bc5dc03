"""Skewed inputs: results stay equal to a plain computation and no task, key or
query gets more than its share."""

from __future__ import annotations

import contextlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import common as cm
from tidewater.operators import graph as gr
from tidewater.operators import neighbours as nb


@contextlib.contextmanager
def conf(spark, **kv):
    """Settings for a while (dots written as two underscores)."""
    new = {k.replace("__", "."): str(v) for k, v in kv.items()}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def no_broadcast(spark):
    return conf(spark, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions=64)


def per_task(df):
    return [r["n_rows"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n_rows")).collect()]


# ------------------------------------------------------------ heavy-hitter joins
@pytest.mark.parametrize("how_counted", ["sketch", "weight", "counted"])
def test_only_heavy_keys_are_salted(spark, how_counted):
    """Half of the rows on one key, the others on keys of their own: the small
    side grows by the copies of one key, and the hot key is still dealt."""
    n = 40_000
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    extra = {"sketch": {}, "weight": {"weight": "n"}, "counted": {"counted": df.select("k")}}[how_counted]
    with no_broadcast(spark):
        j = cm.salted_join(df, stats, ["k"], ["id"], **extra)
        tasks = per_task(j)
        assert j.filter("k = 0").select("n").distinct().collect()[0][0] == n // 2 and sum(tasks) == n
        assert max(tasks) < 0.12 * n
        heavy = cm.heavy_keys(stats if how_counted == "weight" else df, ["k"], extra.get("weight"))
        found = spark.range(1).select(heavy.alias("h")).first()["h"]
        assert found == [spark.range(1).select(F.xxhash64(F.lit(0).cast("bigint"))).first()[0]]
        small = j._jdf.queryExecution().optimizedPlan().toString()
        assert small.count("Generate explode") == 1


def test_no_heavy_key_no_copy_and_null_keys(spark):
    df = spark.range(5_000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 900).alias("k"))
    stats = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    light = df.filter("k IS NOT NULL")
    assert spark.range(1).select(cm.heavy_keys(light, ["k"]).alias("h")).first()["h"] == []
    got = cm.salted_join(df, stats, ["k"], ["id"], null_safe=True)
    assert got.count() == 5_000 and got.filter("k IS NULL").select("s").distinct().collect()[0][0] == sum(range(0, 5000, 7))
    left = cm.salted_join(df, stats.filter("k > 10"), ["k"], ["id"], how="left")
    assert left.count() == 5_000 and left.filter("n IS NULL").count() == df.filter("k IS NULL OR k <= 10").count()
    none = cm.salted_join(df.limit(0), stats.limit(0), ["k"], ["id"], weight="n")
    assert none.count() == 0 and cm.salted_join(df.limit(0), stats, ["k"], ["id"]).count() == 0


# ------------------------------------------------------------ hubs
@pytest.fixture(scope="module")
def star(spark):
    """A hub that 20,000 of 20,400 edges lead to."""
    nodes = spark.range(20_001).select(F.lit(1).alias("cloud"), F.col("id").alias("point_id"), (F.col("id") % 13 / 3).alias("f"),
                                       (F.col("id") % 7 * 1.0).alias("v"))
    hub = spark.range(1, 20_001).select(F.lit(1).alias("cloud"), F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst"))
    rest = spark.range(1, 401).select(F.lit(1).alias("cloud"), F.col("id").alias("src"), (F.col("id") % 40 + 1).alias("dst"))
    return nodes, hub.union(rest)


def plain_attention(nodes, edges, scale):
    f = {r["point_id"]: (r["f"], r["v"]) for r in nodes.collect()}
    into = {}
    for e in edges.collect():
        into.setdefault(e["dst"], []).append(e["src"])
    out = {}
    for node, senders in into.items():
        s = [scale * (f[node][0] + 1) * f[j][0] for j in senders]
        w = [math.exp(x - max(s)) for x in s]
        out[node] = sum(a * f[j][1] for a, j in zip(w, senders, strict=True)) / sum(w)
    return out


@pytest.mark.parametrize("scale", [1.0, -300.0, 4000.0])
def test_attention_into_a_hub(spark, star, scale):
    """Equal to a softmax by node, also where exp would overflow; edges are
    summed before they are dealt by node."""
    nodes, edges = star
    got = gr.attend(nodes, edges, lambda i, j: {"score": (i("f") + 1) * j("f")}, "v", scale=scale)
    want = plain_attention(nodes, edges, scale)
    for r in got.filter("att IS NOT NULL").collect():
        assert r["att"] == pytest.approx(want[r["point_id"]], rel=1e-12)
    assert got.count() == 20_001 and got.filter("att IS NOT NULL").count() == len(want)


def test_messages_into_a_hub_are_dealt(spark, star):
    nodes, edges = star
    with no_broadcast(spark):
        ends = gr._ends(nodes, edges, ["cloud"], "point_id", "dst")
        tasks = per_task(ends)
        assert sum(tasks) == 20_400 and max(tasks) < 0.15 * 20_400
    out = gr.propagate(nodes, edges, lambda i, j: {"m": j("v")}, "sum", lambda n, a: {"v": F.coalesce(a("m"), F.lit(0.0))})
    assert out.filter("point_id = 0").first()["v"] == sum(i % 7 for i in range(1, 20_001))


def test_sparse_scores_and_missing_ones(spark):
    nodes = spark.createDataFrame([(1, i, float(i), float(i)) for i in range(4)], "cloud int, point_id long, f double, v double")
    edges = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 2)], "cloud int, src long, dst long")
    got = {r["point_id"]: r["att"] for r in gr.attend(nodes, edges, lambda i, j: {
        "score": F.when(j("f") < 3, j("f") * 1000)}, "v").collect()}
    assert got[0] == pytest.approx(2.0) and got[1] is None and got[2] is None and got[3] is None
    assert np.isfinite(got[0])


# ------------------------------------------------------------ nearest neighbours
POINTS = "cloud int, point_id long, x double, y double"


def cloud_of(spark, xy, cloud=0, first=0):
    return spark.createDataFrame([(cloud, first + i, float(x), float(y)) for i, (x, y) in enumerate(xy)], POINTS)


def brute_knn(q, p, k, include_self=True, periodic=False):
    """(qid, rank) -> (nid, d2) of (id, x, y) rows."""
    out = {}
    ids, xy = np.array([i for i, _, _ in p]), np.array([(x, y) for _, x, y in p])
    for qid, qx, qy in q:
        d = np.abs(xy - (qx, qy))
        if periodic:
            d = np.minimum(d, 1 - d)
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
        order = [j for j in np.lexsort((ids, d2)) if include_self or ids[j] != qid][:k]
        for rank, j in enumerate(order, 1):
            out[qid, rank] = (int(ids[j]), float(d2[j]))
    return out


def found(df):
    return {(r["qid"], r["rank"]): (r["nid"], r["d2"]) for r in df.collect()}


def test_knn_dense_cluster_with_outliers_sees_few_points(spark):
    """20,000 points within 1e-3 and 200 far ones: no query, in the cluster or
    far from it, is compared with 50 points; nothing stays cached."""
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.normal(0.5, 1e-4, (20_000, 2)), rng.uniform(0, 1, (200, 2))])
    pts = cloud_of(spark, xy).repartition(8)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = nb.knn(pts, pts, 4, with_candidates=True)
    stats = got.agg(F.max("candidates").alias("most"), F.avg("candidates").alias("mean"), F.count("*").alias("n")).first()
    assert stats["n"] == 4 * 20_200 and stats["most"] < 50 and stats["mean"] < 15
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    rows = list(zip(range(len(xy)), xy[:, 0], xy[:, 1], strict=True))
    some = {i for i in range(0, 20_000, 997)} | set(range(20_000, 20_200, 7))
    assert found(got.where(F.col("qid").isin(sorted(some)))) == brute_knn([r for r in rows if r[0] in some], rows, 4)


def test_knn_of_other_queries_several_clouds(spark):
    """Queries that are no points, outside the cloud's box too; a cloud of one
    point, one on a line, one without queries and one without points."""
    rng = np.random.default_rng(8)
    clouds = {1: rng.uniform(-5, 9, (300, 2)), 2: rng.normal(0, 1, (1, 2)), 3: np.column_stack([np.linspace(0, 1, 120), np.zeros(120)]),
              4: rng.uniform(0, 1, (30, 2)), 6: np.vstack([rng.normal(c, 10.0 ** -c, (90, 2)) for c in range(1, 7)])}
    asked = {1: rng.uniform(-20, 20, (80, 2)), 2: rng.uniform(-1, 1, (4, 2)), 3: rng.uniform(-1, 2, (40, 2)), 5: rng.uniform(0, 1, (3, 2)),
             6: rng.uniform(0, 7, (60, 2))}
    points = spark.createDataFrame([(c, i, float(x), float(y)) for c, xy in clouds.items() for i, (x, y) in enumerate(xy)], POINTS)
    queries = spark.createDataFrame([(c, 1000 + i, float(x), float(y)) for c, xy in asked.items() for i, (x, y) in enumerate(xy)], POINTS)
    got = nb.knn(queries, points, 7)
    for c in (1, 2, 3, 6):
        p = [(i, x, y) for i, (x, y) in enumerate(clouds[c])]
        q = [(1000 + i, x, y) for i, (x, y) in enumerate(asked[c])]
        assert found(got.where(F.col("cloud") == c)) == brute_knn(q, p, 7)
    assert got.where("cloud IN (4, 5)").count() == 0


@pytest.mark.parametrize("include_self", [True, False])
def test_knn_on_the_torus(spark, include_self):
    rng = np.random.default_rng(14)
    xy = np.vstack([rng.uniform(0, 1, (150, 2)), rng.normal(0, 1e-3, (150, 2)) % 1.0, rng.uniform(0.999, 1, (20, 2))])
    pts = cloud_of(spark, xy)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    got, want = found(nb.knn(pts, pts, 6, include_self=include_self, periodic=True)), brute_knn(rows, rows, 6, include_self, True)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_knn_piles_and_missing_positions(spark):
    """Piles of equal points beside others at the edge of what a double tells
    apart; null and NaN positions take no part; an empty table."""
    rng = np.random.default_rng(2)
    xy = [(0.3, 0.3)] * 400 + [(np.nextafter(0.3, 1), 0.3)] * 300 + [(0.7, 0.7)] * 50 + [tuple(v) for v in rng.uniform(0, 1, (50, 2))]
    ids = rng.permutation(len(xy))
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(ids, xy, strict=True)]
    gone = [(0, 5000, None, 0.1), (0, 5001, float("nan"), 0.1), (0, 5002, 0.2, None)]
    pts = spark.createDataFrame([(0, *r) for r in rows] + gone, POINTS)
    for include_self in (True, False):
        got = nb.knn(pts, pts, 5, include_self=include_self, with_candidates=True)
        assert found(got) == brute_knn(rows, rows, 5, include_self)
        assert got.agg(F.max("candidates")).first()[0] < 60
    assert nb.knn(pts.limit(0), pts.limit(0), 3).count() == 0 and nb.knn(pts.limit(0), pts, 3).count() == 0


# ------------------------------------------------------------ balls and pairs
def brute_balls(q, p, radius, n):
    out = {}
    for qid, qx, qy in q:
        hits = sorted(i for i, x, y in p if (x - qx) * (x - qx) + (y - qy) * (y - qy) <= radius ** 2)[:n]
        for slot in range(n if hits else 1):
            out[qid, slot] = (hits[slot] if slot < len(hits) else hits[0]) if hits else None
    return out


def test_balls_with_a_cluster_on_the_rim(spark):
    """5,000 points in a cluster that the circles run through, and as many whole
    inside others: equal to brute force at both scales, and no query meets more
    than a few hundred of them."""
    from tidewater.operators import quadtree as qt
    rng = np.random.default_rng(6)
    xy = np.vstack([rng.normal(0.5, 0.004, (5_000, 2)), rng.uniform(0, 1, (200, 2))])
    ids = rng.permutation(len(xy))
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(ids, xy, strict=True)]
    pts = spark.createDataFrame([(0, *r) for r in rows], POINTS).repartition(8)
    asked = [(10_000 + i, 0.5 + 0.1 * math.cos(i), 0.5 + 0.1 * math.sin(i)) for i in range(60)] + [
        (20_000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.2, 1.2, (60, 2)))] + [(30_000, None, 0.5)]
    queries = spark.createDataFrame([(0, *r) for r in asked], POINTS)
    scales = [(0.1, 16), (0.25, 5)]
    got = nb.multi_scale_group(queries, pts, scales).collect()
    placed = [r for r in asked if r[1] is not None]
    for i, (radius, n) in enumerate(scales):
        mine = {(r["qid"], r["slot"]): r["nid"] for r in got if r["scale"] == i}
        assert mine == brute_balls(placed, rows, radius, n) | {(30_000, 0): None}
    tree = qt.build(pts, ["cloud"], "point_id", "x", "y", nb.BALL_CAPACITY, 16)
    q = queries.selectExpr("cloud", "point_id AS _qid", "x AS _qx", "y AS _qy")
    most = qt.candidates(tree, q, qt.lowest_in_balls(scales[:1]), "t").groupBy("_qid").count().agg(F.max("count")).first()[0]
    assert most < 300


def test_balls_on_piles(spark):
    rows = [(i, 0.25, 0.25) for i in range(0, 900, 3)] + [(i, 0.25 + i * 1e-5, 0.25) for i in range(1, 900, 3)]
    pts = spark.createDataFrame([(0, *r) for r in rows], POINTS)
    got = {(r["qid"], r["slot"]): r["nid"] for r in nb.ball_query(pts.where("point_id < 30"), pts, 0.004, 6).collect()}
    assert got == brute_balls([r for r in rows if r[0] < 30], rows, 0.004, 6)
    assert nb.ball_query(pts.limit(0), pts, 0.1, 2).count() == 0
    assert [tuple(r) for r in nb.ball_query(pts.where("point_id = 0"), pts.limit(0), 0.1, 2).collect()] == [(0, 0, 0, None)]


def test_pairs_of_a_crowded_cell_are_dealt(spark):
    """Half of the points in one cell: the same pairs as brute force, and no task
    makes more than a few percent of them."""
    rng = np.random.default_rng(10)
    xy = np.vstack([rng.uniform(0.51, 0.54, (1_200, 2)), rng.uniform(0, 1, (1_200, 2))])
    pts = cloud_of(spark, xy).repartition(4)
    d = xy[:, None, :] - xy[None, :, :]
    want = int(((d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]) <= 0.05 ** 2).sum())
    with no_broadcast(spark):
        j = nb.radius_pairs(pts, pts, 0.05, block=100)
        tasks = per_task(j)
        assert sum(tasks) == want > 1_200 ** 2 * 0.9 and max(tasks) < 0.08 * want
        assert j.select("qid", "nid").distinct().count() == want
    assert nb.radius_pairs(pts, pts, 0.05).count() == want


# ------------------------------------------------------------ farthest points
def brute_farthest(rows, n):
    ids, xy = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    d, out = np.full(len(ids), np.inf), []
    pick = int(ids.argmin())
    for _ in range(n):
        out.append(int(ids[pick]))
        step = xy - xy[pick]
        d = np.minimum(d, step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1])
        pick = int(min(np.flatnonzero(d == d.max()), key=lambda j: ids[j]))
    return out


def test_farthest_points_take_fewer_passes_than_picks(spark, monkeypatch):
    """300 picks of three clouds (even, clustered, a lattice full of ties): equal
    to one pick after the other, in a small part of as many passes."""
    rng = np.random.default_rng(17)
    clouds = {0: rng.uniform(0, 1, (3_000, 2)), 1: np.vstack([rng.normal(c, 0.01, (400, 2)) for c in range(5)]),
              2: np.array([(i, j) for i in range(25) for j in range(25)], float)}
    rows = {c: [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(len(xy)), xy, strict=True)] for c, xy in clouds.items()}
    pts = spark.createDataFrame([(c, *r) for c, rs in rows.items() for r in rs], POINTS).repartition(4)
    passes = []
    plain = nb.write_table
    monkeypatch.setattr(nb, "write_table", lambda df, name: passes.append(name) or plain(df, name))
    got = nb.farthest_points(pts, 300).collect()
    for c, rs in rows.items():
        mine = [r["point_id"] for r in sorted((r for r in got if r["cloud"] == c), key=lambda r: r["pick"])]
        assert mine == brute_farthest(rs, 300)
    assert passes.count("farthest-state") < 300 / 8


def test_farthest_points_of_few_points(spark):
    """Fewer places than picks: the lowest id again, as every distance is zero."""
    rows = [(0, 5, 0.1, 0.1), (0, 3, 0.1, 0.1), (0, 9, 0.7, 0.1), (1, 2, 0.0, 0.0), (1, 1, None, 0.0)]
    pts = spark.createDataFrame(rows, POINTS)
    got = nb.farthest_points(pts, 4).orderBy("cloud", "pick").collect()
    assert [(r["cloud"], r["point_id"]) for r in got] == [(0, 3), (0, 9), (0, 3), (0, 3), (1, 2), (1, 2), (1, 2), (1, 2)]
    assert nb.farthest_points(pts.limit(0), 3).count() == 0
