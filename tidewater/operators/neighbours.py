"""Neighbour searches inside point clouds: kNN, ball (range) query, radius
pairs, farthest-point sampling and the compositions built on them.

Points are rows ``(by..., id, x, y, ...)``. No search compares all pairs of a
cloud: kNN and ball queries descend a quadtree
(:mod:`tidewater.operators.quadtree`), radius pairs meet in cells of that
radius. Candidates are keyed by cell and query, so a large cloud is spread over
all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import quadtree as qt
from tidewater.operators.common import salted_join
from tidewater.operators.common import materialize as write_table

#: Points of one leaf in the tree of a ball query.
BALL_CAPACITY = 8
#: Rows of one side of a block pair in a crowded cell of a radius join.
PAIR_BLOCK = 4096


def _sqdist(ax: Column, ay: Column, bx: Column, by_: Column, periodic: bool = False) -> Column:
    dx, dy = F.abs(ax - bx), F.abs(ay - by_)
    if periodic:
        dx, dy = F.least(dx, 1 - dx), F.least(dy, 1 - dy)
    return dx * dx + dy * dy


def pairwise_sqdist(a: Column, b: Column, ax: str = "x", ay: str = "y", bx: str = "x", by_: str = "y") -> Column:
    """JN4 (expression form): squared distance between two positions."""
    return _sqdist(a[ax], a[ay], b[bx], b[by_])


def knn(queries: DataFrame, points: DataFrame, k: int, by: Sequence[str] = ("cloud",),
        qid: str = "point_id", pid: str = "point_id", x: str = "x", y: str = "y",
        include_self: bool = True, periodic: bool = False, with_candidates: bool = False) -> DataFrame:
    """JN5 / JN9: the ``k`` nearest points of every query in the same cloud.

    Returns ``(by..., qid, nid, rank, d2)`` with rank 1..k ordered by (squared
    distance, point id). ``include_self`` keeps the point with the query's own
    id (the reference's behaviour); ``periodic`` measures on the unit torus
    (minimum image, positions in [0, 1)). Fewer than k rows only when the cloud
    has fewer than k eligible points; ids must be unique in a cloud and among
    its queries. ``with_candidates`` adds the number of points a query was
    compared with.

    Exact, by a quadtree of counts (:mod:`tidewater.operators.quadtree`): a
    group of queries descends the tree with an upper bound of its k-th distance
    taken from the counts, and only points of cells below that bound are
    compared. An outlier beside a dense cluster meets the cluster's nearest
    cells, not the cluster.
    """
    by = list(by)
    need = k + (0 if include_self else 1)
    tree = qt.build(points, by, pid, x, y, max(need, 4), need, periodic)
    q = queries.select(*by, F.col(qid).alias("_qid"), F.col(x).cast("double").alias("_qx"), F.col(y).cast("double").alias("_qy"))
    j = qt.candidates(tree, q, qt.within_kth(need, periodic), "knn")
    if not include_self:
        j = j.where(F.col("_qid") != F.col("_nid"))
    j = j.withColumn("_d2", _sqdist(F.col("_qx"), F.col("_qy"), F.col("_nx"), F.col("_ny"), periodic))
    w = Window.partitionBy(*by, "_qid")
    r = j.withColumn("_rank", F.row_number().over(w.orderBy("_d2", "_nid")))
    if with_candidates:
        r = r.withColumn("candidates", F.count(F.lit(1)).over(w).cast("bigint"))
    r = r.where(F.col("_rank") <= k)
    return r.select(*by, F.col("_qid").alias("qid"), F.col("_nid").alias("nid"), F.col("_rank").cast("bigint").alias("rank"),
                    F.col("_d2").alias("d2"), *(["candidates"] if with_candidates else []))


def lowest_ids(df: DataFrame, keep: int, group: Sequence[str], pid: str = "point_id",
               salts: int = 64) -> DataFrame:
    """The ``keep`` rows with the lowest ``pid`` in every ``group``.

    A group holding a large share of the rows is cut by a salt first (top
    ``keep`` per group and salt), then the at most ``salts * keep`` survivors
    per group are ranked again: exact, and no task sees more than one salt
    slice of a hot group.
    """
    group = list(group)
    s1 = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(pid)), F.lit(salts)))
    s1 = s1.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(pid)))
    s1 = s1.where(F.col("_r") <= keep)
    s2 = s1.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(pid)))
    return s2.where(F.col("_r") <= keep).drop("_salt", "_r")


def multi_scale_group(queries: DataFrame, points: DataFrame, scales: Sequence[tuple[float, int]],
                      by: Sequence[str] = ("cloud",), qid: str = "point_id", pid: str = "point_id",
                      x: str = "x", y: str = "y") -> DataFrame:
    """JN7: for each (radius, nsample) scale the points with squared distance <=
    radius^2, the ``nsample`` lowest ids, short lists padded with the first
    (lowest-id) hit. Returns ``(by..., qid, slot, nid, scale)`` with slot
    0..nsample-1 and the scale's place; a query with no hit gets one row with NULL
    ``nid`` and slot 0. Query ids must be unique in a cloud.

    All scales in one descent of a quadtree (:mod:`tidewater.operators.quadtree`)
    that follows the lowest ids: cells out of reach are dropped, and so is a cell
    whose lowest id is above enough ids that lie inside for sure. A cluster,
    whole in the ball or across its rim, therefore costs a few cells."""
    by = list(by)
    tree = qt.build(points, by, pid, x, y, BALL_CAPACITY, max(n for _, n in scales))
    q = queries.select(*by, F.col(qid).alias("_qid"), F.col(x).cast("double").alias("_qx"), F.col(y).cast("double").alias("_qy"))
    j = qt.candidates(tree, q, qt.lowest_in_balls(scales), "ball")
    j = j.withColumn("_d2", _sqdist(F.col("_qx"), F.col("_qy"), F.col("_nx"), F.col("_ny")))
    table = F.array(*[F.struct(F.lit(i).cast("bigint").alias("scale"), F.lit(float(r) ** 2).alias("r2"), F.lit(n).alias("n"))
                      for i, (r, n) in enumerate(scales)])
    j = j.select(*by, "_qid", "_nid", F.explode(F.filter(table, lambda s: F.col("_d2") <= s["r2"])).alias("_s"))
    w = Window.partitionBy(*by, "_qid", "_s.scale").orderBy("_nid")
    j = j.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("_s.n"))
    lists = j.groupBy(*by, "_qid", F.col("_s.scale").alias("scale")).agg(F.array_sort(F.collect_list("_nid")).alias("_ids"))
    every = q.select(*by, "_qid", F.explode(table).alias("_s")).select(*by, "_qid", F.col("_s.scale").alias("scale"), F.col("_s.n").alias("_ns"))
    full = every.join(lists, [*by, "_qid", "scale"], "left")
    slots = F.transform(F.sequence(F.lit(0), F.col("_ns") - 1), lambda i: F.coalesce(F.get("_ids", i), F.get("_ids", F.lit(0))))
    none = F.array(F.lit(None).cast(points.schema[pid].dataType))
    out = full.select(*by, F.col("_qid").alias("qid"), "scale", F.posexplode(F.when(F.col("_ids").isNull(), none).otherwise(slots)).alias("slot", "nid"))
    return out.select(*by, "qid", F.col("slot").cast("bigint").alias("slot"), "nid", "scale")


def ball_query(queries: DataFrame, points: DataFrame, radius: float, nsample: int,
               by: Sequence[str] = ("cloud",), qid: str = "point_id", pid: str = "point_id",
               x: str = "x", y: str = "y") -> DataFrame:
    """JN6: :func:`multi_scale_group` of one scale -> ``(by..., qid, slot, nid)``."""
    return multi_scale_group(queries, points, [(radius, nsample)], by, qid, pid, x, y).drop("scale")


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, by: Sequence[str] = ("cloud",),
                 aid: str = "point_id", bid: str = "point_id", x: str = "x", y: str = "y",
                 block: int = PAIR_BLOCK) -> DataFrame:
    """JN4: squared distance of every (a, b) pair in the same cloud within
    ``radius`` -> (by..., qid, nid, d2). Bounded by the radius, never all pairs.

    Cells of side ``radius``, a 3 x 3 block of them around each ``a``. The pairs
    of a crowded cell are their own size (n^2), so they are dealt: its points
    and the queries that look into it are cut into blocks of about ``block``
    rows by a hash of the id, and each pair of blocks is a key of its own. Only
    the few crowded cells are counted into a table; others have one block."""
    by = list(by)
    cell = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(radius))).cast("bigint")
    ring = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    q = a.select(*by, F.col(aid).alias("_qid"), F.col(x).alias("_qx"), F.col(y).alias("_qy"), cell(x).alias("_hx"), cell(y).alias("_hy"))
    q = q.select("*", F.explode(ring).alias("_o")).select(
        *by, "_qid", "_qx", "_qy", (F.col("_hx") + F.col("_o.dx")).alias("_cx"), (F.col("_hy") + F.col("_o.dy")).alias("_cy"))
    p = b.select(*by, F.col(bid).alias("_nid"), F.col(x).alias("_nx"), F.col(y).alias("_ny"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    key = [*by, "_cx", "_cy"]
    counts = q.select(*key, F.lit(1).alias("_q"), F.lit(0).alias("_p")).unionByName(
        p.select(*key, F.lit(0).alias("_q"), F.lit(1).alias("_p"))).groupBy(*key).agg(F.sum("_q").alias("_q"), F.sum("_p").alias("_p"))
    # written, so that the joins know its size
    crowded = write_table(counts.where((F.least("_q", "_p") > 0) & (F.greatest("_q", "_p") > block)).select(
        *key, (F.col("_q") + F.col("_p")).alias("_rows"), F.ceil(F.col("_q") / block).cast("int").alias("_qs"),
        F.ceil(F.col("_p") / block).cast("int").alias("_ps")), "crowded-cells")

    def dealt(rows: DataFrame, own: str, other: str, row_id: str, out_own: str, out_other: str) -> DataFrame:
        r = salted_join(rows, crowded, key, [row_id], how="left", weight="_rows")
        r = r.withColumn(out_own, F.coalesce(F.pmod(F.xxhash64(row_id), F.col(own)), F.lit(0)).cast("int"))
        r = r.withColumn(out_other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        return r.drop("_rows", "_qs", "_ps")

    j = dealt(q, "_qs", "_ps", "_qid", "_qb", "_pb").join(dealt(p, "_ps", "_qs", "_nid", "_pb", "_qb"), [*key, "_qb", "_pb"])
    j = j.withColumn("_d2", _sqdist(F.col("_qx"), F.col("_qy"), F.col("_nx"), F.col("_ny"))).where(F.col("_d2") <= F.lit(float(radius) ** 2))
    return j.select(*by, F.col("_qid").alias("qid"), F.col("_nid").alias("nid"), F.col("_d2").alias("d2"))


def multi_scale_knn(queries: DataFrame, points: DataFrame, sizes: Sequence[int],
                    by: Sequence[str] = ("cloud",), **kw) -> DataFrame:
    """JN7, nearest-neighbour mode: the ``sizes[i]`` nearest points for each
    scale; adds ``scale`` (0-based). One search of the largest size: a smaller
    scale is the head of its ranks."""
    nn = knn(queries, points, max(sizes), by, **kw)
    scales = F.array(*[F.struct(F.lit(i).cast("bigint").alias("scale"), F.lit(k).alias("k")) for i, k in enumerate(sizes)])
    return (nn.withColumn("_s", F.explode(F.filter(scales, lambda s: s["k"] >= F.col("rank"))))
              .select(*nn.columns, F.col("_s.scale").alias("scale")))


def gather(index: DataFrame, points: DataFrame, cols: Sequence[str], by: Sequence[str] = ("cloud",),
           nid: str = "nid", pid: str = "point_id") -> DataFrame:
    """JN3: values of ``cols`` at the indexed points (equi-join on cloud, id)."""
    by = list(by)
    p = points.select(*by, F.col(pid).alias(nid), *cols)
    return index.join(p, [*by, nid], "left")


def edge_list(points: DataFrame, k: int = 16, by: Sequence[str] = ("cloud",), pid: str = "point_id",
              x: str = "x", y: str = "y", periodic: bool = False, materialize: bool = True) -> DataFrame:
    """JN8: k-nearest-neighbour graph without self loops, as (by..., src, dst):
    ``src`` is the neighbour, ``dst`` the point that receives its message.

    Graph operators join the edge table several times per round, so by
    default it is written once as a table in the shared folder and every
    later use reads that copy instead of re-running the search."""
    nn = knn(points, points, k, by, pid, pid, x, y, include_self=False, periodic=periodic)
    edges = nn.select(*by, F.col("nid").alias("src"), F.col("qid").alias("dst"))
    return write_table(edges, "edges") if materialize else edges


def _pick_batch(cells: pd.DataFrame, n: int) -> list[tuple[int, int]]:
    """(pick number, row) of as many next picks as the cells of one cloud decide.

    A row is a cell: its best point (largest squared distance ``d`` to the picks
    so far, then lowest id) and the box of its points; points in no cell have a
    ``d`` below ``floor``. A pick lowers distances. As long
    as it leaves a cell's best point alone, that point stays the best, for the
    others can only have fallen; otherwise only a bound is known, the lesser of
    what it was and of the farthest corner from the pick. The batch ends when a
    cell that is only bounded, or a point in no cell, could be the next pick."""
    d, ids = cells["d"].to_numpy().copy(), cells["id"].to_numpy()
    bx, by_ = cells["bx"].to_numpy(), cells["by"].to_numpy()
    x0, x1, y0, y1 = (cells[c].to_numpy() for c in ("x0", "x1", "y0", "y1"))
    bound, exact = d.copy(), np.ones(len(d), bool)
    out = []
    for pick in range(int(cells["have"].iloc[0]), n):
        known = np.flatnonzero(exact)
        if not len(known):
            break
        top = known[d[known] == d[known].max()]
        i = top[ids[top].argmin()]
        if d[i] < cells["floor"].iloc[0] or not exact.all() and bound[~exact].max() >= d[i]:
            break
        out.append((pick, int(i)))
        px, py = bx[i], by_[i]
        near = (bx - px) * (bx - px) + (by_ - py) * (by_ - py)
        exact &= near >= d
        d = np.minimum(d, near)
        fx, fy = np.maximum(x1 - px, px - x0), np.maximum(y1 - py, py - y0)
        bound = np.where(exact, d, np.minimum(bound, fx * fx + fy * fy))
    return out


def farthest_points(points: DataFrame, n: int, by: Sequence[str] = ("cloud",), pid: str = "point_id",
                    x: str = "x", y: str = "y") -> DataFrame:
    """WIN17: ``n`` farthest-point picks per cloud, starting at the lowest id;
    each next pick has the largest distance to the picks before it (ties: lowest
    id). Returns (by..., pick, point_id, x, y). Rows with a null or NaN position
    take no part.

    Several picks a job. A pass over the points updates their distances with the
    picks found last and reduces those at least half as far as the farthest one
    to a table of grid cells, their side an eighth of that distance: after s
    picks at most some 200 s cells, whatever the number and the spread of the
    points. A cell is its best point and its box, and picks are read off the
    table as long as it decides them (:func:`_pick_batch`); they are exact. Picks
    far from each other do not disturb one another, so a batch grows with the
    number of picks there are. State and picks are written tables."""
    by = list(by)
    pts = points.select(*by, F.col(pid).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pts = pts.where(~(F.isnan("_x") | F.isnan("_y")) & F.col("_x").isNotNull() & F.col("_y").isNotNull())
    types = {c: points.schema[c].dataType.simpleString() for c in [*by, pid]}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), f"pick bigint, _id {types[pid]}, _x double, _y double"])
    first = write_table(pts.groupBy(*by).agg(
        F.min_by(F.struct("_id", "_x", "_y"), "_id").alias("p"), F.count(F.lit(1)).alias("_rows")), "farthest-first")
    sizes = first.select(*by, "_rows")
    fresh = first.select(*by, F.lit(0).cast("bigint").alias("pick"), "p._id", "p._x", "p._y")
    picks, state = [fresh], pts.withColumn("_d", F.lit(float("inf")))

    def batch(cells: pd.DataFrame) -> pd.DataFrame:
        got = _pick_batch(cells, n)
        rows = cells.iloc[[i for _, i in got]]
        return pd.DataFrame({**{c: rows[c].to_numpy() for c in by}, "pick": [p for p, _ in got], "_id": rows["id"].to_numpy(),
                             "_x": rows["bx"].to_numpy(), "_y": rows["by"].to_numpy()})

    while True:
        # every cloud that wants more gets at least one pick a batch
        news = fresh.groupBy(*by).agg(F.collect_list(F.struct("_x", "_y")).alias("_new"), (F.max("pick") + 1).alias("have")).where(F.col("have") < n)
        if news.isEmpty():
            break
        nearest = F.array_min(F.transform("_new", lambda p: _sqdist(F.col("_x"), F.col("_y"), p["_x"], p["_y"])))
        state = write_table(salted_join(state, news.join(sizes, by), by, ["_id"], weight="_rows").select(
            *by, "_id", "_x", "_y", F.least("_d", nearest).alias("_d"), "have"), "farthest-state")
        top = state.groupBy(*by).agg(F.max("_d").alias("_top"), F.count(F.lit(1)).alias("_rows"))
        far = salted_join(state, top, by, ["_id"], weight="_rows").where(F.col("_d") >= F.col("_top") / 4)
        side = F.when(F.col("_top") > 0, F.sqrt("_top") / 8).otherwise(F.lit(1.0))
        cells = far.groupBy(*by, F.floor(F.col("_x") / side).alias("_cx"), F.floor(F.col("_y") / side).alias("_cy")).agg(
            F.max_by(F.struct("_id", "_x", "_y"), F.struct("_d", -F.col("_id"))).alias("b"), F.max("_d").alias("d"),
            F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"),
            F.first("have").alias("have"), (F.first("_top") / 4).alias("floor"))
        cells = cells.select(*by, F.col("b._id").alias("id"), F.col("b._x").alias("bx"), F.col("b._y").alias("by"), "d", "x0", "x1", "y0", "y1",
                             "have", "floor")
        state = state.drop("have")
        fresh = write_table(cells.groupBy(*by).applyInPandas(batch, schema), "farthest-picks")
        picks.append(fresh)
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out.select(*by, "pick", F.col("_id").alias(pid), F.col("_x").alias(x), F.col("_y").alias(y))


def sample_and_group(points: DataFrame, npoint: int, nsample: int, feats: Sequence[str],
                     by: Sequence[str] = ("cloud",), pid: str = "point_id", x: str = "x", y: str = "y",
                     radius: float | None = None) -> DataFrame:
    """WIN18: FPS centres, their members, member positions relative to the
    centre and member features appended. Members are the ``nsample`` nearest
    points, or with ``radius`` the ball query's (lowest ids, padded; ``rank`` is
    the slot plus one). Returns (by..., centre, rank, nid, rel_x, rel_y,
    feats...)."""
    by = list(by)
    centres = farthest_points(points, npoint, by, pid, x, y)
    if radius is None:
        nn = knn(centres, points, nsample, by, pid, pid, x, y)
    else:
        nn = ball_query(centres, points, radius, nsample, by, pid, pid, x, y).withColumn("rank", F.col("slot") + 1)
    c = centres.select(*by, F.col(pid).alias("qid"), F.col(x).alias("_cx"), F.col(y).alias("_cy"))
    g = gather(nn, points, [x, y, *feats], by)
    g = g.join(c, [*by, "qid"])
    return g.select(*by, F.col("qid").alias("centre"), "rank", "nid",
                    (F.col(x) - F.col("_cx")).alias("rel_x"), (F.col(y) - F.col("_cy")).alias("rel_y"), *feats)


def set_abstraction(groups: DataFrame, feats: Sequence[str], by: Sequence[str] = ("cloud",),
                    centre: str = "centre") -> DataFrame:
    """AGG14: max-pool of grouped member features per centre."""
    return groups.groupBy(*by, centre).agg(*[F.max(f).alias(f"max_{f}") for f in feats])


def group_all(points: DataFrame, feats: Sequence[str], by: Sequence[str] = ("cloud",),
              x: str = "x", y: str = "y") -> DataFrame:
    """AGG15: one group per cloud with the origin as centre: member positions
    are absolute; features are max-pooled (partial + final aggregate)."""
    return points.groupBy(*by).agg(
        F.lit(0.0).alias("centre_x"), F.lit(0.0).alias("centre_y"), F.count(F.lit(1)).cast("bigint").alias("n"),
        F.max(x).alias(f"max_{x}"), F.max(y).alias(f"max_{y}"), *[F.max(f).alias(f"max_{f}") for f in feats])


def normalise_cloud(points: DataFrame, by: Sequence[str] = ("cloud",), x: str = "x", y: str = "y") -> DataFrame:
    """WIN19: subtract the centroid and divide by the largest radius, per cloud.
    Uses two aggregates joined back by salted joins (not a window), so a cloud is
    never one task."""
    by = list(by)
    c = points.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count(F.lit(1)).alias("_rows"))
    p = salted_join(points, c, by, [x, y], weight="_rows").drop("_rows").withColumn(x, F.col(x) - F.col("_mx")).withColumn(y, F.col(y) - F.col("_my"))
    m = p.groupBy(*by).agg(F.max(F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))).alias("_m"), F.count(F.lit(1)).alias("_rows"))
    p = salted_join(p, m, by, [x, y], weight="_rows").drop("_rows")
    safe = F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.lit(1.0))
    return p.withColumn(x, F.col(x) / safe).withColumn(y, F.col(y) / safe).drop("_mx", "_my", "_m")


def idw3(targets: DataFrame, sources: DataFrame, feats: Sequence[str], by: Sequence[str] = ("cloud",),
         tid: str = "point_id", sid: str = "point_id", x: str = "x", y: str = "y", k: int = 3,
         eps: float = 1e-8, own: Sequence[str] = ()) -> DataFrame:
    """PC11: interpolate source features at targets from the ``k`` nearest
    sources, weights 1 / (squared distance + eps), normalised; with a single
    source the value is copied. Returns (by..., point_id, feats...); ``own``
    puts the target's own columns of these names before the interpolated ones,
    as ``own_<name>``."""
    by = list(by)
    nn = knn(targets, sources, k, by, tid, sid, x, y)
    g = gather(nn, sources, feats, by, pid=sid)
    g = g.withColumn("_w", F.lit(1.0) / (F.col("d2") + F.lit(eps)))
    out = g.groupBy(*by, "qid").agg(*[
        F.when(F.count(F.lit(1)) == 1, F.first(f)).otherwise(F.sum(F.col("_w") * F.col(f)) / F.sum("_w")).alias(f)
        for f in feats])
    out = out.withColumnRenamed("qid", tid)
    if not own:
        return out
    skip = targets.select(*by, tid, *[F.col(c).alias(f"own_{c}") for c in own])
    return skip.join(out, [*by, tid])


def group_softmax(df: DataFrame, by: Sequence[str], score: str, scale: float = 1.0,
                  out: str = "weight") -> DataFrame:
    """WIN16: softmax of ``score * scale`` within each group (max-shifted).
    Groups are neighbour lists or patches, bounded in size."""
    w = Window.partitionBy(*by)
    s = F.col(score) * F.lit(float(scale))
    e = F.exp(s - F.max(s).over(w))
    return df.withColumn(out, e / F.sum(e).over(w))
