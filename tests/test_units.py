"""Hand-made cases (FIXTURES part 3), round trips and property checks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import curves as cv
from tidewater.operators import forecast as fc
from tidewater.operators import grid as gd
from tidewater.operators import leaderboard as lb
from tidewater.operators import neighbours as nb
from tidewater.operators import ordinal as od
from tidewater.operators import pooling as pl
from tidewater.operators import runs as rn
from tidewater.operators import spectral as sp
from tidewater.operators import windows as win


# ------------------------------------------------------------ leaderboard cases
def test_null_nan_and_value_ranks(spark):
    df = spark.createDataFrame([("a", "grid", "E", "low", None), ("b", "grid", "E", "low", float("nan")),
                                ("c", "grid", "E", "low", 1.0)],
                               "model string, domain string, equation string, resolution string, v double")
    r = {x.model: x.rank for x in lb.rank_cells(df, "v").collect()}
    assert r == {"a": 1000, "b": 1000, "c": 0}


def test_missing_cells_get_the_sentinel_in_every_table(spark):
    """A (model, domain) without a run in one column: ranked last there, counted
    in its mean rank, listed by the audit."""
    rows = [(m, "grid", e, "low", v) for m, e, v in [("a", "E", 1.0), ("b", "E", 2.0), ("a", "F", 5.0), ("c", "F", 4.0), ("c", "E", 1.0)]]
    df = spark.createDataFrame(rows, "model string, domain string, equation string, resolution string, v double")
    ranks = {(x.model, x.equation): x.rank for x in lb.rank_cells(df, "v").collect()}
    assert ranks == {("a", "E"): 0, ("c", "E"): 0, ("b", "E"): 2, ("c", "F"): 0, ("a", "F"): 1, ("b", "F"): 1000}
    mean = {x.model: x.mean_rank for x in lb.mean_rank(lb.rank_cells(df, "v")).collect()}
    assert mean == {"a": 0.5, "b": 501.0, "c": 0.0}
    gone = lb.missing_combinations(df, ["grid"], ["low"], ["a", "b", "c"], ["E", "F"], F.lit(False))
    assert [(r.model, r.equation) for r in gone.collect()] == [("b", "F")]


def test_patch_offset_counts_match_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(0, 0, i, *map(int, rng.integers(0, 40, 3))) for i in range(300)] + [(0, 1, i, 5, 5, i) for i in range(30)] + [(1, 0, 0, 1, 2, 3)]
    p = spark.createDataFrame(rows, "batch int, patch long, pos long, ix int, iy int, iz int")
    for bound in (0, 1, 4):
        want = {}
        for b, c, *_ in {(r[0], r[1]) for r in rows}:
            pts = np.array([r[3:] for r in rows if r[:2] == (b, c)])
            for a, axis in enumerate(("ix", "iy", "iz")):
                d = np.clip(pts[:, None, a] - pts[None, :, a], -bound, bound) + bound
                want.update({(b, c, axis, int(i)): int(n) for i, n in zip(*np.unique(d, return_counts=True), strict=True)})
        assert {tuple(r)[:4]: r["pairs"] for r in pl.patch_offset_counts(p, bound).collect()} == want


def test_tied_minimum_both_flagged_and_all_diverged(spark):
    df = spark.createDataFrame([("a", "grid", "E", "low", 0.5), ("b", "grid", "E", "low", 0.5),
                                ("c", "grid", "E", "low", 0.7), ("d", "grid", "F", "low", 3.0),
                                ("e", "grid", "F", "low", 4.0), ("f", "grid", "F", "low", 5.0)],
                               "model string, domain string, equation string, resolution string, test_loss double")
    best = {(r.equation, r.model) for r in lb.best_mask(df, "test_loss").where("best").collect()}
    assert best == {("E", "a"), ("E", "b")}


def test_duplicate_pivot_key_is_an_error(spark):
    df = spark.createDataFrame([("a", "grid", "E", "low", 1.0), ("a", "grid", "E", "low", 2.0)],
                               "model string, domain string, equation string, resolution string, v double")
    with pytest.raises(Exception, match="duplicate pivot key"):
        lb.pivot_metric(df, "v", ["E"]).collect()


def test_missing_combinations_count_on_reference_dims(spark):
    from tidewater.functions import dims
    runs = spark.createDataFrame([("grid", "low", "cnn", "advection")],
                                 "domain string, resolution string, model string, equation string")
    imp = ((F.col("domain") == "cloud") & F.col("model").isin(dims.GRID_ONLY_MODELS)) | \
          ((F.col("domain") == "cloud") & (F.col("resolution") == "full"))
    m = lb.missing_combinations(runs, dims.AUDIT_DOMAINS, dims.AUDIT_RESOLUTIONS, dims.AUDIT_MODELS,
                                dims.AUDIT_EQUATIONS, imp)
    assert m.count() == 516 - 1  # all possible combinations minus the one observed


# ------------------------------------------------------------ run-log cases
def test_single_value_is_plain_column_and_natural_order(spark):
    log = spark.createDataFrame([("r", 1, "train_step_ms", 5.0), ("r", 1, "test_loss-10", 1.0),
                                 ("r", 2, "test_loss-2", 2.0), ("r", 3, "test_loss-1", 3.0),
                                 ("r", 4, "val_loss", 9.0), ("r", 5, "epoch", 1.0)],
                                "run string, ord int, metric string, value double")
    s = rn.summarise_run(log)
    names = {r.name: r.value for r in s.collect()}
    assert names == {"train_step_ms": 5.0, "test_loss-10": 1.0, "test_loss-2": 2.0, "test_loss-1": 3.0}
    ordered = [r.name for r in s.orderBy(rn.natural_key("name")).collect()]
    assert ordered == ["test_loss-1", "test_loss-2", "test_loss-10", "train_step_ms"]
    inner = spark.createDataFrame([("run10_b2",), ("run2_b10",), ("Run2_b9",), ("run2",), ("2run",), ("10run",)], "name string")
    assert [r.name for r in inner.orderBy(rn.natural_key("name")).collect()] == ["2run", "10run", "run2", "Run2_b9", "run2_b10", "run10_b2"]


def test_metric_rule_and_parse(spark):
    assert [c for c in ["epoch", "step", "train_loss", "val_loss_rmse", "train_step_ms", "test_loss",
                        "test_loss-3", "test_time"] if rn.is_metric_name(c)] == \
        ["train_step_ms", "test_loss-3", "test_time"]
    df = spark.createDataFrame([("Sim_geo_fno:wave:low:1:2",), ("Sim_neuralPDE:burgers:high:a:b",),
                                ("Sim_x_y_z:wave:low:1:2",)], "name string")
    p = [r.p for r in df.select(rn.parse_run_name("name").alias("p")).collect()]
    assert (p[0].model, p[0].equation, p[0].version) == ("geo_fno", "wave", "1:2")
    assert p[1].model == "neuralpde"
    assert p[2] is None


# ------------------------------------------------------------ curves
def test_zorder_depth3_is_permutation(spark):
    n = 8
    df = spark.range(n ** 3).select((F.col("id") % n).alias("x"), ((F.col("id") / n).cast("int") % n).alias("y"),
                                    (F.col("id") / (n * n)).cast("int").alias("z"))
    codes = sorted(r.c for r in df.select(cv.z_order("x", "y", "z").alias("c")).collect())
    assert codes == list(range(n ** 3))


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_hilbert_unit_steps_and_roundtrip(spark, depth):
    n = 1 << depth
    df = spark.range(n ** 3).select((F.col("id") % n).alias("x"), ((F.col("id") / n).cast("int") % n).alias("y"),
                                    (F.col("id") / (n * n)).cast("int").alias("z"))
    h = cv.with_hilbert(df, "x", "y", "z", F.lit(depth), "h")
    d = cv.with_hilbert_decoded(h, "h", F.lit(depth), ("a", "b", "c")).collect()
    assert sorted(r.h for r in d) == list(range(n ** 3))
    assert all((r.x, r.y, r.z) == (r.a, r.b, r.c) for r in d)
    cell = {r.h: (r.x, r.y, r.z) for r in d}
    assert all(sum(abs(p - q) for p, q in zip(cell[i], cell[i + 1])) == 1 for i in range(n ** 3 - 1))


def test_patch_padding_copies_previous_patch_slot(spark):
    ordered = spark.createDataFrame([(0, i) for i in range(5)] + [(1, i) for i in range(2)], "batch int, pos long")
    p = pl.patches(ordered, k_max=2).where(F.col("batch") == 0).orderBy("pos").collect()
    assert [r.src_pos for r in p] == [0, 1, 2, 3, 4, 3]
    assert [r.is_pad for r in p] == [False] * 5 + [True]


def test_ordinal_matches_window_on_skewed_groups(spark):
    # one group holds most rows: numbering must still equal row_number()
    rows = [(0, i) for i in range(3000)] + [(g, i) for g in range(1, 40) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, t int").withColumn("t", F.col("t") * 7 % 3001)
    got = od.ordinal(df, ["g"], ["t"], out="n", partitions=16)
    ref = df.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy("t")))
    j = got.join(ref, ["g", "t"])
    assert j.count() == len(rows)
    assert j.where(F.col("n") != F.col("m")).count() == 0
    rs = od.running_sum(df, ["g"], ["t"], F.col("t").cast("bigint"), out="s", partitions=16)
    ref2 = df.withColumn("s2", F.sum("t").over(Window.partitionBy("g").orderBy("t")))
    assert rs.join(ref2, ["g", "t"]).where(F.col("s") != F.col("s2")).count() == 0


# ------------------------------------------------------------ neighbours
def test_ball_without_hit_is_null(spark):
    pts = spark.createDataFrame([(0, 1, 0.1, 0.1), (0, 2, 0.12, 0.1)], "cloud int, point_id long, x double, y double")
    q = spark.createDataFrame([(0, 9, 0.9, 0.9)], "cloud int, point_id long, x double, y double")
    b = nb.ball_query(q, pts, 0.05, 4).collect()
    assert len(b) == 1 and b[0].nid is None


def test_one_coarse_source_is_copied(spark):
    src = spark.createDataFrame([(0, 1, 0.5, 0.5, 7.0)], "cloud int, point_id long, x double, y double, f double")
    tgt = spark.createDataFrame([(0, 10, 0.1, 0.2), (0, 11, 0.9, 0.7)], "cloud int, point_id long, x double, y double")
    out = [r.f for r in nb.idw3(tgt, src, ["f"]).collect()]
    assert out == [7.0, 7.0]


def test_periodic_knn_wraps(spark):
    pts = spark.createDataFrame([(0, 1, 0.01, 0.5), (0, 2, 0.99, 0.5), (0, 3, 0.5, 0.5)],
                                "cloud int, point_id long, x double, y double")
    r = nb.knn(pts, pts, 1, include_self=False, periodic=True).where("qid = 1").first()
    assert r.nid == 2 and r.d2 == pytest.approx(0.0004)


def test_knn_matches_brute_force_on_clustered_cloud(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0.2, 0.01, (150, 2))
    b = rng.uniform(0, 1, (30, 2))  # sparse outliers need wider rounds
    xy = np.vstack([a, b])
    pts = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                "cloud int, point_id long, x double, y double")
    got = {(r.qid, r.rank): r.nid for r in nb.knn(pts, pts, 5).collect()}
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    for i in range(len(xy)):
        order = sorted(range(len(xy)), key=lambda j: (d[i, j], j))[:5]
        assert [got[(i, k + 1)] for k in range(5)] == order


def test_knn_tight_cluster_in_wide_cloud(spark):
    # 400 points within 1e-4 of each other plus a wide sparse cloud: queries in
    # the cluster must see a few points of it only, and still be exact
    rng = np.random.default_rng(11)
    xy = np.vstack([rng.normal(0.5, 1e-4, (400, 2)), rng.uniform(0, 1, (40, 2))])
    pts = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                "cloud int, point_id long, x double, y double")
    res = nb.knn(pts, pts, 3, include_self=False, with_candidates=True).collect()
    got = {(r.qid, r.rank): r.nid for r in res}
    assert max(r.candidates for r in res) < 40
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    for i in range(len(xy)):
        order = sorted((j for j in range(len(xy)) if j != i), key=lambda j: (d[i, j], j))[:3]
        assert [got[(i, k + 1)] for k in range(3)] == order


def test_knn_and_ball_with_many_coincident_points(spark):
    # 600 copies of one location plus scattered points: exact answers with
    # coincident points thinned to the lowest ids
    rng = np.random.default_rng(21)
    xy = np.vstack([np.full((600, 2), 0.4), rng.uniform(0.3, 0.5, (60, 2))])
    pts = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                "cloud int, point_id long, x double, y double")
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    got = {(r.qid, r.rank): r.nid for r in nb.knn(pts, pts, 4, include_self=False).collect()}
    for i in list(range(0, 600, 37)) + list(range(600, 660)):
        order = sorted((j for j in range(len(xy)) if j != i), key=lambda j: (d[i, j], j))[:4]
        assert [got[(i, k + 1)] for k in range(4)] == order
    balls = {}
    for r in nb.ball_query(pts, pts, 0.02, 5).collect():
        balls.setdefault(r.qid, {})[r.slot] = r.nid
    for i in list(range(0, 600, 53)) + list(range(600, 660)):
        hits = sorted(j for j in range(len(xy)) if d[i, j] <= 0.02 ** 2)[:5]
        hits += [hits[0]] * (5 - len(hits))
        assert [balls[i][s] for s in range(5)] == hits


def test_ball_query_dense_cluster_takes_fine_path(spark):
    # a dense cluster of distinct points (all within each other's radius)
    # next to sparse points: exact lowest ids, padded
    rng = np.random.default_rng(31)
    xy = np.vstack([rng.uniform(0.5, 0.51, (500, 2)), rng.uniform(0.3, 0.7, (80, 2))])
    ids = rng.permutation(len(xy))
    pts = spark.createDataFrame([(0, int(i), float(x), float(y)) for i, (x, y) in zip(ids, xy)],
                                "cloud int, point_id long, x double, y double")
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    r, ns = 0.03, 6
    balls = {}
    for row in nb.ball_query(pts, pts, r, ns).collect():
        balls.setdefault(row.qid, {})[row.slot] = row.nid
    for i in list(range(0, 500, 17)) + list(range(500, 580)):
        hits = sorted(int(ids[j]) for j in range(len(xy)) if d[i, j] <= r * r)[:ns]
        hits += [hits[0]] * (ns - len(hits))
        assert [balls[int(ids[i])][s] for s in range(ns)] == hits


def test_farthest_points_distances_never_grow(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 1, (60, 2))
    pts = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                "cloud int, point_id long, x double, y double")
    picks = [r.point_id for r in nb.farthest_points(pts, 8).orderBy("pick").collect()]
    # brute force FPS from the lowest id
    chosen, dist = [0], ((xy - xy[0]) ** 2).sum(1)
    gaps = []
    for _ in range(7):
        nxt = int(max(range(len(xy)), key=lambda j: (dist[j], -j)))
        gaps.append(dist[nxt])
        chosen.append(nxt)
        dist = np.minimum(dist, ((xy - xy[nxt]) ** 2).sum(1))
    assert picks == chosen
    assert all(g1 >= g2 for g1, g2 in zip(gaps, gaps[1:]))


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, -1.0), (2, 3.0)], "g int, s double")
    sums = nb.group_softmax(df, ["g"], "s", 0.7).groupBy("g").agg(F.sum("weight").alias("t")).collect()
    assert all(r.t == pytest.approx(1.0) for r in sums)


# ------------------------------------------------------------ forecast and windows
def test_linear_rollout(spark):
    df = spark.createDataFrame([([[0.0], [1.0], [2.0], [3.0]],)], "x array<array<double>>")
    out = df.select(fc.rollout("x", fc.linear_step, 3, 4).alias("p")).first().p
    assert [v[0] for v in out] == [4.0, 5.0, 6.0]


def test_stack_unstack_roundtrip(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],)], "x array<array<double>>")
    r = df.select(win.stack_lookback("x").alias("s"), win.unstack_lookback(win.stack_lookback("x"), 2).alias("u")).first()
    assert r.s == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert r.u == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]


def test_batches_cover_every_row_once(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    b = win.batches(df, 10, ["k"], shuffle=True, seed=3, id_col="k")
    rows = b.collect()
    assert len(rows) == 103 and len({r.k for r in rows}) == 103
    sizes = {}
    for r in rows:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sorted(sizes.values()) == [3] + [10] * 10
    assert win.limit_batches(b, 2).count() == 20


# ------------------------------------------------------------ spectral and grid
def test_fourier_fit_recovers_band_limited_field(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 1, (120, 2))
    ks = sp.wavenumbers(3, 2)
    coef = {k: complex(rng.normal(), rng.normal()) for k in ks}
    def field(x, y):
        return sum((c * np.exp(1j * 2 * np.pi * ((x - 0.5) * k[0] + (y - 0.5) * k[1]))) for k, c in coef.items())
    u = [field(x, y) for x, y in xy]
    # a real-valued sample of the complex field: fit real part; check by evaluating
    pts = spark.createDataFrame([(0, i, float(x), float(y), float(v.real)) for i, ((x, y), v) in enumerate(zip(xy, u))],
                                "cloud int, point_id long, x double, y double, v double")
    c = sp.fourier_fit(pts, "v", 3)
    back = sp.fourier_eval(c, pts).select("v", "value").collect()
    assert max(abs(r.v - r.value) for r in back) < 1e-8


def test_pad_then_crop_is_identity(spark):
    cells = [("s", gx, gy, float(gx * 10 + gy)) for gx in range(4) for gy in range(3)]
    g = spark.createDataFrame(cells, "sample_id string, gx int, gy int, value double")
    p = gd.pad_grid(g, 2, 4, 3)
    assert p.count() == (4 + 4) * (3 + 4)
    corner = p.where("px = 0 AND py = 0").first().value
    assert corner == 0.0
    back = sorted(tuple(r) for r in gd.crop_grid(p, 2, 4, 3).collect())
    assert back == sorted(cells)


def test_low_pass_keeps_all_modes_exactly(spark):
    w, h = 6, 5
    rng = np.random.default_rng(1)
    vals = rng.normal(size=(w, h))
    g = spark.createDataFrame([("s", i, j, float(vals[i, j])) for i in range(w) for j in range(h)],
                              "sample_id string, gx int, gy int, value double")
    out = gd.low_pass(g, 3, 3, w, h).collect()
    rec = np.zeros((w, h))
    for r in out:
        rec[r.gx, r.gy] = r.value
    ref = np.fft.irfftn(np.fft.rfftn(vals, axes=(0, 1)), s=(w, h), axes=(0, 1))
    assert np.allclose(rec, ref, atol=1e-9)
    assert np.allclose(rec, vals, atol=1e-9)


def test_stencil_periodic(spark):
    g = spark.createDataFrame([("s", i, j, float(i + 10 * j)) for i in range(3) for j in range(3)],
                              "sample_id string, gx int, gy int, value double")
    s = {(r.gx, r.gy): r.value for r in gd.stencil(g, {(1, 0): 1.0}, 3, 3).collect()}
    assert s[(2, 0)] == 0.0 and s[(0, 1)] == 11.0


def test_nudft_matches_numpy(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 1, (40, 2))
    u = rng.normal(size=40)
    pts = spark.createDataFrame([(0, i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, u))],
                                "cloud int, point_id long, x double, y double, f double")
    got = {(r.k1, r.k2): complex(r.re, r.im) for r in sp.nudft(pts, "f", 2, 2).collect()}
    for (k1, k2), v in got.items():
        ref = np.sum(u * np.exp(-1j * 2 * math.pi * (xy[:, 0] * k1 + xy[:, 1] * k2)))
        assert abs(v - ref) < 1e-9


# ------------------------------------------------------------ rounding, scratch folder
def test_fixed_keeps_large_and_small_values(spark):
    from tidewater.functions.numeric import fixed, fixed_sql
    import duckdb

    vals = [3.65e13, 5.93e-07, 1.2345678, -0.5, 9.3e18, 1e300, 0.0, -1e-15, None, float("nan"), float("inf")]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
           .select("i", fixed("v").alias("v")).orderBy("i").collect()]
    assert got[:8] == [3.65e13, 5.93e-07, 1.234568, -0.5, 9.3e18, 1e300, 0.0, 0.0]
    assert got[8] is None and got[9] != got[9] and got[10] == float("inf")
    con = duckdb.connect()
    for v, g in zip(vals[:8], got, strict=False):
        assert con.execute(f"SELECT {fixed_sql('CAST(? AS DOUBLE)')}", [v]).fetchone()[0] == g


def test_cluster_without_shared_folder_is_an_error(spark, monkeypatch):
    from tidewater import session

    class Conf:
        def get(self, *_):
            return None

    class Other:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Other())


def test_windows_across_blocks_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(win, "BLOCK", 8)
    steps = [s for s in range(1, 60) if s != 31]
    fr = spark.createDataFrame([(1, s, [float(s)]) for s in steps] + [(2, s, [0.0]) for s in range(1, 5)],
                               "traj int, step bigint, feat array<double>")
    got = {(r.traj, r.start): (r.x, r.y) for r in win.sample_windows(fr, 2, 4).collect()}
    want = [s for s in range(1, 55) if not set(range(s, s + 6)) & {31, 60}]
    assert sorted(got) == [(1, s) for s in want]
    assert all(v == ([[float(s)], [s + 1.0]], [[float(s + k)] for k in range(2, 6)]) for (_, s), v in got.items())


def test_salted_join_back_spreads_a_hot_key(spark):
    """Half of the rows on one key, no broadcast: no task gets more than a few
    percent of them."""
    from tidewater.operators.common import salted_join

    df = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    with_conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
                 "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        j = salted_join(df, stats, ["k"], ["id"])
        per_task = [r["n_rows"] for r in j.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n_rows")).collect()]
        assert j.filter("k = 0").select("n").distinct().collect()[0][0] == 20_000 and sum(per_task) == 40_000
        assert max(per_task) < 0.12 * 40_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_scratch_tables_can_be_cleared(spark):
    import glob

    from tidewater.operators.common import materialize
    from tidewater.session import checkpoint_dir, clear_scratch

    assert materialize(spark.range(3), "t").count() == 3
    here = f"{checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    assert glob.glob(f"{here}/t-*")
    clear_scratch(spark)
    assert not glob.glob(f"{here}/*")
