"""Voxels, curve layouts, serialised pooling, patches and sparse stencils.

A voxel table is ``(batch, point_id, ix, iy, iz, feats...)``; ``batch`` is
the cloud. Whole-table constants (the batch-wide minimum, the curve depth,
the patch size) are one-row aggregates used as scalar subqueries -- never a
join and never a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import curves as cv
from tidewater.operators.common import attach_scalars
from tidewater.operators.ordinal import ordinal, running_sum

REDUCERS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def voxelise(points: DataFrame, grid_size: float = 0.01, x: str = "x", y: str = "y",
             z: str | None = None) -> DataFrame:
    """PC1: ``trunc((coord - min) / grid_size)`` with the minimum over the
    whole table (all clouds), 2-D input gets iz = 0. Adds ix, iy, iz (INT)."""
    aggs = [F.min(x).alias("_mx"), F.min(y).alias("_my")] + ([F.min(z).alias("_mz")] if z else [])
    mins = points.agg(*aggs)
    p = attach_scalars(points, mins)
    v = lambda c, m: F.floor((F.col(c) - F.col(m)) / F.lit(float(grid_size))).cast("int")
    p = p.withColumn("ix", v(x, "_mx")).withColumn("iy", v(y, "_my"))
    p = p.withColumn("iz", v(z, "_mz") if z else F.lit(0))
    return p.drop("_mx", "_my", "_mz")


def curve_depth(vox: DataFrame, batch: str = "batch") -> DataFrame:
    """PC2: one row (max_coord, depth, batch_bits) with depth = bit length of
    the largest voxel coordinate; fails when depth > 16 or the combined key
    would not fit 63 bits."""
    m = vox.agg(F.greatest(F.max("ix"), F.max("iy"), F.max("iz")).cast("bigint").alias("max_coord"),
                F.max(batch).cast("bigint").alias("_mb"))
    m = m.withColumn("depth", cv.bit_length("max_coord")).withColumn("batch_bits", cv.bit_length("_mb"))
    ok = (F.col("depth") <= cv.MAX_DEPTH) & (F.col("depth") * 3 + F.col("batch_bits") <= 63)
    return m.select("max_coord", F.when(ok, F.col("depth"))
                    .otherwise(F.raise_error(F.lit("curve depth out of range"))).cast("bigint").alias("depth"),
                    "batch_bits")


def encode(vox: DataFrame, order: str = "z", depth: Column | str = "depth", out: str = "code") -> DataFrame:
    """PC3 / PC5 / PC8 key of one order: ``z``, ``z-trans``, ``hilbert``,
    ``hilbert-trans`` (``-trans`` swaps x and y)."""
    xs, ys = ("iy", "ix") if order.endswith("trans") else ("ix", "iy")
    if order.startswith("z"):
        return vox.withColumn(out, cv.z_order(xs, ys, "iz"))
    if order.startswith("hilbert"):
        return cv.with_hilbert(vox, xs, ys, "iz", depth, out)
    raise ValueError(f"unknown order {order}")


def with_depth(vox: DataFrame, batch: str = "batch") -> DataFrame:
    return attach_scalars(vox, curve_depth(vox, batch).select("depth"))


def cluster_points(vox: DataFrame, order: str = "z", batch: str = "batch", partitions: int | None = None,
                   path: str | None = None) -> DataFrame:
    """PC3 / PC5 / PC9: add ``code`` = curve key OR (batch << 3 depth), lay
    the table out in code order (range partitioning + local sort) and write
    it as Parquet (default: a fresh folder under the shared checkpoint
    folder). The returned scan is clustered on ``code``: range predicates on
    it are pushed to the Parquet reader and skip row groups."""
    from tidewater.session import scratch_path
    v = with_depth(vox, batch)
    v = encode(v, order, "depth", "_key")
    v = v.withColumn("code", cv.with_batch("_key", batch, "depth")).drop("_key")
    n = partitions or int(vox.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = path or scratch_path(vox.sparkSession, f"clustered-{order}")
    v.repartitionByRange(n, "code").sortWithinPartitions("code").write.mode("overwrite").parquet(out)
    return vox.sparkSession.read.parquet(out)


def curve_range(clustered: DataFrame, lo: int, hi: int, order: str = "hilbert", batch: str = "batch") -> DataFrame:
    """PC6: rows of a :func:`cluster_points` table with ``lo <= code < hi``
    (pushed down to the clustered Parquet scan) and their cells recovered
    from the key (``cx, cy, cz``)."""
    sub = clustered.where((F.col("code") >= lo) & (F.col("code") < hi))
    sub = sub.withColumn("_key", F.col("code").bitwiseXOR(cv.shift_left(batch, F.lit(3) * F.col("depth"))))
    if order.startswith("hilbert"):
        out = cv.with_hilbert_decoded(sub, "_key", "depth", ("cx", "cy", "cz"))
    else:
        out = sub.select("*", *[cv.deinterleave3("_key", a).alias(n) for a, n in enumerate(("cx", "cy", "cz"))])
    if order.endswith("trans"):
        out = out.withColumnRenamed("cx", "_t").withColumnRenamed("cy", "cx").withColumnRenamed("_t", "cy")
    return out.drop("_key")


def serial_order(df: DataFrame, code: str, by: Sequence[str] = ("batch",), id_col: str = "point_id",
                 out: str = "pos") -> DataFrame:
    """WIN13: 0-based position of each row in ``code`` order (ties by id)
    within ``by``; the (position, id) relation is both the order and its
    inverse. Uses the range-partitioned :func:`ordinal`."""
    o = ordinal(df, list(by), [code, id_col], out=out)
    return o.withColumn(out, F.col(out) - 1)


def serialise(vox: DataFrame, orders: Sequence[str] = ("z", "z-trans", "hilbert", "hilbert-trans"),
              batch: str = "batch", id_col: str = "point_id") -> DataFrame:
    """PC8: one key column per order (``code_<order>``) and its position
    (``pos_<order>``) over the whole table (keys carry the batch bits, so
    positions group clouds)."""
    v = with_depth(vox, batch)
    for o in orders:
        name = o.replace("-", "_")
        v = encode(v, o, "depth", "_k").withColumn(f"code_{name}", cv.with_batch("_k", batch, "depth")).drop("_k")
    v = v.checkpoint(eager=True)
    for o in orders:
        name = o.replace("-", "_")
        v = serial_order(v, f"code_{name}", [], id_col, f"pos_{name}")
    return v


def pool_shift(stride: int) -> int:
    """Bits per axis removed by a pooling stride (bit length of stride - 1)."""
    return max(stride - 1, 0).bit_length()


def serial_pool(coded: DataFrame, stride: int, feats: Sequence[str], reduce: str = "max",
                x: str = "x", y: str = "y", batch: str = "batch") -> DataFrame:
    """PC10 / AGG11: group points by ``code >> 3p`` (p from the stride, 0 when
    deeper than the depth), reduce features, mean position, voxel >> p and
    depth - p per cluster. Batch, shifted voxel and shifted code are constant
    inside a cluster. Partial + final hash aggregate."""
    if reduce not in REDUCERS:
        raise ValueError(f"reduce must be one of {sorted(REDUCERS)}")
    p = pool_shift(stride)
    shift = F.when(F.lit(p) > F.col("depth"), F.lit(0)).otherwise(F.lit(p))
    c = coded.withColumn("_p", shift)
    c = c.withColumn("pooled_code", cv.shift_right("code", F.lit(3) * F.col("_p")))
    agg = c.groupBy("pooled_code").agg(
        F.min(batch).alias(batch), F.count(F.lit(1)).cast("bigint").alias("n"),
        *[REDUCERS[reduce](f).alias(f) for f in feats],
        F.avg(x).alias(x), F.avg(y).alias(y),
        F.min(cv.shift_right("ix", "_p")).alias("ix"), F.min(cv.shift_right("iy", "_p")).alias("iy"),
        F.min(cv.shift_right("iz", "_p")).alias("iz"), F.min(F.col("depth") - F.col("_p")).alias("depth"))
    return agg


def segment_reduce(df: DataFrame, key: Sequence[str], feats: Sequence[str], reduce: str,
                   coords: Sequence[str] = ()) -> DataFrame:
    """AGG11 / EX3: reduce features by cluster key with a named reducer; coordinates
    are always averaged."""
    if reduce not in REDUCERS:
        raise ValueError(f"reduce must be one of {sorted(REDUCERS)}")
    return df.groupBy(*key).agg(*[REDUCERS[reduce](f).alias(f) for f in feats],
                                *[F.avg(c).alias(c) for c in coords])


def unique_clusters(df: DataFrame, code: str = "code", by: Sequence[str] = ("batch",)) -> DataFrame:
    """AGG12: unique codes per batch with inverse (0-based dense index,
    ``cluster``) and counts. Distinct codes are reduced first (partial
    aggregate) and numbered with the range-partitioned ordinal."""
    by = list(by)
    counts = df.groupBy(*by, code).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    idx = ordinal(counts, by, [code], out="cluster").withColumn("cluster", F.col("cluster") - 1)
    return idx


def batch_counts(df: DataFrame, batch: str = "batch") -> DataFrame:
    """AGG13: counts per batch (bincount) and the offsets they imply
    (``start`` inclusive, ``end`` exclusive), via a distributed running sum
    over the per-batch table."""
    c = df.groupBy(batch).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    c = running_sum(c, [], [batch], "n", out="end").withColumn("end", F.col("end").cast("bigint"))
    return c.withColumn("start", (F.col("end") - F.col("n")).cast("bigint"))


def batch_ids(offsets: DataFrame, batch: str = "batch", chunk: int = 1 << 20) -> DataFrame:
    """AGG13 inverse: one row per global index with its batch. Index ranges
    are first cut into chunks of ``chunk`` and spread by (batch, chunk), so a
    huge batch is expanded by many tasks."""
    starts = offsets.where(F.col("n") > 0).select(
        batch, "end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(chunk).cast("bigint"))).alias("_cs"))
    starts = starts.repartition(batch, "_cs")
    ids = starts.select(batch, F.explode(F.sequence(
        "_cs", F.least(F.col("_cs") + chunk, F.col("end")) - 1)).alias("index"))
    return ids.withColumn("index", F.col("index").cast("bigint"))


def sparse_shape(vox: DataFrame, pad: int = 96) -> DataFrame:
    """AGG16: per-axis maximum voxel index plus ``pad``."""
    return vox.agg((F.max("ix") + pad).cast("bigint").alias("sx"), (F.max("iy") + pad).cast("bigint").alias("sy"),
                   (F.max("iz") + pad).cast("bigint").alias("sz"))


def voxel_stencil(vox: DataFrame, value: str, weights: dict[tuple[int, int, int], float],
                  batch: str = "batch") -> DataFrame:
    """JN10: submanifold stencil: for every occupied voxel, sum of
    weight(offset) * value at occupied neighbours voxel + offset. The offset
    table is an array literal (bounded by the kernel) exploded on the output
    side; neighbours are found by an equi-join on (batch, ix, iy, iz)."""
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz"),
                              F.lit(float(w)).alias("w")) for (dx, dy, dz), w in weights.items()])
    out = vox.select(batch, "ix", "iy", "iz", F.explode(offs).alias("_o"))
    out = out.select(batch, "ix", "iy", "iz", (F.col("ix") + F.col("_o.dx")).alias("_nx"),
                     (F.col("iy") + F.col("_o.dy")).alias("_ny"), (F.col("iz") + F.col("_o.dz")).alias("_nz"),
                     F.col("_o.w").alias("_w"))
    nb = vox.select(F.col(batch).alias("_b"), F.col("ix").alias("_nx"), F.col("iy").alias("_ny"),
                    F.col("iz").alias("_nz"), F.col(value).alias("_v"))
    j = out.join(nb, (out[batch] == nb["_b"]) & (out["_nx"] == nb["_nx"]) & (out["_ny"] == nb["_ny"]) &
                 (out["_nz"] == nb["_nz"]))
    return j.groupBy(out[batch], out["ix"], out["iy"], out["iz"]).agg(F.sum(F.col("_w") * F.col("_v")).alias("out"))


def unpool(parent: DataFrame, pooled: DataFrame, key: str, feats: Sequence[str]) -> DataFrame:
    """JN11: add each cluster's pooled features back to its parent points."""
    p = pooled.select(key, *[F.col(f).alias(f"_pool_{f}") for f in feats])
    j = parent.join(p, key, "left")
    for f in feats:
        j = j.withColumn(f, F.col(f) + F.coalesce(F.col(f"_pool_{f}"), F.lit(0.0))).drop(f"_pool_{f}")
    return j


def patches(ordered: DataFrame, k_max: int, batch: str = "batch", pos: str = "pos") -> DataFrame:
    """WIN15: cut each batch's serial order into patches of K = min(smallest
    batch size, k_max). A batch with n > K and n % K != 0 is padded to a
    multiple of K; pad slots of the last patch copy the same slots of the
    previous patch. Returns (batch, pos, src_pos, patch, is_pad, K)."""
    n = ordered.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    k = n.agg(F.least(F.min("_n"), F.lit(k_max)).cast("bigint").alias("K"))
    real = ordered.select(batch, F.col(pos).cast("bigint").alias(pos))
    real = real.select(batch, pos, F.col(pos).alias("src_pos"), F.lit(False).alias("is_pad"))
    nk = attach_scalars(n, k)
    padded_to = F.ceil(F.col("_n") / F.col("K")) * F.col("K")
    pads = (nk.where((F.col("_n") > F.col("K")) & (padded_to > F.col("_n")))
              .select(batch, "K", F.explode(F.sequence(F.col("_n").cast("bigint"), (padded_to - 1).cast("bigint"))).alias(pos))
              .select(batch, pos, (F.col(pos) - F.col("K")).alias("src_pos"), F.lit(True).alias("is_pad")))
    allp = attach_scalars(real.unionByName(pads), k)
    return allp.withColumn("patch", F.floor(F.col(pos) / F.col("K")).cast("bigint"))


def patch_rel_pos(patched: DataFrame, bound: int, batch: str = "batch") -> DataFrame:
    """JN12: relative voxel offset of every ordered pair inside a patch,
    clamped to +-bound and shifted by ``bound`` to a table index. Patches
    hold K points (K bounded by ``k_max``), so the pairs per patch are
    bounded. Expects (batch, patch, pos, ix, iy, iz)."""
    a = patched.select(batch, "patch", F.col("pos").alias("pos_i"), F.col("ix").alias("ax"),
                       F.col("iy").alias("ay"), F.col("iz").alias("az"))
    b = patched.select(batch, "patch", F.col("pos").alias("pos_j"), F.col("ix").alias("bx"),
                       F.col("iy").alias("by"), F.col("iz").alias("bz"))
    j = a.join(b, [batch, "patch"])
    clamp = lambda d: (F.greatest(F.least(d, F.lit(bound)), F.lit(-bound)) + bound).cast("bigint")
    return j.select(batch, "patch", "pos_i", "pos_j", clamp(F.col("ax") - F.col("bx")).alias("rx"),
                    clamp(F.col("ay") - F.col("by")).alias("ry"), clamp(F.col("az") - F.col("bz")).alias("rz"))


def patch_offset_counts(patched: DataFrame, bound: int, batch: str = "batch",
                        axes: Sequence[str] = ("ix", "iy", "iz")) -> DataFrame:
    """JN12, as counts: how many ordered pairs of a patch have each clamped
    offset on each axis -> (batch, patch, axis, index, pairs), index 0..2 bound
    as in :func:`patch_rel_pos`: at most (2 bound + 1) rows for a patch and axis.

    No pairs are made. A patch's coordinates on an axis are counted, and the
    offsets inside the bound are the correlation of those counts with
    themselves: each distinct coordinate meets only the 2 bound - 1 next to it.
    What is left of the K^2 pairs is clamped, half of it on either side, since
    every pair is there in both orders. Expects (batch, patch, axes...); a null
    coordinate takes part in no pair of its axis."""
    by = [batch, "patch", "axis"]
    points = patched.select(batch, "patch", F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(a).cast("bigint").alias("v")) for a in axes])).alias("_a"))
    points = points.select(batch, "patch", F.col("_a.axis").alias("axis"), F.col("_a.v").alias("v")).where(F.col("v").isNotNull())
    counts = points.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("h"))
    total = points.groupBy(*by).agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("_all"))
    near = counts.select(*by, "h", "v", F.explode(F.sequence(F.lit(1 - bound), F.lit(bound - 1))).alias("d")) if bound > 0 else None
    if near is None:
        return total.select(*by, F.lit(0).cast("bigint").alias("index"), F.col("_all").alias("pairs"))
    other = counts.select(*by, F.col("v").alias("w"), F.col("h").alias("g"))
    inside = near.withColumn("w", F.col("v") - F.col("d")).join(other, [*by, "w"]).groupBy(*by, "d").agg(F.sum(F.col("h") * F.col("g")).alias("pairs"))
    clamped = inside.groupBy(*by).agg(F.sum("pairs").alias("_in")).join(total, by).withColumn(
        "pairs", ((F.col("_all") - F.col("_in")) / 2).cast("bigint")).where("pairs > 0")
    ends = clamped.select(*by, F.explode(F.array(F.lit(-bound), F.lit(bound))).alias("d"), "pairs")
    return inside.unionByName(ends).select(*by, (F.col("d") + bound).cast("bigint").alias("index"), F.col("pairs").cast("bigint").alias("pairs"))


def octree_rollup(coded: DataFrame, level: int, feats: Sequence[str], key: str = "key",
                  by: Sequence[str] = ("batch",)) -> DataFrame:
    """PC4: group points by the key prefix ``key >> 3 level``; count and mean
    features per node; the node's cell coordinates at that level are decoded
    from the prefix (z-order)."""
    by = list(by)
    g = coded.groupBy(*by, F.shiftright(F.col(key), 3 * level).alias("node")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in feats])
    return g.select("*", *[cv.deinterleave3("node", a).alias(nm) for a, nm in enumerate(("cx", "cy", "cz"))])
