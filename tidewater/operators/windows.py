"""Dataset windows: sliding lookback/rollout samples, stacking, batching.

Frames are rows ``(key, step, feat ARRAY<DOUBLE>)`` with dense 1-based steps
per key (see ``sources.views.v_frames``). A window is the row
``(key, start, x ARRAY<ARRAY<DOUBLE>>, y ARRAY<ARRAY<DOUBLE>>)`` holding
``lookback`` input frames and ``rollout`` target frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.common import attach_scalars
from tidewater.operators.ordinal import ordinal


#: Steps in one block of :func:`sample_windows`.
BLOCK = 1024


def frame_features(df: DataFrame, cols: Sequence[str], out: str = "feat") -> DataFrame:
    """Pack channel columns into the ``feat`` array (channel order = ``cols``)."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def sample_windows(frames: DataFrame, lookback: int = 4, rollout: int = 16,
                   key: str = "traj", step: str = "step", feat: str = "feat") -> DataFrame:
    """WIN9: all complete windows with stride 1.

    Steps are cut into blocks of ``BLOCK``; the first ``span - 1`` frames of a
    block are copied into the one before, so every window lies whole in the
    block of its start. The shuffle is keyed by ``(key, block)``: a very long
    trajectory is spread over all tasks, a task's group is bounded by the block,
    and a frame is sent 1 + span / BLOCK times on average.
    """
    span = lookback + rollout
    block = F.floor((F.col(step) - 1) / BLOCK)
    early = F.when((F.pmod(F.col(step) - 1, F.lit(BLOCK)) < span - 1) & (block > 0), block - 1)
    dealt = frames.select(key, F.col(step).alias("_o"), F.col(feat).alias("_f"),
                          F.explode(F.array_compact(F.array(block, early))).alias("_blk"))
    g = dealt.groupBy(key, "_blk").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_o").alias("o"), F.col("_f").alias("f")))).alias("_fr"))
    g = g.where(F.size("_fr") >= span).select(
        key, "_blk", "_fr", F.explode(F.sequence(F.lit(0), F.size("_fr") - span)).alias("_i"))
    start = F.get("_fr", F.col("_i"))["o"]
    whole = F.get("_fr", F.col("_i") + (span - 1))["o"] == start + (span - 1)
    g = g.where(whole & (F.floor((start - 1) / BLOCK) == F.col("_blk")))

    def frames_of(first: int, n: int) -> Column:
        return F.transform(F.slice("_fr", F.col("_i") + 1 + first, F.lit(n)), lambda s: s["f"])

    return g.select(key, start.cast("bigint").alias("start"), frames_of(0, lookback).alias("x"),
                    frames_of(lookback, rollout).alias("y"))


def stack_lookback(x: Column | str) -> Column:
    """WIN10: flatten (lookback, feature) lookback-major: the last C entries are the
    newest frame."""
    x = F.col(x) if isinstance(x, str) else x
    return F.flatten(x)


def unstack_lookback(flat: Column | str, channels: int) -> Column:
    """WIN10: inverse of :func:`stack_lookback` for ``channels`` features per frame."""
    flat = F.col(flat) if isinstance(flat, str) else flat
    n = F.size(flat) / channels
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")),
                       lambda i: F.slice(flat, i * channels + 1, channels))


def shuffle_key(id_col: Column | str, seed: int = 0) -> Column:
    """A seeded permutation of non-negative integer ids: ``(id mod p) * a + seed
    mod p`` with p = 2^32 - 5. Plain 64-bit arithmetic (no overflow), so the
    same order can be reproduced in any SQL engine."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    p = 4294967291
    return F.pmod(F.pmod(c, F.lit(p)) * F.lit(1103515245) + F.lit(seed), F.lit(p))


def batches(df: DataFrame, size: int, order: Sequence[str], shuffle: bool = False,
            seed: int = 0, id_col: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """WIN11: cut rows into batches of ``size`` (the last may be short).

    Without shuffle rows keep ``order``; with shuffle they are ordered by
    :func:`shuffle_key` of ``id_col`` (ties by ``order``). Numbering uses the
    range-partitioned :func:`ordinal`, never a single-partition global window.
    Adds ``batch_id`` and ``slot`` (0-based, BIGINT).
    """
    sort_cols: list = list(order)
    if shuffle:
        if id_col is None:
            raise ValueError("shuffle needs an integer id_col")
        df = df.withColumn("_shuf", shuffle_key(id_col, seed))
        sort_cols = ["_shuf", *order]
    numbered = ordinal(df, list(by), sort_cols, out="_rn")
    out = (numbered.withColumn("batch_id", F.floor((F.col("_rn") - 1) / size).cast("bigint"))
                   .withColumn("slot", F.pmod(F.col("_rn") - 1, F.lit(size)).cast("bigint"))
                   .drop("_rn"))
    return out.drop("_shuf") if shuffle else out


def limit_batches(df: DataFrame, limit: int | float, by: Sequence[str] = ()) -> DataFrame:
    """WIN12: keep the first ``limit`` batches (int) or that fraction of batches
    (float in (0, 1], rounded up), per ``by`` group."""
    if isinstance(limit, int) and not isinstance(limit, bool):
        return df.where(F.col("batch_id") < limit)
    if not 0 < limit <= 1:
        raise ValueError("fraction must be in (0, 1]")
    by = list(by)
    nb = df.groupBy(*by).agg((F.max("batch_id") + 1).alias("_nb"))
    j = df.join(nb, by) if by else attach_scalars(df, nb)
    return (j.where(F.col("batch_id") < F.ceil(F.col("_nb") * F.lit(float(limit))))
             .drop("_nb"))
