"""Derived views that give the driver tables the shapes the operators consume.

- ``v_runs``   leaderboard results: model x domain x equation x resolution
- ``v_frames`` trajectories: one frame per event, numbered per trajectory
- ``v_points`` point clouds: label = cloud, first four embedding dims
- ``v_grid``   15 x 15 periodic lattice per sample
- ``v_log``    a metric log with missing values

Each view is written the way a Spark user would write it against large inputs:
aggregate before joining, number rows without a per-group task, and prune
columns at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.ordinal import ordinal
from tidewater.sources.tables import table

GRID_N = 15


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result row per (model, domain, equation, resolution); metrics are
    means (exact decimal sums divided by the count).

    lineitem is reduced per (part, status, flag) before the join with part, so
    the join and its shuffle see one row per part combination instead of one
    per line, and a hot part collapses in the map-side partial aggregate.
    """
    dec = lambda c, p=15: F.col(c).cast(f"decimal({p},2)")
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_partkey", "l_linestatus", "l_returnflag")
          .agg(F.sum(dec("l_discount")).alias("s_disc"), F.sum(dec("l_quantity")).alias("s_qty"),
               F.sum(dec("l_extendedprice", 18)).alias("s_price"), F.count(F.lit(1)).alias("n")))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey)
    g = (j.groupBy(F.col("p_brand").alias("model"),
                   F.when(F.col("l_linestatus") == "F", "grid").otherwise("cloud").alias("domain"),
                   F.col("p_type").alias("equation"),
                   F.col("l_returnflag").alias("resolution"))
          .agg(F.sum("s_disc").alias("s_disc"), F.sum("s_qty").alias("s_qty"),
               F.sum("s_price").alias("s_price"), F.sum("n").alias("n")))
    # sums are exact decimals, so every engine and every summation order
    # reaches the same doubles below (ties such as a loss of exactly 2.0 stay ties)
    d = lambda c: F.col(c).cast("double")
    return g.select("model", "domain", "equation", "resolution",
                    (d("s_disc") * 40 / F.col("n")).alias("loss1"),
                    (d("s_qty") / F.col("n") / 12).alias("loss16"),
                    (d("s_price") / F.col("n")).alias("test_time"),
                    F.col("n").cast("bigint").alias("n"))


def v_frames(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("kind", "value", "event_id")) -> DataFrame:
    """Frames (traj, step, columns...) with kind, value, event_id available;
    step is 1-based in (ts, event_id) order per trajectory, numbered by
    :func:`ordinal` so that one long trajectory is spread over many tasks.
    Only the requested columns are carried into the numbering (it is
    checkpointed, and pruning cannot reach past a checkpoint)."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("traj"), F.col("event_type").alias("kind"), "value", "event_id", "ts")
    keep = ["traj", *dict.fromkeys([*columns, "event_id", "ts"])]
    return ordinal(ev.select(*keep), ["traj"], ["ts", "event_id"], out="step").select(
        "traj", *columns, "step")


def v_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (cloud, point_id, x, y, f1, f2) with x, y in [0, 1]."""
    e = table(spark, sf_dir, "embeddings")
    emb = F.col("embedding")
    return e.select(F.col("label").alias("cloud"), F.col("vec_id").alias("point_id"),
                    ((emb[0].cast("double") + 1) / 2).alias("x"),
                    ((emb[1].cast("double") + 1) / 2).alias("y"),
                    emb[2].cast("double").alias("f1"), emb[3].cast("double").alias("f2"))


def v_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (sample_id, gx, gy, value) of a 15 x 15 lattice per return flag."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("sample_id"),
                       F.pmod(F.col("l_partkey"), F.lit(GRID_N)).cast("int").alias("gx"),
                       F.pmod(F.col("l_suppkey"), F.lit(GRID_N)).cast("int").alias("gy"))
              .agg(F.sum(F.col("l_quantity").cast("decimal(15,2)")).cast("double").alias("_s"),
                   F.count(F.lit(1)).alias("_n"))
              .select("sample_id", "gx", "gy", (F.col("_s") / F.col("_n")).alias("value")))


def v_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric log rows (run, epoch, seq, val_loss, train_step_ms); val_loss is
    missing for status P."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.pmod(F.col("o_custkey"), F.lit(50)).cast("int").alias("run"),
        (F.year("o_orderdate") - 1994).alias("epoch"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice")).alias("val_loss"),
        (F.col("o_totalprice") / 1000).alias("train_step_ms"))
