"""Trajectory window and forecast-score queries over ``v_frames``.

Lookback 4, rollout 16, stride 1, as in the benchmark's test split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numeric import fixed, fixed_sql
from tidewater.operators import forecast as fc
from tidewater.operators import windows as win
from tidewater.plans.registry import register
from tidewater.plans.sql_views import with_views
from tidewater.sources.views import v_frames

L, R = 4, 16
SPAN = L + R

_WINDOWS_SQL = {
    "n": "SELECT traj, MAX(step) AS n FROM v_frames GROUP BY traj",
    "w": f"SELECT f.traj, f.step AS start FROM v_frames f JOIN n USING (traj) WHERE f.step + {SPAN - 1} <= n.n",
    "h": f"SELECT CAST(range AS BIGINT) AS h FROM range(1, {R + 1})",
}


def frame_windows(spark: SparkSession, sf_dir: str, channels=("value",)) -> DataFrame:
    fr = win.frame_features(v_frames(spark, sf_dir, tuple(channels)), list(channels))
    fr = fr.select("traj", "step", "feat")
    return win.sample_windows(fr, L, R)


# ---------------------------------------------------------------- flagship
FLAGSHIP_SQL = with_views(f"""
SELECT w.h AS horizon, {fixed_sql('AVG((b.value - a.value) * (b.value - a.value))')} AS mse,
       CAST(COUNT(*) AS BIGINT) AS n_windows
FROM (SELECT w.traj, w.start, h.h FROM w CROSS JOIN h) w
JOIN v_frames a ON a.traj = w.traj AND a.step = w.start + {L - 1}
JOIN v_frames b ON b.traj = w.traj AND b.step = w.start + {L - 1} + w.h
GROUP BY w.h
""", "v_frames", extra=_WINDOWS_SQL)


@register("fc_persistence_mse", FLAGSHIP_SQL, ops=("WIN9", "FC1", "FC5"))
def persistence_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: persistence forecast scored per horizon over every window."""
    w = frame_windows(spark, sf_dir).withColumn("pred", fc.persistence("x", R))
    return fc.step_mse(w).select("horizon", fixed("mse").alias("mse"), "n_windows")


# ---------------------------------------------------------------- WIN9
WIN9_SQL = with_views(f"""
SELECT w.traj, CAST(w.start AS BIGINT) AS start,
       {fixed_sql(f'MAX(CASE WHEN b.step = w.start THEN b.value END)')} AS x_first,
       {fixed_sql(f'MAX(CASE WHEN b.step = w.start + {L - 1} THEN b.value END)')} AS x_last,
       {fixed_sql(f'MAX(CASE WHEN b.step = w.start + {L} THEN b.value END)')} AS y_first,
       {fixed_sql(f'MAX(CASE WHEN b.step = w.start + {SPAN - 1} THEN b.value END)')} AS y_last,
       {fixed_sql(f'SUM(CASE WHEN b.step < w.start + {L} THEN b.value END)')} AS x_sum,
       {fixed_sql(f'SUM(CASE WHEN b.step >= w.start + {L} THEN b.value END)')} AS y_sum
FROM w JOIN v_frames b ON b.traj = w.traj AND b.step BETWEEN w.start AND w.start + {SPAN - 1}
GROUP BY w.traj, w.start
""", "v_frames", extra=_WINDOWS_SQL)


@register("win9_sample_windows", WIN9_SQL, ops=("WIN9",))
def sample_windows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frame_windows(spark, sf_dir)
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, f: acc + f[0])
    return w.select("traj", "start",
                    fixed(F.col("x")[0][0]).alias("x_first"), fixed(F.element_at("x", -1)[0]).alias("x_last"),
                    fixed(F.col("y")[0][0]).alias("y_first"), fixed(F.element_at("y", -1)[0]).alias("y_last"),
                    fixed(sums(F.col("x"))).alias("x_sum"), fixed(sums(F.col("y"))).alias("y_sum"))


# ---------------------------------------------------------------- WIN10
WIN10_SQL = with_views(f"""
SELECT w.traj, CAST(w.start AS BIGINT) AS start, CAST(2 * (b.step - w.start) + c.c AS BIGINT) AS pos,
       {fixed_sql('CASE WHEN c.c = 0 THEN b.value ELSE CAST(b.event_id AS DOUBLE) END')} AS v
FROM w JOIN v_frames b ON b.traj = w.traj AND b.step BETWEEN w.start AND w.start + {L - 1}
CROSS JOIN (SELECT range AS c FROM range(0, 2)) c
""", "v_frames", extra=_WINDOWS_SQL)


@register("win10_stack_lookback", WIN10_SQL, ops=("WIN10",))
def stack_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels (value, event_id) stacked lookback-major; long output."""
    w = frame_windows(spark, sf_dir, channels=("value", "event_id"))
    st = w.select("traj", "start", win.stack_lookback("x").alias("flat"))
    return st.select("traj", "start", F.posexplode("flat").alias("pos", "v")).select(
        "traj", "start", F.col("pos").cast("bigint").alias("pos"), fixed("v").alias("v"))


# ---------------------------------------------------------------- WIN11 / WIN12
BATCH, SEED = 32, 7
_ID = "traj * 100003 + start"

WIN11_SQL = with_views(f"""
SELECT traj, start, CAST((rn - 1) // {BATCH} AS BIGINT) AS batch_id, CAST((rn - 1) % {BATCH} AS BIGINT) AS slot
FROM (SELECT traj, CAST(start AS BIGINT) AS start,
             ROW_NUMBER() OVER (ORDER BY ((({_ID}) % 4294967291) * 1103515245 + {SEED}) % 4294967291,
                                         traj, start) AS rn
      FROM w) t
""", "v_frames", extra=_WINDOWS_SQL)


def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frame_windows(spark, sf_dir).select("traj", "start")
    w = w.withColumn("_id", F.col("traj") * 100003 + F.col("start"))
    return win.batches(w, BATCH, ["traj", "start"], shuffle=True, seed=SEED, id_col="_id").drop("_id")


@register("win11_batches", WIN11_SQL, ops=("WIN11",))
def batches_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled_batches(spark, sf_dir)


WIN12_SQL = with_views(f"""
SELECT batch_id, CAST(COUNT(*) AS BIGINT) AS n_rows FROM (
  SELECT CAST((rn - 1) // {BATCH} AS BIGINT) AS batch_id, MAX(rn) OVER () AS total
  FROM (SELECT ROW_NUMBER() OVER (ORDER BY ((({_ID}) % 4294967291) * 1103515245 + {SEED}) % 4294967291,
                                  traj, start) AS rn FROM w) t) b
WHERE batch_id < CEIL(CEIL(total / {BATCH}.0) * 0.25)
GROUP BY batch_id
""", "v_frames", extra=_WINDOWS_SQL)


@register("win12_limit_batches", WIN12_SQL, ops=("WIN12",))
def limit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = win.limit_batches(shuffled_batches(spark, sf_dir), 0.25)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


# ---------------------------------------------------------------- FC2
FC2_SQL = with_views(f"""
SELECT w.h AS horizon, {fixed_sql('AVG(b.value * b.value)')} AS mse, CAST(COUNT(*) AS BIGINT) AS n_windows
FROM (SELECT w.traj, w.start, h.h FROM w CROSS JOIN h) w
JOIN v_frames b ON b.traj = w.traj AND b.step = w.start + {L - 1} + w.h
GROUP BY w.h
""", "v_frames", extra=_WINDOWS_SQL)


@register("fc2_zero_mse", FC2_SQL, ops=("FC2", "FC5"))
def zero_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frame_windows(spark, sf_dir).withColumn("pred", fc.zero("x", R))
    return fc.step_mse(w).select("horizon", fixed("mse").alias("mse"), "n_windows")


# ---------------------------------------------------------------- FC3
FC3_SQL = with_views(f"""
SELECT w.h AS horizon,
       {fixed_sql('AVG(POWER(a.value + w.h * (a.value - p.value) - b.value, 2))', 4)} AS mse,
       CAST(COUNT(*) AS BIGINT) AS n_windows
FROM (SELECT w.traj, w.start, h.h FROM w CROSS JOIN h) w
JOIN v_frames a ON a.traj = w.traj AND a.step = w.start + {L - 1}
JOIN v_frames p ON p.traj = w.traj AND p.step = w.start + {L - 2}
JOIN v_frames b ON b.traj = w.traj AND b.step = w.start + {L - 1} + w.h
GROUP BY w.h
""", "v_frames", extra=_WINDOWS_SQL)


@register("fc3_rollout_linear", FC3_SQL, ops=("FC3", "FC5", "EX4"))
def rollout_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autoregressive rollout of a linear-extrapolation step, scored per horizon."""
    w = frame_windows(spark, sf_dir).withColumn("pred", fc.rollout("x", fc.linear_step, R, L))
    return fc.step_mse(w).select("horizon", fixed("mse", 4).alias("mse"), "n_windows")


# ---------------------------------------------------------------- FC6 / FC7
FC67_SQL = with_views(f"""
SELECT {fixed_sql('SUM(sae) / SUM(n)')} AS l1, {fixed_sql('AVG(SQRT(sse / n))')} AS rmse_batch,
       {fixed_sql('SQRT(SUM(sse) / SUM(n))')} AS rmse_global, CAST(COUNT(*) AS BIGINT) AS n_batches
FROM (
  SELECT (rn - 1) // {BATCH} AS batch_id, SUM(se) AS sse, SUM(ae) AS sae, COUNT(*) AS n
  FROM (
    SELECT ROW_NUMBER() OVER (ORDER BY w.traj, w.start) AS rn,
           (b.value - a.value) * (b.value - a.value) AS se, ABS(b.value - a.value) AS ae
    FROM w JOIN v_frames a ON a.traj = w.traj AND a.step = w.start + {L - 1}
           JOIN v_frames b ON b.traj = w.traj AND b.step = w.start + {SPAN - 1}) t
  GROUP BY 1) g
""", "v_frames", extra=_WINDOWS_SQL)


@register("fc67_last_step_scores", FC67_SQL, ops=("FC6", "FC7", "WIN11"))
def last_scores_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence at the last horizon: L1 and RMSE per batch of 32 (test split
    order, no shuffle) versus over all windows."""
    w = frame_windows(spark, sf_dir).withColumn("pred", fc.persistence("x", R))
    # two numbers a window go into the numbering, not its frames
    b = win.batches(fc.last_step_errors(w, ["traj", "start"]), BATCH, ["traj", "start"])
    s = fc.last_step_scores(b)
    return s.select(fixed("l1").alias("l1"), fixed("rmse_batch").alias("rmse_batch"),
                    fixed("rmse_global").alias("rmse_global"), "n_batches")


# ---------------------------------------------------------------- FC8
FC8_SQL = with_views(f"""
SELECT CAST(1 AS BIGINT) AS horizon,
       {fixed_sql('AVG(POWER(a.value + (a.value - o.value) / 3.0 - b.value, 2))')} AS mse,
       CAST(COUNT(*) AS BIGINT) AS n_windows
FROM w JOIN v_frames a ON a.traj = w.traj AND a.step = w.start + {L - 1}
       JOIN v_frames o ON o.traj = w.traj AND o.step = w.start
       JOIN v_frames b ON b.traj = w.traj AND b.step = w.start + {L}
""", "v_frames", extra=_WINDOWS_SQL)


@register("fc8_residual_update", FC8_SQL, ops=("FC8",))
def residual_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step residual forecast: newest frame + mean lookback increment."""
    w = frame_windows(spark, sf_dir)
    newest, oldest = F.element_at("x", -1), F.element_at("x", 1)
    inc = F.zip_with(newest, oldest, lambda a, o: (a - o) / (L - 1))
    w = w.withColumn("pred", F.array(fc.residual_update(newest, inc)))
    w = w.withColumn("y", F.slice("y", 1, 1))
    return fc.step_mse(w).select("horizon", fixed("mse").alias("mse"), "n_windows")
