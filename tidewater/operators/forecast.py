"""Baseline forecasts, autoregressive rollout and per-horizon scores.

Windows come from :func:`tidewater.operators.windows.sample_windows`:
``x`` holds the lookback frames (oldest first), ``y`` the targets; a
prediction ``pred`` has the shape of ``y``. Everything is a column
expression evaluated inside the window row, so no step adds a shuffle until
scores are aggregated (partial + final aggregate per horizon).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def persistence(x: Column | str, horizon: int) -> Column:
    """FC1: repeat the newest input frame for every target step."""
    return F.array_repeat(F.element_at(_c(x), -1), horizon)


def zero(x: Column | str, horizon: int) -> Column:
    """FC2: zeros with the shape of ``horizon`` frames."""
    newest = F.element_at(_c(x), -1)
    return F.array_repeat(F.transform(newest, lambda v: v * 0.0), horizon)


def linear_step(buf: Column) -> Column:
    """One-step predictor: linear extrapolation of the two newest frames."""
    return F.zip_with(F.element_at(buf, -1), F.element_at(buf, -2), lambda a, b: 2 * a - b)


def rollout(x: Column | str, step_fn: Callable[[Column], Column], steps: int,
            lookback: int) -> Column:
    """FC3 / EX4: autoregressive rollout: predict, drop the oldest frame, append the
    prediction, repeat ``steps`` times. ``step_fn`` maps the lookback buffer
    (ARRAY<ARRAY<DOUBLE>>) to the next frame. Runs as one higher-order
    ``aggregate`` per row."""
    x = _c(x)

    def advance(seq: Column, _i: Column) -> Column:
        buf = F.slice(seq, -lookback, lookback)
        return F.concat(seq, F.array(step_fn(buf)))

    full = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, advance)
    return F.slice(full, lookback + 1, steps)


def residual_update(newest: Column, increment: Column) -> Column:
    """FC8: next frame = newest frame + increment (element-wise)."""
    return F.zip_with(newest, increment, lambda a, d: a + d)


def _frame_sqerr(p: Column, t: Column) -> Column:
    """Mean over channels of the squared error between two frames."""
    s = F.aggregate(F.zip_with(p, t, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return s / F.size(p)


def _frame_abserr(p: Column, t: Column) -> Column:
    s = F.aggregate(F.zip_with(p, t, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return s / F.size(p)


def step_errors(windows: DataFrame, pred: str = "pred", target: str = "y",
                keep: Sequence[str] = ()) -> DataFrame:
    """Long table of per-window, per-horizon errors: (keep..., horizon, se, ae)."""
    errs = F.zip_with(_c(pred), _c(target),
                      lambda p, t: F.struct(_frame_sqerr(p, t).alias("se"), _frame_abserr(p, t).alias("ae")))
    return (windows.select(*keep, F.posexplode(errs).alias("_h", "_e"))
                   .select(*keep, (F.col("_h") + 1).cast("bigint").alias("horizon"),
                           F.col("_e.se").alias("se"), F.col("_e.ae").alias("ae")))


def step_mse(windows: DataFrame, pred: str = "pred", target: str = "y") -> DataFrame:
    """FC5: MSE for every horizon: (horizon, mse, n_windows). The headline number
    of a run is the last horizon."""
    e = step_errors(windows, pred, target)
    return e.groupBy("horizon").agg(F.avg("se").alias("mse"),
                                    F.count(F.lit(1)).cast("bigint").alias("n_windows"))


def last_step_errors(windows: DataFrame, keep: Sequence[str], pred: str = "pred", target: str = "y") -> DataFrame:
    """(keep..., se, ae) of each window at the last horizon."""
    p, t = F.element_at(_c(pred), -1), F.element_at(_c(target), -1)
    return windows.select(*keep, _frame_sqerr(p, t).alias("se"), _frame_abserr(p, t).alias("ae"))


def last_step_scores(errors: DataFrame, batch: str = "batch_id") -> DataFrame:
    """FC6 / FC7: scores of :func:`last_step_errors`: L1, RMSE averaged over
    batches (sqrt of each batch's MSE, then mean, as logged per batch) and RMSE
    over all windows."""
    per_batch = errors.groupBy(batch).agg(F.sqrt(F.avg("se")).alias("rmse_b"), F.sum("se").alias("sse"),
                                          F.sum("ae").alias("sae"), F.count(F.lit(1)).alias("n"))
    return per_batch.agg(
        (F.sum("sae") / F.sum("n")).alias("l1"),
        F.avg("rmse_b").alias("rmse_batch"),
        F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse_global"),
        F.count(F.lit(1)).cast("bigint").alias("n_batches"))
