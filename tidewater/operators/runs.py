"""Run-metric warehouse: run names, metric selection, per-run summaries,
checkpoint selection and accelerator-hour accounting.

Logs are kept long: ``(run, ord, metric, value)`` with ``ord`` an explicit
row order (file, row) so "first value" is well defined. Every per-run result
is a grouped aggregate (``min_by`` / ``max_by`` / ``avg`` / ``stddev_samp``),
partial on the map side, so a run with a huge log is never one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIP_TOKENS = ("step", "epoch", "val_loss", "train_loss")


# ------------------------------------------------------------ names (PRJ1-PRJ4)
def parse_run_name(name: Column | str) -> Column:
    """PRJ1: ``<dataset>_<model>:<equation>:<resolution>:<v1>:<v2>`` ->
    struct(dataset, model, equation, resolution, version). The model is one or
    two ``_`` tokens after the dataset, lower-cased; version = ``v1:v2``. Any
    other token count gives a NULL struct."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.split(name, ":")
    head = F.split(parts[0], "_")
    model = F.when(F.size(head) == 3, F.concat_ws("_", head[1], head[2])).when(F.size(head) == 2, head[1])
    ok = (F.size(parts) == 5) & model.isNotNull()
    s = F.struct(head[0].alias("dataset"), F.lower(model).alias("model"), parts[1].alias("equation"),
                 parts[2].alias("resolution"), F.concat_ws(":", parts[3], parts[4]).alias("version"))
    return F.when(ok, s)


def epoch_bucket(epochs: Column | str) -> Column:
    """PRJ2: >= 10 -> 10, >= 3 -> 3, otherwise missing."""
    e = F.col(epochs) if isinstance(epochs, str) else epochs
    return F.when(e >= 10, F.lit(10)).when(e >= 3, F.lit(3)).cast("bigint")


def is_metric_name(name: str) -> bool:
    """PRJ3 rule for one column name: drop names containing step, epoch,
    val_loss or train_loss unless they contain train_step; drop exactly
    ``test_loss``."""
    if any(t in name for t in SKIP_TOKENS) and "train_step" not in name:
        return False
    return name != "test_loss"


def metric_columns(df: DataFrame) -> list[str]:
    """PRJ3: the metric columns of a wide log, by name."""
    return [c for c in df.columns if is_metric_name(c)]


def metric_filter(name: Column | str) -> Column:
    """PRJ3 as a predicate on the metric-name column of a long log."""
    n = F.col(name) if isinstance(name, str) else name
    skip = F.lit(False)
    for t in SKIP_TOKENS:
        skip = skip | n.contains(t)
    return ~(skip & ~n.contains("train_step")) & (n != "test_loss")


def natural_key(name: Column | str) -> Column:
    """PRJ4: sort key for "human" order (test_loss-2 before test_loss-10):
    the lower-cased text pieces and the numbers between them, wherever those
    stand in the name. A name that ends earlier sorts first."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.zip_with(F.split(n, r"\d+", -1), F.regexp_extract_all(n, F.lit(r"(\d+)"), F.lit(1)),
                      lambda text, digits: F.struct(text.alias("text"), digits.try_cast("decimal(38,0)").alias("number")))


# ------------------------------------------------------------ summaries (AGG1, FC9)
def summarise_run(long_log: DataFrame, run: str = "run", ord_col: str = "ord") -> DataFrame:
    """AGG1: per (run, metric) over non-missing values: more than one value
    and no "test" in the name -> ``<metric>_mean`` and ``<metric>_std``
    (sample std); otherwise ``<metric>`` = the first value in log order.
    Input rows (run, ord, metric, value); output rows (run, name, value)."""
    v = long_log.where(F.col("value").isNotNull() & ~F.isnan("value") & metric_filter("metric"))
    s = v.groupBy(run, "metric").agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"),
                                     F.stddev_samp("value").alias("_sd"),
                                     F.min_by("value", F.col(ord_col)).alias("_first"))
    multi = (F.col("_n") > 1) & ~F.col("metric").contains("test")
    stats = F.when(multi, F.array(F.struct(F.concat(F.col("metric"), F.lit("_mean")).alias("name"), F.col("_m").alias("value")),
                                  F.struct(F.concat(F.col("metric"), F.lit("_std")).alias("name"), F.col("_sd").alias("value")))) \
             .otherwise(F.array(F.struct(F.col("metric").alias("name"), F.col("_first").alias("value"))))
    return s.select(run, F.explode(stats).alias("_s")).select(run, "_s.name", "_s.value")


def wide_log_to_long(log: DataFrame, ids: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """SET1 helper: wide log rows -> (ids..., ord, metric, value) with the
    missing cells dropped."""
    metrics = [c for c in log.columns if c not in ids and c != ord_col]
    cast = log.select(*ids, ord_col, *[F.col(c).cast("double").alias(c) for c in metrics])
    long_df = cast.unpivot([*ids, ord_col], metrics, "metric", "value")
    return long_df.where(F.col("value").isNotNull())


def timing_summary(long_log: DataFrame, run: str = "run") -> DataFrame:
    """FC9: step-time mean / std and test time per run, one row per run (the
    AGG1 rules, pivoted on the three names)."""
    names = ["train_step_ms_mean", "train_step_ms_std", "test_time"]
    s = summarise_run(long_log.where(F.col("metric").isin("train_step_ms", "test_time")), run)
    return s.groupBy(run).pivot("name", names).agg(F.first("value"))


# ------------------------------------------------------------ checkpoints (AGG17-AGG19)
def best_checkpoint(log: DataFrame, metric: str = "val_loss", run: str = "run", ord_col: str = "seq") -> DataFrame:
    """AGG17: the row with the smallest ``metric`` per run (ties: earliest
    ``ord_col``); rows without the metric never qualify."""
    cols = [c for c in log.columns if c != run]
    best = (log.where(F.col(metric).isNotNull())
               .groupBy(run).agg(F.min_by(F.struct(*cols), F.struct(F.col(metric), F.col(ord_col))).alias("_b")))
    return best.select(run, "_b.*")


def last_checkpoint(log: DataFrame, epoch: str = "epoch", run: str = "run", ord_col: str = "seq") -> DataFrame:
    """AGG18: the row with the largest ``epoch`` per run (ties: latest ``ord_col``)."""
    cols = [c for c in log.columns if c != run]
    last = log.groupBy(run).agg(F.max_by(F.struct(*cols), F.struct(F.col(epoch), F.col(ord_col))).alias("_b"))
    return last.select(run, "_b.*")


def phase_metrics(log: DataFrame, metrics: Sequence[str], run: str = "run", phase: str = "phase",
                  batch_size: str | None = None) -> DataFrame:
    """AGG19: mean of batch-level metrics per (run, phase); with ``batch_size``
    also the sample-weighted mean sum(v n) / sum(n) as ``<metric>_weighted``."""
    aggs = [F.avg(m).alias(m) for m in metrics]
    if batch_size:
        aggs += [(F.sum(F.col(m) * F.col(batch_size)) / F.sum(F.when(F.col(m).isNotNull(), F.col(batch_size))))
                 .alias(f"{m}_weighted") for m in metrics]
    return log.groupBy(run, phase).agg(*aggs)


# ------------------------------------------------------------ accelerator hours (AGG9, AGG10)
def gpu_hours_summary(runs: DataFrame, seconds: str = "gpu_seconds") -> DataFrame:
    """AGG9: total hours over runs with a positive value, and the number of
    runs without one (missing or zero)."""
    v = F.col(seconds)
    return runs.agg((F.sum(F.when(v > 0, v)) / 3600.0).alias("hours"),
                    F.count(F.when(v > 0, F.lit(1))).cast("bigint").alias("n_with"),
                    F.count(F.when(v.isNull() | (v <= 0), F.lit(1))).cast("bigint").alias("n_without"))


def gpu_hours_history(hist: DataFrame, run: str = "run", seq: str = "seq", ts: str = "_timestamp",
                      metric: str = "power") -> DataFrame:
    """AGG10: per run that logged ``metric``: last minus first timestamp (in
    ``seq`` order); runs without it add 0 and are counted. Returns
    (hours, n_with, n_without)."""
    per = hist.groupBy(run).agg(
        (F.max_by(ts, seq) - F.min_by(ts, seq)).alias("_span"),
        F.count(metric).alias("_m"))
    return per.agg((F.sum(F.when(F.col("_m") > 0, F.col("_span")).otherwise(F.lit(0.0))) / 3600.0).alias("hours"),
                   F.count(F.when(F.col("_m") > 0, F.lit(1))).cast("bigint").alias("n_with"),
                   F.count(F.when(F.col("_m") == 0, F.lit(1))).cast("bigint").alias("n_without"))
