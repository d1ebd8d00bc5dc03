"""Leaderboard analytics over a results table.

A results table has one row per run with the keys ``model, domain, equation,
resolution`` and metric columns. Operators keep it long (one row per cell)
and pivot only at the end. Results tables are small (models x domains x
equations x resolutions); windows here are partitioned by (resolution,
equation) or (resolution, metric) whose groups are bounded by the number of
models, so no task ever holds more than one leaderboard column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import dims

KEYS = ["model", "domain", "equation", "resolution"]


# ------------------------------------------------------------ projections
def select_metrics(df: DataFrame, metrics: Sequence[str], resolution: str | None = None) -> DataFrame:
    """PRJ6: keep the keys and the named metrics, optionally one resolution."""
    out = df.select(*KEYS, *metrics)
    return out.where(F.col("resolution") == resolution) if resolution is not None else out


def to_long(df: DataFrame, metrics: Sequence[str], ids: Sequence[str] = KEYS) -> DataFrame:
    """Wide metric columns -> rows (ids..., metric, value)."""
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(ids), list(metrics), "metric", "value")


def drop_baselines(long_df: DataFrame, always: Sequence[str] = dims.GRID_BASELINES,
                   for_cost: Sequence[str] = dims.CLOUD_BASELINES,
                   cost_metrics: Sequence[str] = dims.COST_METRICS) -> DataFrame:
    """PRJ7: drop ``always`` baselines for every metric and ``for_cost``
    baselines for cost metrics (parameters, batch size, step time, test time).
    Works per metric on the long form."""
    keep = ~F.col("model").isin(list(always))
    cost = F.col("metric").isin(list(cost_metrics)) & F.col("model").isin(list(for_cost))
    return long_df.where(keep & ~cost)


def relabel_baseline(df: DataFrame, baselines: Sequence[str] = dims.CLOUD_BASELINES) -> DataFrame:
    """PRJ8: the domain of baseline models becomes ``baseline``."""
    return df.withColumn("domain", F.when(F.col("model").isin(list(baselines)), F.lit("baseline"))
                                    .otherwise(F.col("domain")))


def divergence(value: Column | str, metric: Column | str, limit: float = 2.0) -> Column:
    """PRJ9: a loss above ``limit`` counts as diverged."""
    value = F.col(value) if isinstance(value, str) else value
    metric = F.col(metric) if isinstance(metric, str) else metric
    return F.coalesce(metric.contains("loss") & (value > F.lit(limit)), F.lit(False))


def curve_label(df: DataFrame, baselines: Sequence[str] = dims.CLOUD_BASELINES) -> DataFrame:
    """PRJ11: ``model - domain``; baselines are labelled ``model - baseline``."""
    dom = F.when(F.col("model").isin(list(baselines)), F.lit("baseline")).otherwise(F.col("domain"))
    return df.withColumn("label", F.concat_ws(" - ", F.col("model"), dom))


def rollout_curves(df: DataFrame, step_cols: dict[int, str], ids: Sequence[str] = KEYS) -> DataFrame:
    """SET3: ``test_loss-1..n`` wide columns -> (ids..., step, loss)."""
    renamed = df.select(*ids, *[F.col(c).cast("double").alias(f"s{s}") for s, c in step_cols.items()])
    long_df = renamed.unpivot(list(ids), [f"s{s}" for s in step_cols], "_s", "loss")
    return long_df.select(*ids, F.substr("_s", F.lit(2)).cast("bigint").alias("step"), "loss")


# ------------------------------------------------------------ aggregates
def count_by_resolution(df: DataFrame) -> DataFrame:
    """AGG2."""
    return df.groupBy("resolution").agg(F.count(F.lit(1)).cast("bigint").alias("n_runs"))


def pivot_metric(df: DataFrame, metric: str, equations: Sequence[str],
                 index: Sequence[str] = ("model", "domain")) -> DataFrame:
    """AGG3: rows ``index``, one column per equation. A duplicate
    (index, equation) key raises at run time, as a pivot without an
    aggregate must."""
    index = list(index)
    cells = (df.groupBy(*index, "equation")
               .agg(F.count(F.lit(1)).alias("_n"), F.first(metric, ignorenulls=False).alias("_v")))
    cells = cells.withColumn("_v", F.when(F.col("_n") == 1, F.col("_v"))
                             .otherwise(F.raise_error(F.lit(f"duplicate pivot key for {metric}"))))
    return cells.groupBy(*index).pivot("equation", list(equations)).agg(F.first("_v"))


def summary_by_resolution(df: DataFrame, metric: str, resolutions: Sequence[str]) -> DataFrame:
    """AGG4: mean over equations per (model, domain), one column per resolution."""
    return (df.groupBy("model", "domain").pivot("resolution", list(resolutions))
              .agg(F.avg(metric)))


def median_by_resolution(df: DataFrame, metric: str, by_domain: bool = False) -> DataFrame:
    """AGG5 / AGG6: mean over domains per (model, equation, resolution), then
    the exact (interpolating) median over equations. With ``by_domain`` the
    median is taken per (model, domain, resolution) directly."""
    if by_domain:
        return (df.groupBy("model", "domain", "resolution")
                  .agg(F.median(metric).alias("median")))
    m = df.groupBy("model", "equation", "resolution").agg(F.avg(metric).alias("_m"))
    return m.groupBy("model", "resolution").agg(F.median("_m").alias("median"))


def domain_gap(df: DataFrame, models: Sequence[str], metric: str, resolution: str) -> DataFrame:
    """AGG7: chosen models at one resolution; mean metric per (equation,
    domain) and the number of domains present for the equation."""
    sub = df.where(F.col("model").isin(list(models)) & (F.col("resolution") == resolution))
    per = sub.groupBy("equation", "domain").agg(F.avg(metric).alias("mean"))
    nd = sub.groupBy("equation").agg(F.countDistinct("domain").cast("bigint").alias("n_domains"))
    return per.join(nd, "equation")


def curve_limits(curves: DataFrame) -> DataFrame:
    """AGG8: min / max of all curve values per (resolution, equation) panel."""
    return curves.groupBy("resolution", "equation").agg(F.min("loss").alias("lo"), F.max("loss").alias("hi"))


# ------------------------------------------------------------ ranking
def rank_cells(df: DataFrame, metric: str, sentinel: int = 1000) -> DataFrame:
    """WIN1: zero-based min-rank of every (model, domain) in each (resolution,
    equation) column; the grid of cells is densified first and a missing value
    gets ``sentinel``. NaN counts as missing. NULLs rank last explicitly
    (Spark's ascending default would put them first)."""
    rows = df.select("resolution", "model", "domain").distinct()
    cols = df.select("resolution", "equation").distinct()
    grid = rows.join(cols, "resolution")
    vals = df.select("resolution", "model", "domain", "equation",
                     F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric)).alias("value"))
    cells = grid.join(vals, ["resolution", "model", "domain", "equation"], "left")
    w = Window.partitionBy("resolution", "equation").orderBy(F.col("value").asc_nulls_last())
    return cells.withColumn(
        "rank", F.when(F.col("value").isNull(), F.lit(sentinel))
                 .otherwise(F.rank().over(w) - 1).cast("bigint"))


def mean_rank(ranks: DataFrame) -> DataFrame:
    """WIN2: mean rank over equations per (resolution, model, domain)."""
    return ranks.groupBy("resolution", "model", "domain").agg(F.avg("rank").alias("mean_rank"))


def combine_resolutions(mean_ranks: DataFrame, resolutions: Sequence[str]) -> DataFrame:
    """JN2: per-resolution series side by side; a (model, domain) missing at a
    resolution gets NULL there (outer alignment by construction)."""
    return (mean_ranks.groupBy("model", "domain").pivot("resolution", list(resolutions))
                      .agg(F.first("mean_rank")))


def overall_rank(mean_ranks: DataFrame, include: Sequence[str]) -> DataFrame:
    """WIN3: mean of the per-resolution mean ranks over ``include`` (missing
    skipped), with its 1-based position (ties by model, domain)."""
    sub = mean_ranks.where(F.col("resolution").isin(list(include)))
    o = sub.groupBy("model", "domain").agg(F.avg("mean_rank").alias("overall"))
    w = Window.orderBy(F.col("overall").asc_nulls_last(), "model", "domain")
    return o.withColumn("position", F.row_number().over(w).cast("bigint"))


def rank_columns(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """WIN4: zero-based min-rank inside each listed column; NULL stays NULL."""
    long_df = wide.select("model", "domain", *[F.col(c).cast("double").alias(c) for c in columns]) \
                  .unpivot(["model", "domain"], list(columns), "column", "value")
    w = Window.partitionBy("column").orderBy(F.col("value").asc_nulls_last())
    return long_df.withColumn("col_rank", F.when(F.col("value").isNull(), F.lit(None))
                              .otherwise(F.rank().over(w) - 1).cast("bigint"))


def best_mask(df: DataFrame, metric: str, by_domain: bool = True, limit: float = 2.0,
              domains: Sequence[str] = ("grid", "cloud")) -> DataFrame:
    """WIN5 / WIN6: flag every row tied for the minimum per (resolution,
    equation[, domain]); losses above ``limit`` never qualify. Adds ``best``."""
    part = ["resolution", "equation"] + (["domain"] if by_domain else [])
    v = F.col(metric)
    eligible = F.when(v <= limit, v) if "loss" in metric else v
    src = df.where(F.col("domain").isin(list(domains))) if by_domain else df
    mins = src.groupBy(*part).agg(F.min(eligible).alias("_min"))
    return (src.join(mins, part).withColumn("best", F.coalesce(v == F.col("_min"), F.lit(False)))
               .drop("_min"))


def ordered_sort(df: DataFrame, model_order: Sequence[str] = dims.MODEL_ORDER,
                 domain_order: Sequence[str] = dims.DOMAIN_ORDER, by: Sequence[str] = ()) -> DataFrame:
    """WIN7: fixed category order (unlisted values last, then by name); adds
    a 1-based ``position``, within each ``by`` group if given. Meant for a
    finished leaderboard (bounded size)."""
    dpos = dims.order_position("domain", list(domain_order))
    mpos = dims.order_position("model", list(model_order))
    w = Window.partitionBy(*by).orderBy(dpos, mpos, "domain", "model")
    return df.withColumn("position", F.row_number().over(w).cast("bigint"))


# ------------------------------------------------------------ audit
def expected_combinations(spark, domains, resolutions, models, equations) -> DataFrame:
    """Every (domain, resolution, model, equation) from the dimension lists,
    built by exploding the lists on one row."""
    base = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain"))
    for name, vals in (("resolution", resolutions), ("model", models), ("equation", equations)):
        base = base.select("*", F.explode(F.array(*[F.lit(v) for v in vals])).alias(name))
    return base


def missing_combinations(runs: DataFrame, domains, resolutions, models, equations,
                         impossible: Column) -> DataFrame:
    """JN1 / SET2: expected combinations minus observed (anti join) minus impossible."""
    exp = expected_combinations(runs.sparkSession, domains, resolutions, models, equations)
    seen = runs.select("domain", "resolution", "model", "equation").distinct()
    return (exp.join(seen, ["domain", "resolution", "model", "equation"], "left_anti")
               .where(~impossible))
