"""Leaderboard queries over ``v_runs`` (brands = models, line status =
domain, part type = equation, return flag = resolution)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import dims
from tidewater.functions.numeric import fixed, fixed_sql
from tidewater.operators import leaderboard as lb
from tidewater.plans.registry import register
from tidewater.plans.sql_views import with_views
from tidewater.sources.views import v_runs

RES = dims.RUN_RESOLUTIONS
EQS = dims.RUN_EQUATIONS
EQ_MAP = {"economy": "EC", "promo": "PR", "small": "SM"}
MODEL_MAP = {"brand#11": "first", "brand#55": "last"}
BASELINES = ["Brand#12", "Brand#13"]
ALWAYS_DROP = ["Brand#11"]
GAP_MODELS = ["Brand#11", "Brand#22", "Brand#33", "Brand#44", "Brand#55"]
ORDER = ["Brand#55", "Brand#44", "Brand#33", "Brand#22", "Brand#11"]
GRID_ONLY = [f"Brand#1{j}" for j in range(1, 6)]


def _q(xs):
    return ", ".join(f"'{x}'" for x in xs)


def _sql(body: str, **extra: str) -> str:
    return with_views(body, "v_runs", extra=extra or None)


# ------------------------------------------------------------ PRJ5
@register("prj5_map_dims", _sql(f"""
SELECT {dims.map_dim_sql('model', MODEL_MAP)} AS model, domain,
       {dims.map_dim_sql('equation', EQ_MAP)} AS equation, resolution, {fixed_sql('loss1')} AS loss1
FROM v_runs"""), ops=("PRJ5", "EX2"))
def map_dims_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = v_runs(spark, sf_dir)
    return r.select(dims.map_dim("model", MODEL_MAP).alias("model"), "domain",
                    dims.map_dim("equation", EQ_MAP).alias("equation"), "resolution",
                    fixed("loss1").alias("loss1"))


# ------------------------------------------------------------ PRJ6
@register("prj6_select_metrics", _sql(f"""
SELECT model, domain, equation, resolution, {fixed_sql('loss1')} AS loss1, {fixed_sql('loss16')} AS loss16
FROM v_runs WHERE resolution = 'A'"""), ops=("PRJ6",))
def select_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lb.select_metrics(v_runs(spark, sf_dir), ["loss1", "loss16"], "A")
    return s.withColumn("loss1", fixed("loss1")).withColumn("loss16", fixed("loss16"))


# ------------------------------------------------------------ PRJ7
_LONG_SQL = """
SELECT model, domain, equation, resolution, 'loss1' AS metric, loss1 AS value FROM v_runs
UNION ALL SELECT model, domain, equation, resolution, 'loss16', loss16 FROM v_runs
UNION ALL SELECT model, domain, equation, resolution, 'test_time', test_time FROM v_runs"""


@register("prj7_drop_baselines", _sql(f"""
SELECT model, domain, equation, resolution, metric, {fixed_sql('value')} AS value FROM l
WHERE model NOT IN ({_q(ALWAYS_DROP)})
  AND NOT (metric IN ('test_time') AND model IN ({_q(BASELINES)}))""", l=_LONG_SQL), ops=("PRJ7",))
def drop_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_df = lb.to_long(v_runs(spark, sf_dir), ["loss1", "loss16", "test_time"])
    out = lb.drop_baselines(long_df, always=ALWAYS_DROP, for_cost=BASELINES, cost_metrics=["test_time"])
    return out.withColumn("value", fixed("value"))


# ------------------------------------------------------------ PRJ8
@register("prj8_relabel_baseline", _sql(f"""
SELECT model, CASE WHEN model IN ({_q(BASELINES)}) THEN 'baseline' ELSE domain END AS domain,
       equation, resolution, {fixed_sql('loss16')} AS loss16 FROM v_runs"""), ops=("PRJ8",))
def relabel_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lb.relabel_baseline(v_runs(spark, sf_dir), BASELINES)
    return r.select("model", "domain", "equation", "resolution", fixed("loss16").alias("loss16"))


# ------------------------------------------------------------ PRJ9
@register("prj9_divergence", _sql("""
SELECT metric, CAST(SUM(CASE WHEN value > 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_div2,
       CAST(SUM(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_div10,
       CAST(COUNT(*) AS BIGINT) AS n_cells
FROM l WHERE metric IN ('loss1', 'loss16') GROUP BY metric""", l=_LONG_SQL), ops=("PRJ9",))
def divergence_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_df = lb.to_long(v_runs(spark, sf_dir), ["loss1", "loss16"])
    return long_df.groupBy("metric").agg(
        F.sum(lb.divergence("value", "metric", 2.0).cast("long")).cast("bigint").alias("n_div2"),
        F.sum(lb.divergence("value", "metric", 10.0).cast("long")).cast("bigint").alias("n_div10"),
        F.count(F.lit(1)).cast("bigint").alias("n_cells"))


# ------------------------------------------------------------ PRJ11
@register("prj11_curve_label", _sql(f"""
SELECT model, domain, equation, resolution,
       model || ' - ' || CASE WHEN model IN ({_q(BASELINES)}) THEN 'baseline' ELSE domain END AS label
FROM v_runs"""), ops=("PRJ11",))
def label_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.curve_label(v_runs(spark, sf_dir), BASELINES).select(
        "model", "domain", "equation", "resolution", "label")


# ------------------------------------------------------------ AGG2
@register("agg2_count_by_resolution", _sql("""
SELECT resolution, CAST(COUNT(*) AS BIGINT) AS n_runs FROM v_runs GROUP BY resolution"""), ops=("AGG2",))
def count_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.count_by_resolution(v_runs(spark, sf_dir))


# ------------------------------------------------------------ AGG3
_PIVOT_COLS = ", ".join(
    f"{fixed_sql(f'MAX(CASE WHEN equation = {chr(39)}{e}{chr(39)} THEN loss1 END)')} AS \"{e}\"" for e in EQS)


@register("agg3_pivot_metric", _sql(f"""
SELECT resolution, model, domain, {_PIVOT_COLS} FROM v_runs GROUP BY resolution, model, domain"""),
          ops=("AGG3",))
def pivot_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivoted table of every resolution."""
    index = ["resolution", "model", "domain"]
    p = lb.pivot_metric(v_runs(spark, sf_dir), "loss1", EQS, index)
    return p.select(*index, *[fixed(e).alias(e) for e in EQS])


# ------------------------------------------------------------ AGG4
_RES_COLS = ", ".join(
    f"{fixed_sql(f'AVG(CASE WHEN resolution = {chr(39)}{r}{chr(39)} THEN test_time END)')} AS \"{r}\"" for r in RES)


@register("agg4_summary_by_resolution", _sql(f"""
SELECT model, domain, {_RES_COLS} FROM v_runs GROUP BY model, domain"""), ops=("AGG4",))
def summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lb.summary_by_resolution(v_runs(spark, sf_dir), "test_time", RES)
    return s.select("model", "domain", *[fixed(r).alias(r) for r in RES])


# ------------------------------------------------------------ AGG5 / AGG6
@register("agg5_median_by_resolution", _sql(f"""
SELECT model, resolution, {fixed_sql('MEDIAN(m)')} AS median FROM (
  SELECT model, equation, resolution, AVG(loss16) AS m FROM v_runs GROUP BY 1, 2, 3) t
GROUP BY model, resolution"""), ops=("AGG5",))
def median_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lb.median_by_resolution(v_runs(spark, sf_dir), "loss16")
    return m.withColumn("median", fixed("median"))


@register("agg6_median_by_domain", _sql(f"""
SELECT model, domain, resolution, {fixed_sql('MEDIAN(loss16)')} AS median
FROM v_runs GROUP BY model, domain, resolution"""), ops=("AGG6",))
def median_domain_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lb.median_by_resolution(v_runs(spark, sf_dir), "loss16", by_domain=True)
    return m.withColumn("median", fixed("median"))


# ------------------------------------------------------------ AGG7
@register("agg7_domain_gap", _sql(f"""
SELECT p.equation, p.domain, {fixed_sql('p.mean')} AS mean, n.n_domains FROM
  (SELECT equation, domain, AVG(loss16) AS mean FROM s GROUP BY 1, 2) p
  JOIN (SELECT equation, CAST(COUNT(DISTINCT domain) AS BIGINT) AS n_domains FROM s GROUP BY 1) n
  USING (equation)""", s=f"SELECT * FROM v_runs WHERE model IN ({_q(GAP_MODELS)}) AND resolution = 'N'"),
          ops=("AGG7",))
def gap_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lb.domain_gap(v_runs(spark, sf_dir), GAP_MODELS, "loss16", "N")
    return g.select("equation", "domain", fixed("mean").alias("mean"), "n_domains")


# ------------------------------------------------------------ SET3 / AGG8
_CURVES_SQL = """
SELECT model, domain, equation, resolution, CAST(1 AS BIGINT) AS step, loss1 AS loss FROM v_runs
UNION ALL SELECT model, domain, equation, resolution, CAST(16 AS BIGINT), loss16 FROM v_runs"""


def _curves(spark, sf_dir):
    return lb.rollout_curves(v_runs(spark, sf_dir), {1: "loss1", 16: "loss16"})


@register("set3_rollout_curves", _sql(f"""
SELECT model, domain, equation, resolution, step, {fixed_sql('loss')} AS loss FROM c""", c=_CURVES_SQL),
          ops=("SET3",))
def curves_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(spark, sf_dir).withColumn("loss", fixed("loss"))


@register("agg8_curve_limits", _sql(f"""
SELECT resolution, equation, {fixed_sql('MIN(loss)')} AS lo, {fixed_sql('MAX(loss)')} AS hi
FROM c GROUP BY resolution, equation""", c=_CURVES_SQL), ops=("AGG8", "SET3"))
def limits_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    lim = lb.curve_limits(_curves(spark, sf_dir))
    return lim.select("resolution", "equation", fixed("lo").alias("lo"), fixed("hi").alias("hi"))


# ------------------------------------------------------------ WIN1 / WIN2 / JN2 / WIN3 / WIN4
_RANK_SQL = {
    "rws": "SELECT DISTINCT resolution, model, domain FROM v_runs",
    "cls": "SELECT DISTINCT resolution, equation FROM v_runs",
    "cells": """SELECT g.resolution, g.model, g.domain, g.equation, v.loss1 AS value
                FROM (SELECT * FROM rws JOIN cls USING (resolution)) g
                LEFT JOIN v_runs v USING (resolution, model, domain, equation)""",
    "rk": """SELECT *, CAST(CASE WHEN value IS NULL THEN 1000 ELSE
                 RANK() OVER (PARTITION BY resolution, equation ORDER BY value ASC NULLS LAST) - 1 END AS BIGINT) AS rank
             FROM cells""",
    "mr": "SELECT resolution, model, domain, AVG(rank) AS mean_rank FROM rk GROUP BY 1, 2, 3",
}


def _ranks(spark, sf_dir):
    return lb.rank_cells(v_runs(spark, sf_dir), "loss1")


@register("win1_rank_cells", _sql(f"""
SELECT resolution, model, domain, equation, {fixed_sql('value')} AS value, rank FROM rk""", **_RANK_SQL),
          ops=("WIN1",))
def rank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).withColumn("value", fixed("value"))


@register("win2_mean_rank", _sql(f"""
SELECT resolution, model, domain, {fixed_sql('mean_rank')} AS mean_rank FROM mr""", **_RANK_SQL),
          ops=("WIN2",))
def mean_rank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.mean_rank(_ranks(spark, sf_dir)).withColumn("mean_rank", fixed("mean_rank"))


_COMB_COLS = ", ".join(
    f"{fixed_sql(f'MAX(CASE WHEN resolution = {chr(39)}{r}{chr(39)} THEN mean_rank END)')} AS \"{r}\"" for r in RES)


@register("jn2_combine_resolutions", _sql(f"""
SELECT model, domain, {_COMB_COLS} FROM mr GROUP BY model, domain""", **_RANK_SQL), ops=("JN2",))
def combine_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lb.combine_resolutions(lb.mean_rank(_ranks(spark, sf_dir)), RES)
    return c.select("model", "domain", *[fixed(r).alias(r) for r in RES])


_OVERALL_SQL = dict(_RANK_SQL, ov="""
SELECT model, domain, AVG(mean_rank) AS overall FROM mr WHERE resolution IN ('A', 'N') GROUP BY 1, 2""")


@register("win3_overall_rank", _sql(f"""
SELECT model, domain, {fixed_sql('overall')} AS overall,
       CAST(ROW_NUMBER() OVER (ORDER BY overall ASC NULLS LAST, model, domain) AS BIGINT) AS position
FROM ov""", **_OVERALL_SQL), ops=("WIN3",))
def overall_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lb.overall_rank(lb.mean_rank(_ranks(spark, sf_dir)), ["A", "N"])
    return o.withColumn("overall", fixed("overall"))


_COLS_SQL = dict(_OVERALL_SQL, wide=f"""
SELECT c.model, c.domain, c.A, c.N, c.R, ov.overall FROM
  (SELECT model, domain, {", ".join(f"MAX(CASE WHEN resolution = '{r}' THEN mean_rank END) AS {r}" for r in RES)}
   FROM mr GROUP BY model, domain) c JOIN ov USING (model, domain)""",
                 lng="""
SELECT model, domain, 'A' AS "column", A AS value FROM wide UNION ALL
SELECT model, domain, 'N', N FROM wide UNION ALL SELECT model, domain, 'R', R FROM wide UNION ALL
SELECT model, domain, 'overall', overall FROM wide""")


@register("win4_rank_columns", _sql(f"""
SELECT model, domain, "column", {fixed_sql('value')} AS value,
       CAST(CASE WHEN value IS NULL THEN NULL ELSE
            RANK() OVER (PARTITION BY "column" ORDER BY value ASC NULLS LAST) - 1 END AS BIGINT) AS col_rank
FROM lng""", **_COLS_SQL), ops=("WIN4",))
def rank_columns_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    mr = lb.mean_rank(_ranks(spark, sf_dir))
    wide = lb.combine_resolutions(mr, RES).join(
        lb.overall_rank(mr, ["A", "N"]).drop("position"), ["model", "domain"])
    rc = lb.rank_columns(wide, [*RES, "overall"])
    return rc.withColumn("value", fixed("value"))


# ------------------------------------------------------------ WIN5 / WIN6
@register("win5_best_mask", _sql(f"""
SELECT v.resolution, v.equation, v.domain, v.model, {fixed_sql('v.loss1')} AS value FROM v_runs v
JOIN (SELECT resolution, equation, domain, MIN(CASE WHEN loss1 <= 2 THEN loss1 END) AS mn
      FROM v_runs WHERE domain IN ('grid', 'cloud') GROUP BY 1, 2, 3) m
  ON v.resolution = m.resolution AND v.equation = m.equation AND v.domain = m.domain
WHERE v.loss1 = m.mn"""), ops=("WIN5",))
def best_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lb.best_mask(v_runs(spark, sf_dir), "loss1").where("best")
    return b.select("resolution", "equation", "domain", "model", fixed("loss1").alias("value"))


@register("win6_best_by_equation", _sql(f"""
SELECT v.resolution, v.equation, v.domain, v.model, {fixed_sql('v.loss1')} AS value FROM v_runs v
JOIN (SELECT resolution, equation, MIN(CASE WHEN loss1 <= 2 THEN loss1 END) AS mn
      FROM v_runs GROUP BY 1, 2) m
  ON v.resolution = m.resolution AND v.equation = m.equation
WHERE v.loss1 = m.mn"""), ops=("WIN6",))
def best_eq_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lb.best_mask(v_runs(spark, sf_dir), "loss1", by_domain=False).where("best")
    return b.select("resolution", "equation", "domain", "model", fixed("loss1").alias("value"))


# ------------------------------------------------------------ WIN7
def _pos_sql(expr, order):
    whens = " ".join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(order))
    return f"COALESCE(CASE {expr} {whens} END, {len(order) + 1})"


@register("win7_ordered_sort", _sql(f"""
SELECT resolution, model, domain, CAST(ROW_NUMBER() OVER (PARTITION BY resolution ORDER BY {_pos_sql('domain', dims.DOMAIN_ORDER)},
                                                          {_pos_sql('model', ORDER)}, domain, model) AS BIGINT) AS position
FROM (SELECT DISTINCT resolution, model, CASE WHEN model IN ({_q(BASELINES)}) THEN 'baseline' ELSE domain END AS domain
      FROM v_runs) t"""), ops=("WIN7",))
def ordered_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered table of every resolution."""
    r = lb.relabel_baseline(v_runs(spark, sf_dir), BASELINES)
    rows = r.select("resolution", "model", "domain").distinct()
    return lb.ordered_sort(rows, ORDER, dims.DOMAIN_ORDER, by=["resolution"]).select("resolution", "model", "domain", "position")


# ------------------------------------------------------------ JN1 / SET2
def _values(name, vals):
    return f"(SELECT * FROM (VALUES {', '.join(f'({chr(39)}{v}{chr(39)})' for v in vals)}) t({name}))"


@register("jn1_missing_combinations", _sql(f"""
SELECT e.domain, e.resolution, e.model, e.equation FROM (
  SELECT d.domain, r.resolution, m.model, q.equation FROM
  {_values('domain', dims.RUN_DOMAINS)} d CROSS JOIN {_values('resolution', RES)} r
  CROSS JOIN {_values('model', dims.RUN_MODELS)} m CROSS JOIN {_values('equation', EQS)} q) e
WHERE NOT EXISTS (SELECT 1 FROM v_runs v WHERE v.domain = e.domain AND v.resolution = e.resolution
                  AND v.model = e.model AND v.equation = e.equation)
  AND NOT (e.domain = 'cloud' AND e.model IN ({_q(GRID_ONLY)}))
  AND NOT (e.domain = 'cloud' AND e.resolution = 'R')"""), ops=("JN1", "SET2"))
def missing_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    impossible = ((F.col("domain") == "cloud") & F.col("model").isin(GRID_ONLY)) | \
                 ((F.col("domain") == "cloud") & (F.col("resolution") == "R"))
    return lb.missing_combinations(v_runs(spark, sf_dir), dims.RUN_DOMAINS, RES, dims.RUN_MODELS,
                                   EQS, impossible)
