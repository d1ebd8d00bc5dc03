"""Queries that pick their transforms by name (EX1) and by model / data
structure (EX5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numeric import fixed
from tidewater.operators import compose as cp
from tidewater.plans.registry import ORACLE, register
from tidewater.plans.spectral import _KERNEL, N
from tidewater.plans.sql_views import with_views
from tidewater.sources.views import v_grid


@register("ex1_resolve_transform", ORACLE["sp8_stencil"], ops=("EX1", "SP8"))
def resolve_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic stencil looked up by registered name with its kwargs."""
    t = cp.resolve("stencil", kernel=_KERNEL, width=N, height=N)
    return v_grid(spark, sf_dir).transform(t).withColumn("value", fixed("value"))


@register("ex5_transform_chain", with_views("""
SELECT sample_id, CAST(COUNT(*) * 4 AS BIGINT) AS n_edges, CAST(COUNT(*) AS BIGINT) AS n_dst
FROM v_grid GROUP BY sample_id""", "v_grid"), ops=("EX5", "SET4", "JN8"))
def chain_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid data for a cloud graph model: grid -> cloud -> 4-NN edge list."""
    steps = cp.transforms_for("cloud", "grid", graph=True, width=N, height=N, k=4)
    e = cp.chain(v_grid(spark, sf_dir), steps)
    return e.groupBy("sample_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_edges"),
                                      F.countDistinct("dst").cast("bigint").alias("n_dst"))
