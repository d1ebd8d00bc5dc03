"""Dimension values and case-insensitive mapping columns."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the benchmark's own lists for its results
# tables to be read the same way.
MODEL_ORDER = ["CNN", "ResNet", "FNO", "NeuralPDE", "GrINd", "PTv1", "PTv3", "GeoFNO",
               "PointNet", "PointGNN", "GraphPDE", "GAT", "GCN", "FeaStNet", "persistence", "zero"]
DOMAIN_ORDER = ["grid", "cloud", "baseline"]
COST_METRICS = ["params", "batch_size", "train_step_ms_mean", "test_time"]
GRID_BASELINES = ["zero_grid", "persistance_grid"]
CLOUD_BASELINES = ["persistence", "zero"]
AUDIT_DOMAINS = ["cloud", "grid"]
AUDIT_RESOLUTIONS = ["low", "medium", "high", "full"]
AUDIT_MODELS = ["cnn", "fno", "gat", "gcn", "geo_fno", "graphpde", "neuralpde", "pointgnn",
                "pointnet", "ptv1", "ptv3", "resnet", "grind", "feast"]
AUDIT_EQUATIONS = ["advection", "burgers", "gasdynamics", "kuramotosivashinsky",
                   "reactiondiffusion", "wave"]
GRID_ONLY_MODELS = ["cnn", "fno", "resnet", "neuralpde"]
# ---------------------------------------------------------------------------

# Stand-ins used when the leaderboard is built from the driver tables
# (v_runs): 25 brands play the models, part types the equations, return
# flags the resolutions, and flag R the "full" resolution.
RUN_MODELS = [f"Brand#{i}{j}" for i, j in itertools.product(range(1, 6), range(1, 6))]
RUN_EQUATIONS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RUN_RESOLUTIONS = ["A", "N", "R"]
RUN_DOMAINS = ["cloud", "grid"]


def map_dim(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """PRJ5 / EX2: case-insensitive lookup with pass-through of unknown values."""
    c = F.col(c) if isinstance(c, str) else c
    if not mapping:
        return c
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in (kv[0].lower(), kv[1])])
    return F.coalesce(m[F.lower(c)], c)


def map_dim_sql(expr: str, mapping: Mapping[str, str]) -> str:
    whens = " ".join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in mapping.items())
    return f"COALESCE(CASE LOWER({expr}) {whens} END, {expr})"


def order_position(c: Column | str, order: list[str]) -> Column:
    """1-based position of ``c`` in ``order``; values not listed sort after
    all listed ones."""
    c = F.col(c) if isinstance(c, str) else c
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), c)
    return F.when(pos == 0, F.lit(len(order) + 1)).otherwise(pos).cast("bigint")
