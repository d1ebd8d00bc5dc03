"""Choosing and chaining DataFrame transforms by name.

EX1: a component is named by a dotted path (``module.function``) or a short
registered name, with keyword arguments, and resolved to a
``DataFrame -> DataFrame`` callable. EX5: the chain of data transforms for a
model is chosen from the model's and the data's structure and applied with
``DataFrame.transform``.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]

REGISTRY: dict[str, str] = {
    "grid_to_cloud": "tidewater.operators.grid.grid_to_cloud",
    "edge_list": "tidewater.operators.neighbours.edge_list",
    "stencil": "tidewater.operators.grid.stencil",
    "to_struct": "tidewater.operators.features.to_struct",
    "standardise": "tidewater.operators.features.standardise",
    "normalise_cloud": "tidewater.operators.neighbours.normalise_cloud",
}


def resolve(target: str, **kwargs: Any) -> Transform:
    """EX1: ``target`` is a registered name or a dotted ``module.function``;
    the result applies the function to a DataFrame with ``kwargs``."""
    path = REGISTRY.get(target, target)
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"not a dotted path: {target}")
    fn = getattr(importlib.import_module(module), name)
    return lambda df: fn(df, **kwargs)


def chain(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    """Apply transforms left to right with ``DataFrame.transform``."""
    return functools.reduce(lambda acc, t: acc.transform(t), transforms, df)


def transforms_for(model_structure: str, data_structure: str, graph: bool, width: int, height: int,
                   k: int = 16, by: str = "sample_id") -> list[Transform]:
    """EX5: grid data for a cloud model becomes a point cloud; graph models
    get a k-nearest-neighbour edge list. Returns the transforms in order."""
    if model_structure not in ("grid", "cloud") or data_structure not in ("grid", "cloud"):
        raise ValueError("structures are 'grid' or 'cloud'")
    steps: list[Transform] = []
    if model_structure == "cloud" and data_structure == "grid":
        steps.append(resolve("grid_to_cloud", width=width, height=height))
    if graph:
        steps.append(resolve("edge_list", k=k, by=(by,)))
    return steps
