"""Query plans. Importing this package registers every plan module."""

from tidewater.plans import codes, frames, graphs, leaderboard, points, runlogs, spectral  # noqa: F401
from tidewater.plans import compose  # noqa: F401,E402
from tidewater.plans.registry import OPERATORS, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "OPERATORS"]
