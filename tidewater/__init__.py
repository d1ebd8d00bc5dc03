"""tidewater: spatiotemporal benchmark analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (or a few DataFrames in,
one out) whose work runs as Spark SQL expressions, joins, aggregates and
windows. Sub-packages:

- ``sources``   scans, derived views over the driver tables, sinks
- ``functions`` column-expression helpers (names, dims, bit codes, rounding)
- ``operators`` the operator library, grouped by family
- ``plans``     composed query plans registered for the driver and bench
- ``streaming`` Structured Streaming queries
"""

from tidewater.session import checkpoint_dir, clear_scratch, get_session

__all__ = ["get_session", "checkpoint_dir", "clear_scratch"]
