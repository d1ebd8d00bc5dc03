"""Row numbering that does not put a whole group into one task.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task; a
group holding a third of the data then holds a third of the data in one
task. Here rows are range-partitioned on ``(g, o)`` instead, so a hot group is
cut across many partitions; each partition numbers its slice of the group, and
a small table of slice sizes (one row per partition and group) turns local
numbers into global ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.common import materialize


def _num_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column | str,
                out: str = "running", partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` inside ``by`` groups in ``order``
    (``sum(value) over (partition by by order by order rows unbounded
    preceding)``), computed slice-wise so no group is one task.

    The range bounds of ``repartitionByRange`` are sampled per execution, so
    the slice sums are written once as a table in the shared checkpoint
    folder before slice totals are derived from them: both uses then see the
    same slices, also after a lost executor.
    ``order`` must make rows unique inside a group.
    """
    by = list(by)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    val = F.col(value) if isinstance(value, str) else value
    n = _num_partitions(df, partitions)
    ranged = (df.repartitionByRange(n, *[F.col(b) for b in by], *order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_val", val))
    w = Window.partitionBy("_pid", *by).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    # written once as a table in the shared folder: both uses below read the
    # same slices, also after a lost executor
    local = materialize(ranged.withColumn("_local", F.sum("_val").over(w)), "slices")
    slices = local.groupBy("_pid", *by).agg(F.sum("_val").alias("_tot"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_pid", *by, F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, ["_pid", *by])
                 .withColumn(out, F.col("_off") + F.col("_local"))
                 .drop("_pid", "_local", "_off", "_val"))


_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row below


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
            out: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """1-based ``row_number() over (partition by by order by order)`` as
    BIGINT. ``order`` must make rows unique inside a group; with an empty
    ``by`` the numbering is global.

    One shuffle deals the rows by range; each partition is sorted, so the row
    number inside it comes free. The first number and the size of each group's
    slice in a partition, a small table, turn those into numbers of the group.
    """
    by = list(by)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [*[F.col(b) for b in by], *order_cols]
    n = _num_partitions(df, partitions)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # written once: the range bounds are sampled anew in every execution
    local = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), "slices")
    local = local.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    slices = local.groupBy("_pid", *by).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_pid", *by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    return (local.join(offsets, ["_pid", *by])
                 .withColumn(out, (F.col("_off") + F.col("_mid")).cast("bigint"))
                 .drop("_pid", "_mid", "_off"))
