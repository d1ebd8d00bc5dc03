"""ST1: best-so-far checkpoint row per run while log rows keep arriving.

A file-source ``readStream`` over a folder of log batches, a streaming
``groupBy(run).agg(min_by(row, (metric, seq)))`` whose state lives in the
query's checkpoint folder (shared storage, so a restarted query resumes). It
runs in update mode: a trigger hands on only the runs that its new rows touch,
and a ``foreachBatch`` sink adds them as one folder of a change log, named by the
trigger, so that a trigger done again replaces its own folder. The result is the
latest change of each run, so work per trigger follows the new rows, not the runs
seen so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def best_so_far(stream: DataFrame, metric: str = "val_loss", run: str = "run", seq: str = "seq") -> DataFrame:
    """ST1: the streaming aggregate: per run the row with the smallest ``metric``
    seen so far (ties: earliest ``seq``)."""
    cols = [c for c in stream.columns if c != run]
    agg = (stream.where(F.col(metric).isNotNull())
                 .groupBy(run).agg(F.min_by(F.struct(*cols), F.struct(F.col(metric), F.col(seq))).alias("_b")))
    return agg.select(run, "_b.*")


def run_best_so_far(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                    metric: str = "val_loss", run: str = "run", seq: str = "seq",
                    max_files_per_trigger: int = 1) -> DataFrame:
    """ST1: process every file present in ``source`` (``availableNow``), add the
    runs whose rows arrived to the change log in ``sink`` (Parquet, a folder for
    each trigger) and return the best row of each run."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                   .parquet(source))
    best = best_so_far(stream, metric, run, seq)

    def write(batch: DataFrame, trigger: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/_trigger={trigger}")

    q = (best.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_best(spark, sink, run)


def latest_best(spark: SparkSession, sink: str, run: str = "run") -> DataFrame:
    """The best row of each run from the change log of :func:`run_best_so_far`:
    that of the last trigger that touched the run."""
    log = spark.read.parquet(sink)
    cols = [c for c in log.columns if c not in (run, "_trigger")]
    last = log.groupBy(run).agg(F.max_by(F.struct(*cols), "_trigger").alias("_b"))
    return last.select(run, "_b.*")
