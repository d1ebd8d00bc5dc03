"""Scans and the streaming query on small hand-written inputs."""

from __future__ import annotations

import datetime
import math
import os
import re
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import runs as rn
from tidewater.plans.runlogs import stream_q
from tidewater.sources import runlogs as rl
from tidewater.streaming.best_so_far import run_best_so_far


def _write(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_ragged_csv_logs_union_by_name(spark):
    root = tempfile.mkdtemp(prefix="tw-logs-")
    _write(f"{root}/Sim_cnn:wave:low:1:2/version_0/metrics.csv",
           "epoch,step,train_step_ms,val_loss\n0,1,10.0,\n0,2,12.0,0.5\n1,3,,0.4\n")
    _write(f"{root}/Sim_cnn:wave:low:1:2/version_1/metrics.csv",
           "epoch,test_loss-1,test_time\n1,0.25,NaN\n1,,3.5\n")
    _write(f"{root}/Sim_fno:wave:low:1:2/version_0/metrics.csv", "train_step_ms,test_loss-1\n7.0,0.125\n")
    logs = rl.scan_run_logs(spark, root)
    rows = {(r.run, r.metric): r.value for r in logs.where("metric != 'epoch' AND metric != 'step'").collect()
            if r.metric != "val_loss"}
    assert rows[("Sim_fno:wave:low:1:2", "test_loss-1")] == 0.125
    summary = rn.summarise_run(logs.withColumn("ord", F.struct("file", "row")))
    got = {(r.run, r.name): r.value for r in summary.collect()}
    assert got[("Sim_cnn:wave:low:1:2", "train_step_ms_mean")] == 11.0
    assert got[("Sim_cnn:wave:low:1:2", "test_loss-1")] == 0.25
    assert got[("Sim_cnn:wave:low:1:2", "test_time")] == 3.5   # NaN dropped, first real value kept
    assert got[("Sim_fno:wave:low:1:2", "train_step_ms")] == 7.0   # a single value stays plain
    parsed = logs.select(rn.parse_run_name("run").alias("p")).distinct().collect()
    assert {p.p.model for p in parsed} == {"cnn", "fno"}


def test_hparams_yaml_scan(spark):
    root = tempfile.mkdtemp(prefix="tw-hp-")
    _write(f"{root}/run_a/version_0/hparams.yaml",
           "hparams:\n  Structure: cloud\n  Epochs: 12\n  Batch_size: 2\n  lookback: 4\n  TrainRollout: 1\n"
           "  TestRollout: 16\n  LearningRate: 0.001\n  WeightDecay: 0.0001\ntrainable_parameters: 1771905\n"
           "batch_size: 2\n")
    r = rl.scan_hparams(spark, root).first()
    assert (r.run, r.domain, r.epochs, r.params, r.lr) == ("run_a", "cloud", 12, 1771905, 0.001)


def test_best_so_far_resumes_from_checkpoint(spark):
    base = tempfile.mkdtemp(prefix="tw-stream-")
    src, sink, ckpt = (os.path.join(base, p) for p in ("src", "sink", "ckpt"))
    schema = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("epoch", T.IntegerType()),
                           T.StructField("seq", T.LongType()), T.StructField("val_loss", T.DoubleType()),
                           T.StructField("train_step_ms", T.DoubleType())])
    spark.createDataFrame([(1, 0, 1, 0.9, 1.0), (1, 0, 2, 0.7, 1.0), (2, 0, 3, None, 1.0)], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    first = {r.run: (r.seq, r.val_loss) for r in run_best_so_far(spark, src, schema, sink, ckpt).collect()}
    assert first == {1: (2, 0.7)}
    spark.createDataFrame([(1, 1, 4, 0.8, 1.0), (2, 1, 5, 0.3, 1.0), (1, 1, 6, 0.7, 1.0)], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    second = {r.run: (r.seq, r.val_loss) for r in run_best_so_far(spark, src, schema, sink, ckpt).collect()}
    assert second == {1: (2, 0.7), 2: (5, 0.3)}   # ties keep the earliest seq; state carried over


def test_best_so_far_writes_only_the_runs_that_a_trigger_touches(spark):
    base = tempfile.mkdtemp(prefix="tw-stream-")
    src, sink, ckpt = (os.path.join(base, p) for p in ("src", "sink", "ckpt"))
    kind = "run int, epoch int, seq bigint, val_loss double, train_step_ms double"
    schema = spark.createDataFrame([], kind).schema
    spark.createDataFrame([(i, 0, i, 1.0, 1.0) for i in range(400)], kind).coalesce(1).write.mode("append").parquet(src)
    assert run_best_so_far(spark, src, schema, sink, ckpt).count() == 400
    for k in range(3):   # each call is a restarted query
        rows = [(7, 1, 1000 + k, 0.5 - k / 10, 2.0), (8, 1, 1000 + k, 2.0, 2.0), (400 + k, 1, 5, 0.1, 2.0)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        best = {r.run: (r.seq, r.val_loss) for r in run_best_so_far(spark, src, schema, sink, ckpt).collect()}
        assert best[7] == (1000 + k, 0.5 - k / 10) and best[8] == (8, 1.0) and len(best) == 401 + k
    log = spark.read.parquet(sink).groupBy("_trigger").count().orderBy("_trigger")
    assert [r["count"] for r in log.collect()] == [400, 3, 3, 3]


def test_stream_query_triggers_do_not_grow_with_the_files(spark):
    sf = tempfile.mkdtemp(prefix="tw-orders-")
    rows = [(i, i % 60, "FOP"[i % 3], float(i * 7919 % 1000), datetime.date(1992 + i % 7, 1, 1)) for i in range(1500)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                                "o_orderdate date").write.parquet(f"{sf}/orders.parquet")
    want = {}
    for key, cust, status, price, day in rows:
        if status != "P":
            want[cust % 50] = min(want.get(cust % 50, (math.inf,)), (price, key, day.year - 1994))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "18")
        best = stream_q(spark, sf)
        got = {r.run: (float(r.val_loss), r.seq, r.epoch) for r in best.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == want
    assert {re.search(r"_trigger=(\d+)", f)[1] for f in best.inputFiles()} == {"0", "1", "2", "3"}


def test_log_scan_takes_text_quoted_commas_and_splits(spark):
    root = tempfile.mkdtemp(prefix="tw-logs-")
    rows = "\n".join(f'{i},"ok, fine",{i / 4},' for i in range(500))
    _write(f"{root}/Sim_cnn:wave:low:1:2/version_0/metrics.csv", f'step,"note, with ""comma""",train_step_ms,test_time\r\n{rows}\n\n1,text,oops,2.5\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        got = rl.scan_run_logs(spark, root).where("metric != 'step'").orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in got if r.metric == "train_step_ms"] == [i / 4 for i in range(500)]
    assert [(r.metric, r.value) for r in got][-1] == ("test_time", 2.5)
    assert {r.metric for r in got} == {"train_step_ms", "test_time"}


def test_hparams_under_their_parent_and_with_spaces(spark):
    root = tempfile.mkdtemp(prefix="tw-hp-")
    _write(f"{root}/Sim_cnn:wave:low:1:2/version_0/hparams.yaml",
           "other:\n  Structure: wrong\n  Epochs: 99\nhparams:\n  Structure: 'two words'\n  Epochs: 12\n  LearningRate: 1e-3\n"
           "  WeightDecay: none\ntrainable_parameters: 77\nbatch_size: 4\nmore:\n  lookback: 8\n")
    r = rl.scan_hparams(spark, root).first()
    assert (r.domain, r.epochs, r.lr, r.wd, r.params, r.batch_size, r.lookback) == ("two words", 12, 0.001, None, 77, 4, None)
