"""Run-log warehouse queries. Logs, hyper-parameter files, results tables and
datasets are derived from the driver tables (orders = metric log rows,
lineitem/part = results, events = dataset samples); the file-based queries
first write those derived files into a fresh folder under the shared
checkpoint folder, then scan them back."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.numeric import fixed, fixed_sql
from tidewater.operators import leaderboard as lb
from tidewater.operators import runs as rn
from tidewater.plans.registry import register
from tidewater.plans.sql_views import GAP, with_views
from tidewater.session import scratch_path
from tidewater.sources import runlogs as rl
from tidewater.sources.tables import table
from tidewater.sources.views import v_log, v_runs
from tidewater.streaming.best_so_far import run_best_so_far

# ------------------------------------------------------------ derived logs
_RUN_SQL = "'run_' || CAST(o_custkey % 50 AS VARCHAR)"
_EPOCH_SQL = "(YEAR(o_orderdate) - 1994)"


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metric log, one row per order: most cells missing, as a training
    log is (train rows, validation rows, test rows at the last epoch)."""
    o = table(spark, sf_dir, "orders")
    st, tp = F.col("o_orderstatus"), F.col("o_totalprice")
    epoch = F.year("o_orderdate") - 1994
    return o.select(
        F.concat(F.lit("run_"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("run"),
        F.col("o_orderkey").alias("seq"), epoch.alias("epoch"), F.col("o_orderkey").alias("step"),
        F.when(st == "F", tp / 1e5).alias("train_loss"), F.when(st != "P", tp).alias("val_loss"),
        F.when(st == "O", tp / 1000).alias("train_step_ms"), F.when(epoch == 7, tp / 1e4).alias("test_loss"),
        F.when(epoch == 7, tp / 1e6).alias("test_loss_l1"),
        F.when((epoch == 7) & (st == "F"), tp / 100).alias("test_time"))


def long_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.wide_log_to_long(order_log(spark, sf_dir), ["run"], "seq").withColumnRenamed("seq", "ord")


_LONG_SQL = f"""
SELECT {_RUN_SQL} AS run, o_orderkey AS seq, 'train_step_ms' AS metric, o_totalprice / 1000 AS value
  FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT {_RUN_SQL}, o_orderkey, 'test_loss_l1', o_totalprice / 1e6 FROM orders WHERE {_EPOCH_SQL} = 7
UNION ALL SELECT {_RUN_SQL}, o_orderkey, 'test_time', o_totalprice / 100 FROM orders
  WHERE {_EPOCH_SQL} = 7 AND o_orderstatus = 'F'"""

_SUMMARY_SQL = with_views(f"""
SELECT run, metric || '_mean' AS name, {fixed_sql('m')} AS value FROM s WHERE n > 1 AND metric NOT LIKE '%test%'
UNION ALL SELECT run, metric || '_std', {fixed_sql('sd')} FROM s WHERE n > 1 AND metric NOT LIKE '%test%'
UNION ALL SELECT run, metric, {fixed_sql('f')} FROM s WHERE NOT (n > 1 AND metric NOT LIKE '%test%')""",
                          extra={"l": _LONG_SQL, "s": """SELECT run, metric, COUNT(*) AS n, AVG(value) AS m,
                                 STDDEV_SAMP(value) AS sd, ARG_MIN(value, seq) AS f FROM l GROUP BY 1, 2"""})


def _fixed_value(df: DataFrame) -> DataFrame:
    return df.withColumn("value", fixed("value"))


# ------------------------------------------------------------ AGG1 / PRJ3 / FC9
@register("agg1_summarise_run", _SUMMARY_SQL, ops=("AGG1", "PRJ3", "SET1"))
def summarise_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_value(rn.summarise_run(long_log(spark, sf_dir)))


@register("prj3_metric_columns", f"""
SELECT {_RUN_SQL} AS run, o_orderkey AS seq,
       {fixed_sql("CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 1000 END")} AS train_step_ms,
       {fixed_sql(f"CASE WHEN {_EPOCH_SQL} = 7 THEN o_totalprice / 1e6 END")} AS test_loss_l1,
       {fixed_sql(f"CASE WHEN {_EPOCH_SQL} = 7 AND o_orderstatus = 'F' THEN o_totalprice / 100 END")} AS test_time
FROM orders""", ops=("PRJ3",))
def metric_columns_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    keep = rn.metric_columns(log.drop("run", "seq"))
    return log.select("run", "seq", *[fixed(c).alias(c) for c in keep])


@register("fc9_timing_summary", with_views(f"""
SELECT run, {fixed_sql("MAX(CASE WHEN name = 'train_step_ms_mean' THEN value END)")} AS train_step_ms_mean,
       {fixed_sql("MAX(CASE WHEN name = 'train_step_ms_std' THEN value END)")} AS train_step_ms_std,
       {fixed_sql("MAX(CASE WHEN name = 'test_time' THEN value END)")} AS test_time
FROM (
  SELECT run, metric || '_mean' AS name, m AS value FROM s WHERE n > 1 AND metric NOT LIKE '%test%'
  UNION ALL SELECT run, metric || '_std', sd FROM s WHERE n > 1 AND metric NOT LIKE '%test%'
  UNION ALL SELECT run, metric, f FROM s WHERE NOT (n > 1 AND metric NOT LIKE '%test%')) t
GROUP BY run""", extra={"l": _LONG_SQL, "s": """SELECT run, metric, COUNT(*) AS n, AVG(value) AS m,
                         STDDEV_SAMP(value) AS sd, ARG_MIN(value, seq) AS f FROM l
                         WHERE metric IN ('train_step_ms', 'test_time') GROUP BY 1, 2"""}), ops=("FC9", "AGG1"))
def timing_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rn.timing_summary(long_log(spark, sf_dir))
    return t.select("run", *[fixed(c).alias(c) for c in ("train_step_ms_mean", "train_step_ms_std", "test_time")])


# ------------------------------------------------------------ PRJ1 / PRJ2 / PRJ4
_NAME_SQL = """'Sim_' || CASE WHEN domain = 'cloud' THEN 'Geo_' ELSE '' END || REPLACE(model, 'Brand#', 'Brand')
   || ':' || LOWER(equation) || ':' || resolution || ':' || CAST(n AS VARCHAR) || ':0'
   || CASE WHEN equation = 'PROMO' THEN ':extra' ELSE '' END"""


@register("prj1_parse_run_name", with_views(f"""
SELECT name, CASE WHEN ok THEN head[1] END AS dataset, CASE WHEN ok THEN LOWER(mdl) END AS model,
       CASE WHEN ok THEN parts[2] END AS equation, CASE WHEN ok THEN parts[3] END AS resolution,
       CASE WHEN ok THEN parts[4] || ':' || parts[5] END AS version
FROM (SELECT *, LEN(parts) = 5 AND mdl IS NOT NULL AS ok FROM (
  SELECT *, CASE LEN(head) WHEN 3 THEN head[2] || '_' || head[3] WHEN 2 THEN head[2] END AS mdl FROM (
    SELECT name, STR_SPLIT(name, ':') AS parts, STR_SPLIT(STR_SPLIT(name, ':')[1], '_') AS head FROM (
      SELECT {_NAME_SQL} AS name FROM v_runs) a) b) c) d""", "v_runs"), ops=("PRJ1",))
def parse_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = v_runs(spark, sf_dir)
    name = F.concat(F.lit("Sim_"), F.when(F.col("domain") == "cloud", "Geo_").otherwise(""),
                    F.regexp_replace("model", "Brand#", "Brand"), F.lit(":"), F.lower("equation"), F.lit(":"),
                    F.col("resolution"), F.lit(":"), F.col("n").cast("string"), F.lit(":0"),
                    F.when(F.col("equation") == "PROMO", ":extra").otherwise(""))
    p = r.select(name.alias("name")).withColumn("p", rn.parse_run_name("name"))
    return p.select("name", "p.dataset", "p.model", "p.equation", "p.resolution", "p.version")


@register("prj2_epoch_bucket", with_views("""
SELECT run, epoch, CAST(epoch * 2 AS BIGINT) AS epochs,
       CAST(CASE WHEN epoch * 2 >= 10 THEN 10 WHEN epoch * 2 >= 3 THEN 3 END AS BIGINT) AS bucket
FROM (SELECT DISTINCT CAST(run AS BIGINT) AS run, CAST(epoch AS BIGINT) AS epoch FROM v_log) t""", "v_log"),
          ops=("PRJ2",))
def bucket_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v_log(spark, sf_dir).select(F.col("run").cast("bigint").alias("run"),
                                    F.col("epoch").cast("bigint").alias("epoch")).distinct()
    return d.select("run", "epoch", (F.col("epoch") * 2).cast("bigint").alias("epochs"),
                    rn.epoch_bucket(F.col("epoch") * 2).alias("bucket"))


@register("prj4_natural_key", with_views("""
SELECT name, CAST(ROW_NUMBER() OVER (ORDER BY LOWER(REGEXP_EXTRACT(name, '^(.*?)(\\d*)$', 1)),
                                      CAST(NULLIF(REGEXP_EXTRACT(name, '(\\d+)$', 1), '') AS BIGINT) NULLS FIRST,
                                      name) AS BIGINT) AS position
FROM (SELECT DISTINCT 'test_loss-' || CAST(epoch * 2 AS VARCHAR) AS name FROM v_log
      UNION SELECT DISTINCT 'test_loss-' || CAST(epoch AS VARCHAR) FROM v_log
      UNION SELECT DISTINCT 'Train_step_ms' || CAST(epoch AS VARCHAR) FROM v_log) t""", "v_log"), ops=("PRJ4",))
def natural_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric names ordered the "human" way (test_loss-2 before test_loss-10);
    the list of names is small (one per metric), so a global order is fine."""
    lg = v_log(spark, sf_dir)
    e = F.col("epoch").cast("string")
    names = (lg.select(F.concat(F.lit("test_loss-"), (F.col("epoch") * 2).cast("string")).alias("name"))
               .union(lg.select(F.concat(F.lit("test_loss-"), e).alias("name")))
               .union(lg.select(F.concat(F.lit("Train_step_ms"), e).alias("name"))).distinct())
    key = rn.natural_key("name")
    from pyspark.sql import Window
    w = Window.orderBy(key, F.col("name"))
    return names.select("name", F.row_number().over(w).cast("bigint").alias("position"))


# ------------------------------------------------------------ AGG17 / AGG18 / AGG19
_V_LOG_COLS = "run, CAST(epoch AS BIGINT) AS epoch, seq, val_loss, train_step_ms"


def _log_out(df: DataFrame) -> DataFrame:
    return df.select("run", F.col("epoch").cast("bigint").alias("epoch"), "seq", fixed("val_loss").alias("val_loss"),
                     fixed("train_step_ms").alias("train_step_ms"))


_BEST_SQL = with_views(f"""
SELECT run, epoch, seq, {fixed_sql('val_loss')} AS val_loss, {fixed_sql('train_step_ms')} AS train_step_ms FROM (
  SELECT {_V_LOG_COLS}, ROW_NUMBER() OVER (PARTITION BY run ORDER BY val_loss, seq) AS rn
  FROM v_log WHERE val_loss IS NOT NULL) t WHERE rn = 1""", "v_log")


@register("agg17_best_checkpoint", _BEST_SQL, ops=("AGG17",))
def best_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_out(rn.best_checkpoint(v_log(spark, sf_dir)))


@register("agg18_last_checkpoint", with_views(f"""
SELECT run, epoch, seq, {fixed_sql('val_loss')} AS val_loss, {fixed_sql('train_step_ms')} AS train_step_ms FROM (
  SELECT {_V_LOG_COLS}, ROW_NUMBER() OVER (PARTITION BY run ORDER BY epoch DESC, seq DESC) AS rn FROM v_log) t
WHERE rn = 1""", "v_log"), ops=("AGG18",))
def last_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_out(rn.last_checkpoint(v_log(spark, sf_dir)))


_PHASE = "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END"


@register("agg19_phase_metrics", f"""
SELECT CAST(o_custkey % 50 AS INT) AS run, {_PHASE} AS phase, {fixed_sql('AVG(o_totalprice / 100000)')} AS loss,
       {fixed_sql('SUM(o_totalprice / 100000 * CAST(SUBSTR(o_orderpriority, 1, 1) AS BIGINT)) / SUM(CAST(SUBSTR(o_orderpriority, 1, 1) AS BIGINT))')} AS loss_weighted
FROM orders GROUP BY 1, 2""", ops=("AGG19",))
def phase_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean batch loss per (run, phase), plain and weighted by batch size
    (the priority digit plays the batch size)."""
    o = table(spark, sf_dir, "orders")
    log = o.select(F.pmod("o_custkey", F.lit(50)).cast("int").alias("run"),
                   F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val")
                    .otherwise("test").alias("phase"),
                   (F.col("o_totalprice") / 100000).alias("loss"),
                   F.substring("o_orderpriority", 1, 1).cast("bigint").alias("n"))
    p = rn.phase_metrics(log, ["loss"], batch_size="n")
    return p.select("run", "phase", fixed("loss").alias("loss"), fixed("loss_weighted").alias("loss_weighted"))


# ------------------------------------------------------------ AGG9 / AGG10
def _epoch_seconds(ts):
    """Seconds since 1970-01-01 of a local (NTZ) timestamp, independent of the
    session time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double")
    return days * 86400.0 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


@register("agg9_gpu_hours_summary", f"""
SELECT {fixed_sql('SUM(CASE WHEN s > 0 THEN s END) / 3600.0')} AS hours,
       CAST(COUNT(CASE WHEN s > 0 THEN 1 END) AS BIGINT) AS n_with,
       CAST(COUNT(CASE WHEN s IS NULL OR s <= 0 THEN 1 END) AS BIGINT) AS n_without
FROM (SELECT {_RUN_SQL} AS run,
             SUM(CASE WHEN {_EPOCH_SQL} = 7 AND o_orderstatus = 'F' THEN o_totalprice / 100 END) AS s
      FROM orders GROUP BY 1) t""", ops=("AGG9",))
def gpu_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = order_log(spark, sf_dir).groupBy("run").agg(F.sum("test_time").alias("gpu_seconds"))
    s = rn.gpu_hours_summary(runs)
    return s.select(fixed("hours").alias("hours"), "n_with", "n_without")


@register("agg10_gpu_hours_history", f"""
SELECT {fixed_sql('SUM(CASE WHEN m > 0 THEN span ELSE 0 END) / 3600.0')} AS hours,
       CAST(COUNT(CASE WHEN m > 0 THEN 1 END) AS BIGINT) AS n_with,
       CAST(COUNT(CASE WHEN m = 0 THEN 1 END) AS BIGINT) AS n_without
FROM (SELECT CAST(o_custkey % 50 AS INT) AS run,
             ARG_MAX(CAST(EPOCH(o_orderdate) AS DOUBLE), CAST(EPOCH(o_orderdate) AS DOUBLE))
               - ARG_MIN(CAST(EPOCH(o_orderdate) AS DOUBLE), CAST(EPOCH(o_orderdate) AS DOUBLE)) AS span,
             COUNT(CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'F' THEN 1 END) AS m
      FROM orders GROUP BY 1) t""", ops=("AGG10",))
def gpu_history_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    # the history is logged in time order: its step is the timestamp itself
    hist = o.select(F.pmod("o_custkey", F.lit(50)).cast("int").alias("run"),
                    _epoch_seconds(F.col("o_orderdate")).alias("seq"),
                    _epoch_seconds(F.col("o_orderdate")).alias("_timestamp"),
                    F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "F"),
                           F.col("o_totalprice")).alias("power"))
    h = rn.gpu_hours_history(hist)
    return h.select(fixed("hours").alias("hours"), "n_with", "n_without")


# ------------------------------------------------------------ SRC1 / SRC2 / SRC3 / SET1 (files)
def write_run_logs(spark: SparkSession, sf_dir: str, root: str, run: Column | None = None) -> None:
    """Two CSV files per run with different column sets (ragged), at
    ``root/<run>/version_<k>/part-*.csv``, rows in log order. ``run`` renames
    the runs."""
    log = order_log(spark, sf_dir)
    log = log if run is None else log.withColumn("run", run)
    train = log.select("run", "seq", "epoch", "step", "train_loss", "val_loss", "train_step_ms") \
               .withColumn("version", F.lit("version_0"))
    test = log.where(F.col("epoch") == 7).select("run", "seq", "epoch", "step", "test_loss", "test_loss_l1",
                                                 "test_time").withColumn("version", F.lit("version_1"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in (train, test):
        # range-sorted by (run, seq): a long run spans several files whose
        # names follow the range order, so (file, row) is the log order
        (part.repartitionByRange(n, "run", "seq").sortWithinPartitions("run", "seq").drop("seq")
             .write.mode("append").partitionBy("run", "version").option("header", True).csv(root))


def _scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "runlogs")
    write_run_logs(spark, sf_dir, root)
    return rl.scan_run_logs(spark, root)


@register("src1_scan_run_logs", _SUMMARY_SQL, ops=("SRC1", "SET1", "AGG1", "PRJ3"))
def scan_logs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged per-run CSV logs scanned back and summarised per run."""
    lg = _scan_logs(spark, sf_dir).withColumn("ord", F.struct("file", "row"))
    return _fixed_value(rn.summarise_run(lg))


_HP_SQL = f"""SELECT {_RUN_SQL} AS run, CAST(COUNT(*) * 1000 AS BIGINT) AS params, CAST(2 AS BIGINT) AS batch_size,
       CASE WHEN SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) >= SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)
            THEN 'grid' ELSE 'cloud' END AS domain,
       CAST(MAX({_EPOCH_SQL}) * 2 AS BIGINT) AS epochs, CAST(2 AS BIGINT) AS hp_batch_size, CAST(4 AS BIGINT) AS lookback,
       CAST(1 AS BIGINT) AS train_rollout, CAST(16 AS BIGINT) AS test_rollout,
       CAST(0.001 AS DOUBLE) AS lr, CAST(0.0001 AS DOUBLE) AS wd
FROM orders GROUP BY 1"""


def write_hparams(spark: SparkSession, sf_dir: str, root: str, run: Column | None = None) -> None:
    """One YAML text file per run at ``root/<run>/version_0/part-*.txt``.
    ``run`` renames the runs."""
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    per = o.groupBy(F.concat(F.lit("run_"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("run")).agg(
        (F.count(F.lit(1)) * 1000).alias("params"),
        F.when(F.sum(F.when(st == "F", 1).otherwise(0)) >= F.sum(F.when(st == "O", 1).otherwise(0)), "grid")
         .otherwise("cloud").alias("domain"),
        ((F.max(F.year("o_orderdate")) - 1994) * 2).alias("epochs"))
    text = F.concat_ws("\n", F.lit("hparams:"),
                       F.concat(F.lit("  Structure: "), F.col("domain")),
                       F.concat(F.lit("  Epochs: "), F.col("epochs").cast("string")),
                       F.lit("  Batch_size: 2"), F.lit("  lookback: 4"), F.lit("  TrainRollout: 1"),
                       F.lit("  TestRollout: 16"), F.lit("  LearningRate: 0.001"), F.lit("  WeightDecay: 0.0001"),
                       F.concat(F.lit("trainable_parameters: "), F.col("params").cast("string")),
                       F.lit("batch_size: 2"), F.lit(""))
    per = per.withColumn("value", text)
    per = per if run is None else per.withColumn("run", run)
    (per.select("run", F.lit("version_0").alias("version"), "value").repartition("run")
        .write.mode("overwrite").partitionBy("run", "version").text(root))


@register("src2_scan_hparams", _HP_SQL, ops=("SRC2",))
def scan_hp_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "hparams")
    write_hparams(spark, sf_dir, root)
    return rl.scan_hparams(spark, root, glob="*.txt")


@register("src3_attach_hparams", with_views("""
SELECT s.run, s.name, s.value, h.domain, h.epochs, h.params FROM s JOIN h USING (run)""",
                                            extra={"s": f"SELECT * FROM ({_SUMMARY_SQL}) q", "h": _HP_SQL}),
          ops=("SRC3", "SRC1", "SRC2"))
def attach_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned run summaries joined to scanned hyper-parameters by run key."""
    logs = _scan_logs(spark, sf_dir).withColumn("ord", F.struct("file", "row"))
    summ = _fixed_value(rn.summarise_run(logs))
    root = scratch_path(spark, "hparams")
    write_hparams(spark, sf_dir, root)
    hp = rl.scan_hparams(spark, root, glob="*.txt")
    return rl.attach_hparams(summ, hp).select("run", "name", "value", "domain", "epochs", "params")


# ------------------------------------------------------------ results table of all runs
_MODELS = ["cnn", "geo_fno", "gat", "resNet", "ptv3"]
_EQUATIONS = ["wave", "burgers", "advection"]
_K = "CAST(SUBSTR(run, 5) AS INT)"
_SUMMARY_NAMES = ["test_loss_l1", "test_time", "train_step_ms", "train_step_ms_mean", "train_step_ms_std"]


def _nth(values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {_K} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# the same text is Spark and DuckDB SQL
_FULL_NAME = f"'Sim_' || {_nth(_MODELS)} || ':' || {_nth(_EQUATIONS)} || ':low:' || SUBSTR(run, 5) || ':1'"


@register("m1_results_table", with_views(f"""
SELECT LOWER({_nth(_MODELS)}) AS model, {_nth(_EQUATIONS)} AS equation, 'low' AS resolution,
       SUBSTR(s.run, 5) || ':1' AS version, h.domain, h.params,
       CAST(CASE WHEN h.epochs >= 10 THEN 10 WHEN h.epochs >= 3 THEN 3 END AS BIGINT) AS epochs, h.lookback,
       h.train_rollout, h.test_rollout, h.lr, h.wd,
       {', '.join(f"MAX(CASE WHEN s.name = '{n}' THEN s.value END) AS {n}" for n in _SUMMARY_NAMES)}
FROM s JOIN h ON s.run = h.run GROUP BY s.run, h.domain, h.params, h.epochs, h.lookback, h.train_rollout, h.test_rollout, h.lr, h.wd"""
    .replace("(run, 5)", "(s.run, 5)"), extra={"s": f"SELECT * FROM ({_SUMMARY_SQL}) q", "h": _HP_SQL}),
          ops=("SRC1", "SRC2", "SRC3", "PRJ1", "PRJ2", "AGG1"))
def results_table_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row for each run: name parsed, hyper-parameters attached,
    metrics summarised, epochs in buckets, sorted by model."""
    logs_root, hp_root = scratch_path(spark, "runlogs"), scratch_path(spark, "hparams")
    write_run_logs(spark, sf_dir, logs_root, F.expr(_FULL_NAME))
    write_hparams(spark, sf_dir, hp_root, F.expr(_FULL_NAME))
    logs = rl.scan_run_logs(spark, logs_root).withColumn("ord", F.struct("file", "row"))
    wide = _fixed_value(rn.summarise_run(logs)).groupBy("run").pivot("name", _SUMMARY_NAMES).agg(F.first("value"))
    t = rl.attach_hparams(wide, rl.scan_hparams(spark, hp_root, glob="*.txt")).withColumn("p", rn.parse_run_name("run"))
    return t.select("p.model", "p.equation", "p.resolution", "p.version", "domain", "params",
                    rn.epoch_bucket("epochs").alias("epochs"), "lookback", "train_rollout", "test_rollout", "lr", "wd",
                    *_SUMMARY_NAMES).orderBy("model", "equation", "version")


# ------------------------------------------------------------ SRC4 / SRC7 (results CSV)
_LOSS16 = f"CASE WHEN {GAP} THEN NULL ELSE loss16 END"
_RESULTS_SQL = with_views(f"""
SELECT model, domain, equation, resolution, {fixed_sql('loss1')} AS loss1,
       {fixed_sql(_LOSS16)} AS loss16, {fixed_sql('test_time')} AS test_time, n
FROM v_runs""", "v_runs")


def _results_path(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "results")
    r = v_runs(spark, sf_dir).withColumn(
        "loss16", F.when(F.expr(GAP), F.lit(float("nan"))).otherwise(F.col("loss16")))
    rl.write_results(r.select("model", "domain", "equation", "loss1", "loss16", "test_time", "n", "resolution"), path)
    return path


@register("src4_scan_results", _RESULTS_SQL, ops=("SRC4", "SRC7"))
def scan_results_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as CSV (NaN for thin cells) and read back with a schema;
    NaN arrives as NULL."""
    r = rl.scan_results(spark, _results_path(spark, sf_dir))
    return r.select("model", "domain", "equation", "resolution", fixed("loss1").alias("loss1"),
                    fixed("loss16").alias("loss16"), fixed("test_time").alias("test_time"), "n")


@register("src7_write_results", with_views("""
SELECT resolution, CAST(COUNT(*) AS BIGINT) AS n_rows, MIN(model) AS first_model FROM v_runs GROUP BY resolution""",
                                           "v_runs"), ops=("SRC7",))
def write_results_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder per resolution; rows per folder and the first model."""
    path = _results_path(spark, sf_dir)
    raw = spark.read.option("header", True).csv(path)
    return raw.groupBy("resolution").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                         F.min("model").alias("first_model"))


# ------------------------------------------------------------ SRC8 (leaderboard sink)
@register("src8_write_leaderboard", with_views("""
SELECT metric, resolution, model, domain, equation, rank FROM (
  SELECT 'loss1' AS metric, g.resolution, g.model, g.domain, g.equation,
         CAST(CASE WHEN v.loss1 IS NULL THEN 1000 ELSE
              RANK() OVER (PARTITION BY g.resolution, g.equation ORDER BY v.loss1 ASC NULLS LAST) - 1 END AS BIGINT) AS rank
  FROM (SELECT * FROM (SELECT DISTINCT resolution, model, domain FROM v_runs) r
        JOIN (SELECT DISTINCT resolution, equation FROM v_runs) c USING (resolution)) g
  LEFT JOIN v_runs v USING (resolution, model, domain, equation)
  UNION ALL
  SELECT 'loss16', g.resolution, g.model, g.domain, g.equation,
         CAST(CASE WHEN v.loss16 IS NULL THEN 1000 ELSE
              RANK() OVER (PARTITION BY g.resolution, g.equation ORDER BY v.loss16 ASC NULLS LAST) - 1 END AS BIGINT)
  FROM (SELECT * FROM (SELECT DISTINCT resolution, model, domain FROM v_runs) r
        JOIN (SELECT DISTINCT resolution, equation FROM v_runs) c USING (resolution)) g
  LEFT JOIN v_runs v USING (resolution, model, domain, equation)) t""", "v_runs"), ops=("SRC8", "WIN1"))
def leaderboard_sink_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank tables of two metrics written one folder per (metric, resolution)
    and read back."""
    r = v_runs(spark, sf_dir)
    ranks = [lb.rank_cells(r, m).select(F.lit(m).alias("metric"), "resolution", "model", "domain", "equation", "rank")
             for m in ("loss1", "loss16")]
    path = scratch_path(spark, "leaderboard")
    rl.write_leaderboard(ranks[0].unionByName(ranks[1]), path)
    back = spark.read.parquet(path)
    return back.select("metric", "resolution", "model", "domain", "equation", "rank")


# ------------------------------------------------------------ SRC5 / SRC6 (partitioned dataset)
def _split_col():
    return F.when(F.dayofmonth("ts") <= 20, "train").when(F.dayofmonth("ts") <= 25, "val").otherwise("test")


def _res_col():
    return (F.when(F.col("value") < 10, "low").when(F.col("value") < 20, "medium")
             .when(F.col("value") < 40, "high").otherwise("full"))
_SPLIT_SQL = "CASE WHEN DAYOFMONTH(ts) <= 20 THEN 'train' WHEN DAYOFMONTH(ts) <= 25 THEN 'val' ELSE 'test' END"
_STRUCT_SQL = "CASE WHEN HOUR(ts) >= 12 THEN 'cloud' ELSE 'grid' END"
_RES_SQL = ("CASE WHEN value < 10 THEN 'low' WHEN value < 20 THEN 'medium' WHEN value < 40 THEN 'high' "
            "ELSE 'full' END")


def _dataset_path(spark: SparkSession, sf_dir: str) -> str:
    ev = table(spark, sf_dir, "events")
    ds = ev.select(F.col("user_id").alias("traj"), "event_id", "ts", "value",
                   F.col("event_type").alias("equation"),
                   F.when(F.hour("ts") >= 12, "cloud").otherwise("grid").alias("structure"),
                   _res_col().alias("resolution"), _split_col().alias("split"))
    path = scratch_path(spark, "dataset")
    rl.write_dataset(ds, path)
    return path


@register("src5_scan_dataset", f"""
SELECT user_id AS traj, event_id, {fixed_sql('value')} AS value FROM events
WHERE event_type = 'click' AND {_STRUCT_SQL} = 'grid' AND {_SPLIT_SQL} = 'test'""", ops=("SRC5",))
def dataset_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one (equation, structure, split) selection; the predicates
    prune partitions at the scan."""
    d = rl.scan_dataset(spark, _dataset_path(spark, sf_dir), equation="click", structure="grid", split="test")
    return d.select("traj", "event_id", fixed("value").alias("value"))


_EQS = ["click", "error", "purchase", "signup", "view", "advection"]
_RESL = ["low", "medium", "high", "full"]


@register("src6_dataset_coverage", f"""
WITH exp AS (
  SELECT e.equation, s.structure, r.resolution FROM
    (SELECT * FROM (VALUES {', '.join(f"('{e}')" for e in _EQS)}) t(equation)) e
    CROSS JOIN (SELECT * FROM (VALUES ('grid'), ('cloud')) t(structure)) s
    CROSS JOIN (SELECT * FROM (VALUES {', '.join(f"('{r}')" for r in _RESL)}) t(resolution)) r
  WHERE NOT (s.structure = 'cloud' AND r.resolution = 'full')),
seen AS (
  SELECT event_type AS equation, {_STRUCT_SQL} AS structure, {_RES_SQL} AS resolution,
         COUNT(CASE WHEN {_SPLIT_SQL} = 'train' THEN 1 END) AS n_train,
         COUNT(CASE WHEN {_SPLIT_SQL} = 'val' THEN 1 END) AS n_val,
         COUNT(CASE WHEN {_SPLIT_SQL} = 'test' THEN 1 END) AS n_test
  FROM events GROUP BY 1, 2, 3)
SELECT COALESCE(exp.equation, seen.equation) AS equation, COALESCE(exp.structure, seen.structure) AS structure,
       COALESCE(exp.resolution, seen.resolution) AS resolution, exp.equation IS NOT NULL AS expected,
       CAST(COALESCE(n_train, 0) AS BIGINT) AS n_train, CAST(COALESCE(n_val, 0) AS BIGINT) AS n_val,
       CAST(COALESCE(n_test, 0) AS BIGINT) AS n_test,
       COALESCE(n_train, 0) + COALESCE(n_val, 0) + COALESCE(n_test, 0) > 0 AS present
FROM exp FULL OUTER JOIN seen ON exp.equation = seen.equation AND exp.structure = seen.structure
                              AND exp.resolution = seen.resolution""", ops=("SRC6",))
def coverage_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(_dataset_path(spark, sf_dir))
    impossible = (F.col("structure") == "cloud") & (F.col("resolution") == "full")
    return rl.dataset_coverage(d, _EQS, ["grid", "cloud"], _RESL, ["train", "val", "test"], impossible)


# ------------------------------------------------------------ ST1 (streaming)
_LOG_SCHEMA = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("epoch", T.IntegerType()),
                            T.StructField("seq", T.LongType()), T.StructField("val_loss", T.DoubleType()),
                            T.StructField("train_step_ms", T.DoubleType())])
_TRIGGERS = 4


@register("st1_best_checkpoint_stream", _BEST_SQL, ops=("ST1", "AGG17"))
def stream_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows land as files in epoch order; a streaming min_by per run keeps
    the best row so far; the final table equals the batch answer.

    A trigger commits the state of every shuffle partition, so it takes a share of
    the files, not one: with a trigger per file the commits would grow with the
    square of the number of partitions."""
    base = scratch_path(spark, "stream")
    src, sink, ckpt = (os.path.join(base, p) for p in ("source", "sink", "checkpoint"))
    lg = v_log(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in _LOG_SCHEMA.fields])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lg.repartitionByRange(n, "epoch", "seq").write.mode("overwrite").parquet(src)
    best = run_best_so_far(spark, src, _LOG_SCHEMA, sink, ckpt, max_files_per_trigger=-(-n // _TRIGGERS))
    return _log_out(best)
