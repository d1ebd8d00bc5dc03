"""Scans and sinks for run logs, hyper-parameter files, results tables,
leaderboards and partitioned datasets.

Run logs are CSV files at ``<root>/<run>/<version>/<file>.csv`` whose column
sets differ from file to file. They are read line by line (a large file is
split over tasks), cut into cells under the header of their file, and returned in long
form ``(run, file, row, metric, value)``: the union of ragged files is then
just a union of rows, with no per-file schema handling on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.common import salted_join

HPARAM_KEYS = {
    # output column: (yaml key, nested under hparams, type)
    "params": ("trainable_parameters", False, "bigint"),
    "batch_size": ("batch_size", False, "bigint"),
    "domain": ("Structure", True, "string"),
    "epochs": ("Epochs", True, "bigint"),
    "hp_batch_size": ("Batch_size", True, "bigint"),
    "lookback": ("lookback", True, "bigint"),
    "train_rollout": ("TrainRollout", True, "bigint"),
    "test_rollout": ("TestRollout", True, "bigint"),
    "lr": ("LearningRate", True, "double"),
    "wd": ("WeightDecay", True, "double"),
}

RESULTS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("equation", T.StringType()), T.StructField("loss1", T.DoubleType()),
    T.StructField("loss16", T.DoubleType()), T.StructField("test_time", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("resolution", T.StringType()),
])


def _dir_name(path: Column, up: int) -> Column:
    """Name of the directory ``up`` levels above a file. A path is URL-encoded;
    a Hive-style ``key=value`` name is its value, whose own escapes go too."""
    name = F.url_decode(F.element_at(F.split(path, "/"), -(up + 1)))
    return F.when(name.rlike("^[^=/]+="), F.url_decode(F.regexp_replace(name, "^[^=/]+=", ""))).otherwise(name)


def _whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    # format("text").load: the text() shortcut would reset wholetext to its default
    return (spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
                 .option("wholetext", "true").load(root)
                 .select(F.col("_metadata.file_path").alias("file"), "value"))


# a comma outside of quotes
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    """Cells of a CSV line: quotes taken off, doubled quotes inside made one."""
    return F.transform(F.split(line, _COMMA, -1), lambda c: F.when(
        F.trim(c).rlike('^".*"$'), F.replace(F.regexp_extract(F.trim(c), '^"(.*)"$', 1), F.lit('""'), F.lit('"'))).otherwise(c))


def scan_run_logs(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """SRC1 / SET1: every ``*.csv`` under ``root`` -> (run, file, row, metric,
    value); run = grandparent directory of the file. Cells may be quoted (but
    hold no line break). Empty and NaN cells, and cells that are no number, are
    dropped. Several files of one run simply contribute more rows.

    Files are read line by line, so a large one is split over many tasks. The
    header (first line) of each file and the first line of each split are a
    small aggregate, joined back by salted keys; ``row`` is the split's first
    byte plus the line's number in it, which grows down the file."""
    lines = (spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
                  .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                          F.monotonically_increasing_id().alias("mid"), F.rtrim("value").alias("line"))
                  .where(F.col("line") != ""))
    splits = lines.groupBy("file", "at").agg(F.min("mid").alias("first"), F.min_by("line", "mid").alias("line"))
    header = splits.groupBy("file").agg(F.min_by("line", "at").alias("header"), F.min("at").alias("top"))
    splits = splits.select("file", "at", "first").join(header, "file")
    f = salted_join(lines, splits, ["file", "at"], ["mid"])
    f = f.where((F.col("at") > F.col("top")) | (F.col("mid") > F.col("first")))
    cells = F.arrays_zip(_cells(F.col("header")).alias("metric"), _cells(F.col("line")).alias("v"))
    c = f.select(_dir_name(F.col("file"), 2).alias("run"), "file", (F.col("at") + F.col("mid") - F.col("first")).alias("row"),
                 F.explode(cells).alias("_c"))
    val = F.trim("_c.v").try_cast("double")
    return (c.select("run", "file", "row", F.trim("_c.metric").alias("metric"), val.alias("value"))
             .where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("metric").isNotNull()))


def scan_hparams(spark: SparkSession, root: str, glob: str = "*.yaml") -> DataFrame:
    """SRC2: every ``*.yaml`` under ``root`` -> one row per file with the keys
    the results table uses (``HPARAM_KEYS``); run = grandparent directory."""
    f = _whole_files(spark, root, glob)
    # the block of lines indented under a top-level "hparams:"
    under = F.regexp_extract("value", r"(?m)^hparams:[ \t]*\r?\n((?:[ \t]+[^\n]*(?:\n|$)|[ \t]*\r?\n)*)", 1)
    f = f.select(_dir_name(F.col("file"), 2).alias("run"), "value", under.alias("nested"))
    cols = []
    for out, (key, nested, typ) in HPARAM_KEYS.items():
        text, indent = ("nested", r"[ \t]+") if nested else ("value", "")
        raw = F.regexp_extract(text, rf"(?m)^{indent}{key}:[ \t]*(.*?)[ \t\r]*$", 1)
        raw = F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")
        cols.append(F.when(raw != "", raw).try_cast(typ).alias(out))
    return f.select("run", *cols)


def attach_hparams(runs: DataFrame, hparams: DataFrame, key: str = "run") -> DataFrame:
    """SRC3: join run summaries to their hyper-parameters by run key (left)."""
    return runs.join(hparams, key, "left")


def write_results(df: DataFrame, path: str, sort_by: str = "model", partition_by: str = "resolution") -> None:
    """SRC7: results table as CSV with header, partitioned by resolution,
    rows sorted by model inside each file."""
    # a global range sort: one resolution may span many tasks, files stay sorted
    (df.orderBy(partition_by, sort_by)
       .write.mode("overwrite").partitionBy(partition_by).option("header", True).csv(path))


def scan_results(spark: SparkSession, path: str, schema: T.StructType = RESULTS_SCHEMA) -> DataFrame:
    """SRC4: read a results CSV with an explicit schema; NaN becomes NULL."""
    df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)
    for f in schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(f.name, F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name)))
    return df


def write_leaderboard(df: DataFrame, path: str, partition_by: Sequence[str] = ("metric", "resolution")) -> None:
    """SRC8: one output folder per (metric, resolution)."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


DATASET_KEYS = ("equation", "structure", "resolution", "split")


def write_dataset(df: DataFrame, path: str, keys: Sequence[str] = DATASET_KEYS) -> None:
    """Write samples partitioned by (equation, structure, resolution, split).
    No shuffle by the partition keys: a key holding a large share of the rows
    is written by all the tasks that hold it (files capped by
    ``spark.sql.files.maxRecordsPerFile`` when set)."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def scan_dataset(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """SRC5: select samples by partition values, e.g. ``equation="wave",
    split="test"``; the filters prune partitions at the scan."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        if k not in DATASET_KEYS:
            raise ValueError(f"unknown partition key {k}")
        df = df.where(F.col(k) == v)
    return df


def dataset_coverage(dataset: DataFrame, equations: Sequence[str], structures: Sequence[str],
                     resolutions: Sequence[str], splits: Sequence[str],
                     impossible: Column | None = None) -> DataFrame:
    """SRC6: expected (equation, structure, resolution) combinations (minus
    ``impossible``) against what the dataset holds, with row counts per split
    (0 when absent) and a ``present`` flag; unexpected combinations found in
    the data are kept too (full outer join)."""
    spark = dataset.sparkSession
    exp = spark.range(1).select(F.explode(F.array(*[F.lit(e) for e in equations])).alias("equation"))
    exp = exp.select("*", F.explode(F.array(*[F.lit(s) for s in structures])).alias("structure"))
    exp = exp.select("*", F.explode(F.array(*[F.lit(r) for r in resolutions])).alias("resolution"))
    if impossible is not None:
        exp = exp.where(~impossible)
    exp = exp.withColumn("expected", F.lit(True))
    seen = dataset.groupBy("equation", "structure", "resolution").pivot("split", list(splits)).count()
    j = exp.join(seen, ["equation", "structure", "resolution"], "full")
    out = j.select("equation", "structure", "resolution",
                   F.coalesce("expected", F.lit(False)).alias("expected"),
                   *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"n_{s}") for s in splits])
    present = sum((F.col(f"n_{s}") for s in splits), F.lit(0)) > 0
    return out.withColumn("present", present)
