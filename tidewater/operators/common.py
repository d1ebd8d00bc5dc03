"""Small DataFrame helpers shared by operator modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame (a global aggregate) to every
    row as constants. The aggregate runs once as an uncorrelated scalar
    subquery (partial + final aggregate) and is substituted as a value, so
    there is no join, no shuffle of the large side and no single-partition
    window."""
    cols = scalars.columns
    packed = scalars.select(F.struct(*cols).alias("_s")).scalar()
    out = df.withColumn("_scalars", packed)
    return out.select(*df.columns, *[F.col("_scalars")[c].alias(c) for c in cols])


# parts that the rows of a heavy key are dealt into by salted_join
SALTS = 16
# a key is heavy when it holds more than one row in HEAVY: fewer than HEAVY keys
# can be, whatever the table's size
HEAVY = 64
# counters of the sketch that finds heavy keys; its error is about one row in
# 0.75 * TRACKED, well below one in HEAVY
TRACKED = 4096


def heavy_keys(rows: DataFrame, keys: list[str], weight: str | None = None) -> Column:
    """Hashes of the heavy keys of ``rows`` as one array value, an uncorrelated
    scalar subquery. With ``weight`` a key has one row and that column says how
    many it stands for, so the shares are exact; without, a mergeable
    heavy-hitter sketch (Misra-Gries counters) of the keys finds them in one
    pass with nothing shuffled but the counters."""
    h = F.xxhash64(*keys)
    if weight is None:
        got = rows.select(h.alias("_h")).agg(
            F.expr(f"approx_top_k(_h, {HEAVY}, {TRACKED})").alias("_top"), F.count(F.lit(1)).alias("_all"))
        return got.select(F.transform(F.filter("_top", lambda t: t["count"] * HEAVY > F.col("_all")), lambda t: t["item"]).alias("_h")).scalar()
    w = rows.select(h.alias("_h"), F.col(weight).cast("double").alias("_w"))
    total = w.agg(F.sum("_w").alias("_all")).scalar()
    return w.where(F.col("_w") * HEAVY > total).agg(F.collect_list("_h").alias("_h")).scalar()


def _is_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the table's size lets it broadcast it."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
                null_safe: bool = False, salts: int = SALTS, weight: str | None = None,
                counted: DataFrame | None = None) -> DataFrame:
    """Join a table that may have hot keys with one that has a row for each key.

    Only heavy keys are salted: their rows in ``big`` are dealt over ``salts``
    sub-keys by the hash of ``spread``, and their rows in ``small`` are repeated
    for each, so half of all rows on one key still go to ``salts`` tasks while a
    light key keeps its one row. AQE splits a skewed join only where both sides
    come straight from a shuffle; a joined-back aggregate does not. ``weight``
    names a column of ``small`` with the number of rows a key has in ``big``
    (known where ``small`` is an aggregate of it, and then exact); otherwise the
    keys of ``counted`` are sketched, by default those of ``big``, which then is
    read for its keys once more. Which keys are heavy changes where rows go,
    never the result. A small side that Spark's size estimate lets it broadcast
    is joined as it is. With ``null_safe`` a null key finds the null row."""
    if _is_broadcast(small):
        right = small.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        on = [big[k].eqNullSafe(right[f"_r_{k}"]) if null_safe else big[k] == right[f"_r_{k}"] for k in keys]
        return big.join(right, on, how).drop(*[f"_r_{k}" for k in keys])
    heavy = heavy_keys(small if weight else big if counted is None else counted, keys, weight)
    is_heavy = F.array_contains(heavy, F.xxhash64(*keys))
    salted = big.withColumn("_salt", F.when(is_heavy, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = small.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in small.columns if c not in keys],
        F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_r_salt"))
    on = [salted[k].eqNullSafe(right[f"_r_{k}"]) if null_safe else salted[k] == right[f"_r_{k}"] for k in keys]
    joined = salted.join(right, [*on, salted["_salt"] == right["_r_salt"]], how)
    return joined.drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it as a Parquet table in a fresh
    folder under the shared checkpoint folder and reading it back. One write
    job; the read-back carries file-size statistics (so joins can size their
    strategy) and supports column pruning, unlike a checkpointed RDD."""
    from tidewater.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
