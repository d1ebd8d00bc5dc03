"""Corpus pipeline: five stages from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
what a stage returns to the shared folder and reads it again for the next one,
so a lost executor costs at most one stage. All but the last return the columns
of ``documents``.

1. quality rules: template lines go, documents that fail go;
2. SimHash near-duplicates: the smallest id of each group stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. personal data: spans are replaced by their kind;
5. mixing: each document as often as its rate says, with ``rate`` and ``copy``.

The SQL of this pipeline would need the fingerprints of the second stage, a
hash that DuckDB does not have, and the fitted rates of the last, so ORACLE_SQL
is None; ``tests/llm`` hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, mixing, pii, quality, simhash
from tidewater.llm.common import read
from tidewater.operators.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, size=simhash.SHINGLE, radius=simhash.RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, read(spark, sf_dir, "labels"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
