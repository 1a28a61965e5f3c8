"""A corpus from raw documents to packed sequences, in stages that each read the table the one before has written.

A stage works on every row that its predecessor kept and returns the columns of `documents`; the last returns the pieces'
places. Rows with null or empty texts fail the quality rules, so an empty table may come out of the first stage; every
stage takes one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, packing, quality, secrets, similar
from marlstone.llm.common import shared_dir

#: SQL can't express the rolling-hash verdicts, fingerprints, decoding, schedules and packing; tests use brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8."""
    return similar.keep_one(docs, k=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole, as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _written(spark: SparkSession, at: str) -> bool:
    """Whether a stage's table is there as a whole: Spark marks it at its end."""
    system, path = _path(spark, f"{at}/_SUCCESS")
    return system.exists(path)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Applies the stages to `documents`; each one's table is written to the shared folder and read again.

    folder: where the tables of this run lie, by default a new one. A run with the folder of one that broke off goes on behind
    the last stage that had been written. A stage's table is removed once the next one stands; the last one stays, as it
    is the result.
    """
    folder = folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    at = [f"{folder}/{name}" for name, _ in STAGES]
    first = max((i + 1 for i, x in enumerate(at) if _written(spark, x)), default=0)
    docs = spark.read.parquet(at[first - 1] if first else f"{sf_dir}/documents.parquet")
    for i in range(first, len(STAGES)):
        STAGES[i][1](spark, docs, sf_dir).write.mode("overwrite").parquet(at[i])
        docs = spark.read.parquet(at[i])
        if i:
            system, path = _path(spark, at[i - 1])
            system.delete(path, True)
    return docs
