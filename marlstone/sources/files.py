"""Readers of fixture and catalogue files."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.batches import pieces
from marlstone.session import setting

#: Bytes of an Arrow batch of texts to be written; Spark's own bound, 64 MB, is held more than once by each task.
BATCH = "1m"


def opened(path: str):
    """(file system, folder) of a path that every executor can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_bodies(rows: DataFrame, folder: str, name: str, body: str) -> int:
    """Writes each row's text to a file of its own below a shared folder; gives how many there are.

    Files are written by the tasks and renamed at their end, so a task that is run again leaves the same files. Texts are handed
    to the tasks and taken by them a few at a time.
    """

    def run(frames):
        import pyarrow as pa

        system, root = opened(folder)
        n = 0
        for b in pieces(frames, body):
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{root}/{file}"
                system.create_dir(posixpath.dirname(at), recursive=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write((text or "").encode())
                system.move(part, at)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH):
        return rows.select(name, body).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A source catalogue, one JSON record a line; a broken line is an error."""
    return spark.read.option("mode", "FAILFAST").json(path)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """(case, text, gold): input texts beside their expected records, by file stem."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.(?:input\.txt|gold\.json)$", 1)
    texts = spark.read.text(f"{folder}/*.input.txt", wholetext=True).select(stem.alias("case"), F.col("value").alias("text"))
    gold = spark.read.text(f"{folder}/*.gold.json", wholetext=True).select(stem.alias("case"), F.col("value").alias("gold"))
    return texts.join(gold, "case", "left")


def documents_with_links(spark: SparkSession, folder: str) -> DataFrame:
    """(url, body) of files whose first line is their address."""
    raw = spark.read.text(folder, wholetext=True)
    return raw.select(F.trim(F.substring_index("value", "\n", 1)).alias("url"), F.regexp_replace("value", r"^[^\n]*\n?", "").alias("body"))
