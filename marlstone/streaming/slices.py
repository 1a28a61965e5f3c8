"""A table in slices, each published by versions of its own: what a batch doesn't touch is neither read nor written."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "version long, slice string, empty boolean, note string, stream string, batch long"


class Slices:
    """The newest version of each slice of a table in one folder.

    A version writes some slices anew and counts once its marker has been written after them; the marker names all of
    them, so they change together or not at all, and the others stay as they were. A note (any JSON object) is kept for each slice and
    changes with it. Slices are few by design (sources, or a fixed number of buckets): their names are on the driver,
    their rows never are. A marker also names the stream and micro-batch that it comes from; one that is run again
    sees what it had seen before and writes its own version anew.

    schema: the rows' columns. by: the slice of a row, as a text without nulls.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, by: Column):
        self.spark, self.folder, self.schema, self.by = spark, folder.rstrip("/"), schema, by

    def _markers(self) -> list:
        try:
            return self.spark.read.schema(MARKER).parquet(f"{self.folder}/published").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def place(self, stream: str = "", batch: int = 0) -> tuple[int, int]:
        """(first version that isn't to be seen, version to write) of a micro-batch; the same both times if it's run again."""
        known = self._markers()
        mine = next((m.version for m in known if (m.stream, m.batch) == (stream, batch)), None)
        if mine is None:
            mine = known[-1].version + 1 if known else 0
        return mine, mine

    def current(self, before: int | None = None) -> dict[str, tuple[int, bool, dict]]:
        """(version, whether it is empty, note) of each slice, of versions below `before`."""
        return {m.slice: (m.version, m.empty, json.loads(m.note)) for m in self._markers() if before is None or m.version < before}

    def read(self, slices: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the slices named, or of all; only the folders that hold them are read."""
        held = {s: v for s, (v, empty, _) in self.current(before).items() if not empty}
        if slices is not None:
            wanted = set(slices)
            held = {s: v for s, v in held.items() if s in wanted}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        by_version: dict[int, list[str]] = {}
        for s, v in held.items():
            by_version.setdefault(v, []).append(s)
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").schema(f"{self.schema}, _version long, _slice string").parquet(*[f"{self.folder}/rows/_version={v}" for v in sorted(by_version)])
        keep = F.lit(False)
        for v, names in by_version.items():
            keep |= (F.col("_version") == v) & F.col("_slice").isin([f"s{n}" for n in names])
        return rows.where(keep).drop("_version", "_slice")

    def publish(self, df: DataFrame, notes: dict[str, dict], version: int, stream: str = "", batch: int = 0) -> None:
        """Writes the slices that `notes` names, with the rows of `df` that belong to them; a slice without rows becomes empty."""
        at = f"{self.folder}/rows/_version={version}"
        mine = df.withColumn("_slice", F.concat(F.lit("s"), self.by)).where(F.col("_slice").isin([f"s{n}" for n in notes]))
        mine.hint("rebalance", "_slice").write.mode("overwrite").partitionBy("_slice").parquet(at)
        try:
            full = {r["_slice"] for r in self.spark.read.schema(f"{self.schema}, _slice string").parquet(at).select("_slice").distinct().collect()}
        except AnalysisException as e:  # nothing but a mark of success was written
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            full = set()
        marks = [(version, n, f"s{n}" not in full, json.dumps(note), stream, batch) for n, note in notes.items()]
        self.spark.createDataFrame(marks, MARKER).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/published/at={version}")
