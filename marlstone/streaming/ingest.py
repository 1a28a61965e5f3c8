"""Incremental ingest and its state, on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import merge
from marlstone.operators.sequence import first_seen
from marlstone.session import shared_dir


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Runs all available input through `each`, one micro-batch at a time, and stops. The checkpoint makes it resumable."""
    folder = checkpoint or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", folder).foreachBatch(each).start().awaitTermination()


class Versions:
    """A table published by whole versions in one folder; a version counts once its marker has been written after it.

    A marker names the stream and micro-batch that the version comes from. A micro-batch that is run again, in this process
    or another one, reads the version that it had read before and writes its own one anew; so applying it is idempotent,
    nothing is read from a folder that is being written, and a new process goes on from the last version.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _markers(self) -> list:
        """A row for each published version; their number is that of micro-batches, not of records."""
        try:
            return self.spark.read.schema("version long, stream string, batch long").parquet(f"{self.folder}/published").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def place(self, stream: str, batch: int) -> tuple[int | None, int]:
        """(version to read, version to write) of a micro-batch."""
        known = self._markers()
        mine = next((m.version for m in known if (m.stream, m.batch) == (stream, batch)), None)
        if mine is None:
            mine = known[-1].version + 1 if known else 0
        return next((m.version for m in reversed(known) if m.version < mine), None), mine

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version, or the last one; None if there is none."""
        if version is None:
            known = self._markers()
            if not known:
                return None
            version = known[-1].version
        return self.spark.read.parquet(f"{self.folder}/v={version}")

    def publish(self, df: DataFrame, version: int, stream: str = "", batch: int = 0) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        marker = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch"))
        marker.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/published/at={version}")


def merge_stream(stream: DataFrame, store: Versions, key: str, fields: list[str], order: str, now: str, checkpoint: str | None = None) -> None:
    """Merges a stream of records into a store, batch by batch; records equal to the stored ones change nothing.

    The checkpoint's folder names the stream, so that its micro-batches are known again after a restart.
    """
    folder = checkpoint or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        old, new = store.place(folder, number)
        inc = merge.hashed(merge.latest(batch, key, order).select(key, *fields), fields)
        if old is None:
            prev = inc.limit(0).withColumns({c: F.lit(None).cast("string") for c in ("created_at", "updated_at", "last_checked_at", "update_state")})
        else:
            prev = store.read(old)
        both = merge.joined(prev, inc, key)
        store.publish(merge.snapshot(both, key, fields, F.lit(now), F.lit(now)), new, folder, number)

    drain(stream, each, folder)


def append_once(stream: DataFrame, store: str, checkpoint: str | None = None) -> None:
    """Appends a change feed to a folder, once per micro-batch: a batch run again replaces what it had written."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    drain(stream, each, checkpoint)


def _seen(rows: Observation) -> int:
    """Rows that an observation has counted; none where the optimiser knew that there are none and left it out of the plan."""
    try:
        return rows.get.get("n", 0)
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return 0


def add_missing(stored: DataFrame | None, incoming: DataFrame, key: list[str], order: list[str], good: Column, folder: str) -> dict[str, int]:
    """Writes to `folder` the rows of `incoming` that are good and whose key isn't stored, the first of each key in `order`; gives
    the counts raw, dropped (not good), repeated (of a key already there) and added.

    The counts are observed on the way while the rows are written: no second job, and no second scan. An executor that
    is lost may make Spark count rows of a repeated task once more in the observation, never in what is written. Null `good` is not good.
    """
    raw, kept, added = (Observation() for _ in range(3))
    n = F.count(F.lit(1)).alias("n")
    rows = incoming.observe(raw, n).where(F.coalesce(good, F.lit(False))).observe(kept, n)
    rows = first_seen(rows, key, order)
    if stored is not None:
        same = stored.select(*[F.col(k).alias(f"_{k}") for k in key])
        on = F.lit(True)
        for k in key:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(same, on, "left_anti")
    rows.observe(added, n).write.mode("overwrite").parquet(folder)
    got = {k: _seen(o) for k, o in (("raw", raw), ("kept", kept), ("added", added))}
    return {"raw": got["raw"], "dropped": got["raw"] - got["kept"], "repeated": got["kept"] - got["added"], "added": got["added"]}
