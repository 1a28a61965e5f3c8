"""Stores that are kept up by small batches: elections by touched clusters, ingest by sources that commit each for itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import breaker, merge
from marlstone.operators.election import reelect
from marlstone.session import cut, shared_dir
from marlstone.streaming import ingest
from marlstone.streaming.slices import Slices

BUCKETS = 64
CLUSTERS = "event_id string, content_key string, superseded boolean"


def clusters(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> Slices:
    """A store of elected rows, filed by their key; rows without a key are never superseded and aren't in it."""
    return Slices(spark, folder, CLUSTERS, _bucket("content_key", buckets))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


def elect_batch(store: Slices, changes: DataFrame, rank: Column | None = None, stream: str = "", batch: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Brings a store of clusters up to date and gives (event_id, superseded) of the rows whose flag is another than before.

    changes: (event_id, old_key, new_key), as a merge's before and after images have them. Only the buckets of touched keys are
    read and written; of their rows only those of touched keys are elected. A batch that is run again gives the same. The rows given are
    computed when they are asked for, from the versions before this one.
    """
    changes = cut(changes.select("event_id", "old_key", "new_key"))
    keys = changes.select(F.explode(F.array("old_key", "new_key")).alias("content_key")).where("content_key <> ''")
    touched = [r[0] for r in keys.select(_bucket("content_key", buckets)).distinct().collect()]  # at most `buckets`
    before, version = store.place(stream, batch)
    stored = store.read(touched, before)
    anew = reelect(stored, changes, rank)
    store.publish(anew.select("event_id", "content_key", "superseded"), {b: {} for b in touched}, version, stream, batch)
    # Flags are only compared where they are asked for. A row that came from another cluster has the flag that it had there.
    left = changes.where("old_key <> ''").select("event_id", F.col("old_key").alias("content_key")).join(stored, ["event_id", "content_key"]).select("event_id", F.col("superseded").alias("_left"))
    both = anew.join(left, "event_id", "left").withColumn("was", F.when(F.col("come"), F.coalesce("_left", "was", F.lit(False))).otherwise(F.col("was")))
    flipped = both.where("superseded <> coalesce(was, false)")
    freed = changes.where("old_key <> '' AND coalesce(new_key, '') = ''").join(left.where("_left"), "event_id", "left_semi")
    return flipped.select("event_id", "superseded").unionByName(freed.select("event_id", F.lit(False).alias("superseded")))


def commit_sources(store: Slices, batch: DataFrame, report: DataFrame, key: str, source: str, fields: list[str], now: str, stream: str = "", number: int = 0, floor: int = 1, drop_to: float = 0.5, most_changed: float = 0.0) -> dict[str, str | None]:
    """Merges a batch into a store sliced by source, each source for itself; gives why a source wasn't applied (None: it was).

    report: one row for a source, (source, discovered, finished). A source that was interrupted ("cancelled") or that the breaker
    refuses keeps its stored rows and its note, that is the counts of its last good batch, which its next batch is
    judged by; rows that it has sent are dropped. All sources that pass are published in one version. Sources are few and
    their counts are on the driver. Rows of sources without a report are dropped. A key belongs to one source and comes once in a batch.
    """
    before, version = store.place(stream, number)
    last = [(s, note["discovered"]) for s, (_, _, note) in store.current(before).items()]
    told = report.select(F.col(source).alias("s"), "discovered", "finished").join(F.broadcast(report.sparkSession.createDataFrame(last, "s string, last long")), "s", "left")
    inc = merge.hashed(batch.select(source, key, *fields), fields)
    change = breaker.changed_fraction(inc, store.read(None, before), key, source).withColumnRenamed(source, "s")
    reason = breaker.decision(F.col("discovered"), F.coalesce("last", F.lit(0)), F.coalesce("changed", F.lit(0)), F.coalesce("known", F.lit(0)), floor, drop_to, most_changed)
    judged = told.join(change, "s", "left").select("s", "discovered", F.when(~F.col("finished"), "cancelled").otherwise(reason).alias("reason")).collect()
    why = {r.s: r.reason for r in judged}
    good = [s for s, reason in why.items() if reason is None]
    if not good:
        return why
    inc = inc.where(F.col(source).isin(good))
    both = merge.joined(store.read(good, before), inc, key)
    rows = cut(merge.snapshot(both, key, [source, *fields], F.lit(now), F.lit(now)))
    count = lambda df: dict(df.groupBy(source).count().collect())
    parsed, held = count(inc), count(rows)
    notes = {r.s: {"discovered": r.discovered, "parsed": parsed.get(r.s, 0), "stored": held.get(r.s, 0)} for r in judged if r.reason is None}
    store.publish(rows, notes, version, stream, number)
    return why


def keyed(spark: SparkSession, folder: str, key: str, fields: dict[str, str], buckets: int = BUCKETS) -> Slices:
    """A store of snapshots (`merge.snapshot`) filed by their key; fields: types by name, the key's with them."""
    cols = ", ".join(f"{f} {t}" for f, t in fields.items())
    return Slices(spark, folder, f"{cols}, content_hash string, created_at string, updated_at string, last_checked_at string, update_state string", _bucket(key, buckets))


def merge_stream(stream: DataFrame, store: Slices, key: str, fields: list[str], order: str, now: str, checkpoint: str | None = None, buckets: int = BUCKETS) -> None:
    """Merges a stream into a store of `keyed`, batch by batch, as `ingest.merge_stream` does with whole versions; a batch
    reads and writes the buckets of its own keys only, so a small one costs little however large the store is.

    The checkpoint's folder names the stream, so that its micro-batches are known again after a restart.
    """
    folder = checkpoint or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        before, version = store.place(folder, number)
        inc = cut(merge.hashed(merge.latest(batch, key, order).select(key, *fields), fields))
        touched = [r[0] for r in inc.select(_bucket(key, buckets)).distinct().collect()]  # at most `buckets`
        if touched:
            both = merge.joined(store.read(touched, before), inc, key)
            store.publish(merge.snapshot(both, key, fields, F.lit(now), F.lit(now)), {b: {} for b in touched}, version, folder, number)

    ingest.drain(stream, each, folder)


def sources(spark: SparkSession, folder: str, key: str, source: str, fields: dict[str, str]) -> Slices:
    """A store sliced by source, of (key, source, fields, content_hash, times, update_state); fields: their types by name."""
    own = ", ".join([f"{key} string", f"{source} string", *(f"{f} {t}" for f, t in fields.items())])
    return Slices(spark, folder, f"{own}, content_hash string, created_at string, updated_at string, last_checked_at string, update_state string", F.col(source))
