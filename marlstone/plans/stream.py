"""Streaming queries, run until their input is drained."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from marlstone.plans.registry import Registry
from marlstone.session import shared_dir
from marlstone.streaming import ingest, sessions
from marlstone.streaming.quota import OUT, window_quota

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@contextlib.contextmanager
def rocksdb(spark):
    """The state store that stateful operators with timers and maps need, for as long as a stream runs."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(store, before)


def _stream(spark, d, name):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("stream_ingest_available_now", "SELECT event_id, user_id, event_type, 'new' AS update_state FROM events")
def stream_ingest_available_now(spark, d):
    store = ingest.Versions(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    ingest.merge_stream(_stream(spark, d, "events"), store, "event_id", ["user_id", "event_type"], "ts", "2026-01-01")
    return store.read().select("event_id", "user_id", "event_type", "update_state")


@query("stream_change_feed", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def stream_change_feed(spark, d):
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    ingest.append_once(_stream(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus"), folder)
    return spark.read.parquet(folder).select("o_orderkey", "o_orderstatus")


@query(
    "stream_quota_window",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT user_id, event_id, r, t AS open, 1 AS n FROM e WHERE r = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.r, CASE WHEN e.t - f.open >= 86400 THEN e.t ELSE f.open END, CASE WHEN e.t - f.open >= 86400 THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
    SELECT user_id, event_id, n <= 2 AS allowed FROM f""",
)
def stream_quota_window(spark, d):
    folder = f"{shared_dir(spark)}/quota-{uuid.uuid4().hex}"
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    with rocksdb(spark):
        ingest.append_once(window_quota(_stream(spark, d, "events").select("user_id", "event_id", t.alias("t")), 2, 86400), folder)
    return spark.read.schema(OUT).parquet(folder).select("user_id", "event_id", "allowed")


#: Seconds without a step after which a session ends.
IDLE = 12 * 3600.0


def session_steps(events):
    """Steps of sessions out of events: three finds to an opening, of addresses that recur, most of them lacking something."""
    k = F.col("event_id")
    some = lambda c, m, r: F.when(k % m == r, F.concat(F.lit(c), k.cast("string")))
    return events.select(
        F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"), k.alias("n"), F.when(F.col("event_type") == "view", "opened").otherwise("found").alias("kind"),
        F.concat(F.lit("https://c.org/"), (F.floor(F.col("value")) % 9).cast("string")).alias("url"), some("t", 2, 0).alias("title"), some("p", 3, 0).alias("place"), F.when(k % 5 != 0, "2026-05-01").alias("day"),
    )


@query("session_candidates")
def session_candidates(spark, d):
    """Outcomes of all steps and of expiries that a later step of the same session brought about."""
    folder = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    with rocksdb(spark):
        ingest.append_once(sessions.streamed(session_steps(_stream(spark, d, "events")), IDLE), folder)
    return spark.read.schema(sessions.OUT).parquet(folder).select(*sessions.COLUMNS)
