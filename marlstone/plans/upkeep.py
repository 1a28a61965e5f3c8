"""Queries of stores kept up by batches: incremental elections, sources that commit each for itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.operators import caching, enrich, naming
from marlstone.plans.registry import Registry
from marlstone.session import shared_dir
from marlstone.sources.tables import table
from marlstone.streaming import ingest, upkeep

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _orders(spark, d):
    """(event_id, k, key, rank): an order's id, number, customer and its source's authority."""
    k = F.col("o_orderkey")
    source = F.element_at(F.array(*map(F.lit, ["coex", "showala", "kintex"])), (k % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(F.concat_ws("-", source, F.format_string("%010d", k)).alias("event_id"), k.alias("k"), F.col("o_custkey").alias("key"))


@query(
    "incremental_election",
    """WITH e AS (SELECT (['coex', 'showala', 'kintex'])[o_orderkey % 3 + 1] || '-' || printf('%010d', o_orderkey) AS event_id, CASE WHEN o_orderkey % 3 = 1 THEN 10 ELSE 100 END AS rank,
    CASE WHEN o_orderkey % 16 = 0 THEN NULL WHEN o_orderkey % 8 = 0 THEN (o_custkey + 1)::VARCHAR ELSE o_custkey::VARCHAR END AS content_key FROM orders)
    SELECT event_id, content_key, row_number() OVER (PARTITION BY content_key ORDER BY rank DESC, event_id) > 1 AS superseded FROM e WHERE content_key IS NOT NULL""",
)
def incremental_election(spark, d):
    """Four batches: most orders; the others; some move to the next customer's cluster; some of these lose their key."""
    store = upkeep.clusters(spark, folder(spark, "clusters"), 16)
    o, none = _orders(spark, d), F.lit(None).cast("string")
    own, moved = F.col("key").cast("string"), (F.col("key") + 1).cast("string")
    batches = [(F.col("k") % 4 < 3, none, own), (F.col("k") % 4 == 3, none, own), (F.col("k") % 8 == 0, own, moved), (F.col("k") % 16 == 0, moved, none)]
    for n, (rows, old, new) in enumerate(batches):
        upkeep.elect_batch(store, o.where(rows).select("event_id", old.alias("old_key"), new.alias("new_key")), stream="orders", batch=n, buckets=16)
    return store.read()


@query(
    "source_commits",
    """SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS source, CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
    CASE WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderkey % 2 = 1 THEN 'new' WHEN o_orderkey % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS update_state
    FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 2 = 0""",
)
def source_commits(spark, d):
    """The second of two batches is cut off in the middle of one source, which keeps its rows and counts of the first."""
    store = upkeep.sources(spark, folder(spark, "sources"), "id", "source", {"price": "double"})
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.cast("string").alias("id"), k.alias("k"), F.col("o_orderstatus").alias("source"), F.col("o_totalprice").alias("price"))
    first = o.where("k % 2 = 0")
    second = o.where("source <> 'O' OR k % 3 = 0").withColumn("price", F.when(F.col("k") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    for n, (batch, cut_off) in enumerate([(first, ""), (second, "O")]):
        report = batch.groupBy("source").agg(F.count("*").alias("discovered")).withColumn("finished", F.col("source") != cut_off)
        upkeep.commit_sources(store, batch, report, "id", "source", ["price"], f"2026-01-0{n + 1}", "orders", n, drop_to=0.5)
    return store.read().select("id", "source", "price", "update_state")


@query(
    "robots_cache",
    """WITH RECURSIVE q AS (SELECT event_id, user_id % 60 AS host, epoch_us(ts) / 1000000.0::DOUBLE AS t, (event_id % 400)::DOUBLE AS took, event_id % 5 <> 0 AS ok FROM events),
    m AS (SELECT host, t, arg_min(took, event_id) AS took, arg_min(ok, event_id) AS ok, row_number() OVER (PARTITION BY host ORDER BY t) AS r FROM q GROUP BY host, t),
    f AS (SELECT host, r, t AS started, t + took AS ended, t + took + CASE WHEN ok THEN 86400 ELSE 0 END AS until, ok FROM m WHERE r = 1 UNION ALL
      SELECT m.host, m.r, CASE WHEN m.t >= f.until AND m.t > f.started THEN m.t ELSE f.started END, CASE WHEN m.t >= f.until AND m.t > f.started THEN m.t + m.took ELSE f.ended END,
        CASE WHEN m.t >= f.until AND m.t > f.started THEN m.t + m.took + CASE WHEN m.ok THEN 86400 ELSE 0 END ELSE f.until END, CASE WHEN m.t >= f.until AND m.t > f.started THEN m.ok ELSE f.ok END
      FROM f JOIN m ON m.host = f.host AND m.r = f.r + 1)
    SELECT q.event_id, round(f.started, 3) AS started, round(greatest(f.ended - q.t, 0), 3) AS waits, f.ok AS got FROM q JOIN m ON m.host = q.host AND m.t = q.t JOIN f ON f.host = m.host AND f.r = m.r""",
)
def robots_cache(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 60).alias("host"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (k % 400).cast("double").alias("took"), (k % 5 != 0).alias("ok"))
    held = caching.fetches(e, "host", "t", "event_id", "took", "ok")
    return caching.served(e, held, "host", "t").select("event_id", F.round("started", 3).alias("started"), F.round("waits", 3).alias("waits"), "got")


_STEP = "l_linenumber % 4 AS rank, (['parsed', 'page', 'actions', 'model'])[l_linenumber % 4 + 1] AS origin, 'https://o.org/' || l_linenumber % 3 AS url, CASE WHEN l_quantity % 3 = 0 THEN l_returnflag WHEN l_quantity % 3 = 1 THEN ' ' END AS status, CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey END AS venue, CASE WHEN l_partkey % 9 = 0 THEN l_linestatus END AS cost"


@query(
    "enrichment_precedence",
    f"""WITH s AS (SELECT l_orderkey, {_STEP} FROM lineitem),
    b AS (SELECT l_orderkey, min((rank, origin, url, status)) FILTER (trim(status) <> '') AS a, min((rank, origin, url, venue)) FILTER (venue IS NOT NULL) AS b, min((rank, origin, url, cost)) FILTER (cost IS NOT NULL) AS c FROM s GROUP BY 1)
    SELECT l_orderkey, a[4] AS status, b[4] AS venue, c[4] AS cost, concat_ws(';', 'status:' || a[2] || ':' || a[3], 'venue:' || b[2] || ':' || b[3], 'cost:' || c[2] || ':' || c[3]) AS provenance,
    array_to_string(list_transform(list_sort(list_distinct(list_filter([(a[1], a[2], a[3]), (b[1], b[2], b[3]), (c[1], c[2], c[3])], lambda x: x[1] IS NOT NULL))), lambda x: x[2] || ':' || x[3]), ';') AS sources FROM b""",
)
def enrichment_precedence(spark, d):
    """What parsed pages, official pages, extracted actions and a model say of an order, folded by their rank."""
    n = F.col("l_linenumber")
    origin = F.element_at(F.array(*map(F.lit, ["parsed", "page", "actions", "model"])), (n % 4 + 1).cast("int"))
    status = F.when(F.col("l_quantity") % 3 == 0, F.col("l_returnflag")).when(F.col("l_quantity") % 3 == 1, " ")
    steps = table(spark, d, "lineitem").select(
        "l_orderkey", (n % 4).alias("rank"), origin.alias("origin"), F.concat(F.lit("https://o.org/"), (n % 3).cast("string")).alias("url"), status.alias("status"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_suppkey")).alias("venue"), F.when(F.col("l_partkey") % 9 == 0, F.col("l_linestatus")).alias("cost")
    )
    got = enrich.merged(steps, "l_orderkey", F.col("rank"), "origin", "url", ["status", "venue", "cost"])
    said = lambda a, *parts: F.array_join(F.transform(a, lambda x: F.concat_ws(":", *[x[p] for p in parts])), ";")
    return got.select("l_orderkey", "status", "venue", "cost", said("provenance", "field", "origin", "url").alias("provenance"), said("sources", "origin", "url").alias("sources"))


@query(
    "free_suffixes",
    """WITH p AS (SELECT doc_id, source || '-' || lang AS stem FROM documents), taken AS (SELECT DISTINCT stem AS n FROM p WHERE length(stem) % 2 = 0 UNION SELECT stem || '-' || (doc_id % 40 + 2) FROM p WHERE doc_id % 3 = 0),
    new AS (SELECT doc_id, stem, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS r FROM p WHERE doc_id % 2 = 0),
    free AS (SELECT stem, k, row_number() OVER (PARTITION BY stem ORDER BY k) AS r FROM (SELECT DISTINCT stem FROM new), LATERAL (SELECT unnest(range(1, (SELECT count(*) FROM p) + 50)) AS k) WHERE CASE WHEN k = 1 THEN stem ELSE stem || '-' || k END NOT IN (SELECT n FROM taken))
    SELECT doc_id, CASE WHEN k = 1 THEN stem ELSE stem || '-' || k END AS entry_id FROM new JOIN free USING (stem, r)""",
)
def free_suffixes(spark, d):
    """Ids for every second document beside ids that are taken, with gaps between them."""
    k, stem = F.col("doc_id"), F.concat_ws("-", "source", "lang")
    docs = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", stem.alias("stem"))
    taken = docs.where(F.length("stem") % 2 == 0).select("stem").union(docs.where(k % 3 == 0).select(F.concat_ws("-", "stem", (k % 40 + 2).cast("string"))))
    return naming.free_names(docs.where(k % 2 == 0), taken, "stem", ["doc_id"], "entry_id").select("doc_id", "entry_id")


@query(
    "observed_counts",
    """WITH d AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P'), a AS (SELECT DISTINCT o_custkey FROM d WHERE o_custkey % 3 <> 0)
    SELECT (SELECT count(*) FROM orders) AS raw, (SELECT count(*) FROM orders) - (SELECT count(*) FROM d) AS dropped, (SELECT count(*) FROM d) - (SELECT count(*) FROM a) AS repeated, (SELECT count(*) FROM a) AS added""",
)
def observed_counts(spark, d):
    """Counts of a write of the first good order of each customer that isn't stored yet, without a second job."""
    stored = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    counts = ingest.add_missing(stored, table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus") != "P", folder(spark, "added"))
    return spark.createDataFrame([counts], "raw long, dropped long, repeated long, added long")


@query("stream_ingest_buckets", "SELECT event_id, user_id, event_type, 'new' AS update_state FROM events")
def stream_ingest_buckets(spark, d):
    """As `stream_ingest_available_now`, into a store of which a batch touches its own buckets only."""
    store = upkeep.keyed(spark, folder(spark, "keyed"), "event_id", {"event_id": "long", "user_id": "long", "event_type": "string"}, 16)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    upkeep.merge_stream(stream, store, "event_id", ["user_id", "event_type"], "ts", "2026-01-01", buckets=16)
    return store.read().select("event_id", "user_id", "event_type", "update_state")
