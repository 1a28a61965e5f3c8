"""Queries of discovery sessions: candidates' addresses and origins, actions, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.urls import candidate
from marlstone.operators import crawl, steps
from marlstone.plans.registry import Registry
from marlstone.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

HEADS = ["HTTPS://WWW.Venue.org:443/a/../b//", "http://venue.org:8080/x/./y?q=A#z", "http://10.0.0.8/p", "https://user@venue.org/", "ftp://venue.org/", "https://venue.org/010-1234-5678/", "http://localhost/", "https://8.8.8.8/%61"]


def _head(c):
    return F.element_at(F.array(*map(F.lit, HEADS)), (c % len(HEADS) + 1).cast("int"))


@query(
    "candidate_urls",
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://www.venue.org/b/' || page_id WHEN 1 THEN 'http://venue.org:8080/x/y?q=A' WHEN 7 THEN 'https://8.8.8.8/a' || page_id END AS url FROM pages""",
)
def candidate_urls(spark, d):
    k = F.col("page_id")
    return table(spark, d, "pages").select("page_id", candidate(F.concat(F.lit(" "), _head(k), k.cast("string"))).alias("url"))


@query(
    "candidate_provenance",
    """SELECT page_id, CASE WHEN page_id % 4 = 1 OR page_id % 5 = 2 THEN NULL WHEN page_id % 3 = 0 AND page_id % 4 <> 0 AND page_id % 5 <> 0 THEN NULL ELSE
    concat_ws('|', CASE WHEN page_id % 3 = 0 THEN '' ELSE 'by [email removed]' END, CASE WHEN page_id % 5 = 0 THEN 'https://seed.org/s' ELSE '' END, CASE WHEN page_id % 4 = 0 THEN 'https://venue.org/' || page_id ELSE '' END) END AS shown FROM pages""",
)
def candidate_provenance(spark, d):
    k = F.col("page_id")
    url = F.concat(F.lit("https://venue.org/"), k.cast("string"))
    seed = F.when(k % 5 == 0, "https://SEED.org:443/s").when(k % 5 == 2, "http://127.0.0.1/")
    raw = F.when(k % 4 == 0, F.concat(url, F.lit("#top"))).when(k % 4 == 1, "https://other.org/")
    raw = F.when(k % 4 == 0, F.regexp_replace(raw, "#top$", "")).otherwise(raw)
    record = F.struct(F.when(k % 3 != 0, "by me@venue.org").alias("provider"), F.lit("").alias("relation"), seed.alias("seed_url"), F.lit(None).cast("string").alias("parent_url"), raw.alias("raw_url"))
    out = steps.provenance(table(spark, d, "pages").select("page_id", url.alias("url"), record.alias("p")), "url", "p")
    return out.select("page_id", F.when(F.col("p").isNotNull(), F.concat_ws("|", "p.provider", "p.seed_url", "p.raw_url")).alias("shown"))


#: Answers of a model in every shape that is taken or refused; {c} and {p} stand for an order's customer and priority.
ANSWERS = [
    'so {"action": "search", "query": " call 010-1234-5678 about {c} "}',
    '{"action":"open","url":" https://a.org/{c} "} ok',
    '{"action":"accept","selections":[{"url":""},{"url":"https://b.org/{c}","reason":"{p}"},{"reason":"x"}]}',
    '{"action":"accept","selections":[{"url":" "}]}',
    '{"action":"done"}',
    '{"action":"leave"}',
    "nothing {p}",
    '{"action":"search","query":" "}',
    '{"action":"search","query":"{c}","extra":1}',
    '{"action":"open","url":5}',
    '{"action":"accept","selections":[{"url":"https://b.org/{c}","score":1}]}',
    '{"ACTION":"done","Selections":null,"query":null}',
    '{"action":"search","query":["{c}"]}',
    '{"action":"accept","selections":{"url":"https://b.org/{c}"}}',
    '{"action":"accept","selections":[null,{"url":"https://b.org/{c}","reason":null}]}',
    '{"action":"done"',
]


@query(
    "model_actions",
    f"""WITH a AS (SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(replace(replace(({ANSWERS})[o_orderkey % {len(ANSWERS)} + 1], '{{c}}', o_custkey::VARCHAR), '{{p}}', o_orderpriority), '\\{{.*\\}}', 0), '') AS JSON) AS j FROM orders),
    k AS (SELECT o_orderkey, j, list_filter(json_keys(j), lambda x: NOT (CASE lower(x) WHEN 'selections' THEN json_type(j, '$."' || x || '"') IN ('ARRAY', 'NULL') ELSE lower(x) IN ('action', 'query', 'url') AND json_type(j, '$."' || x || '"') IN ('VARCHAR', 'NULL') END)) AS bad,
      coalesce(json_extract(j, '$.selections[*]'), []) AS s, coalesce(json_extract_string(j, '$.action'), json_extract_string(j, '$.ACTION')) AS action, trim(replace(coalesce(json_extract_string(j, '$.query'), ''), '010-1234-5678', '[phone removed]')) AS query, trim(coalesce(json_extract_string(j, '$.url'), '')) AS url FROM a),
    b AS (SELECT *, list_filter(s, lambda e: NOT (json_type(e) = 'NULL' OR json_type(e) = 'OBJECT' AND len(list_filter(json_keys(e), lambda x: NOT (x IN ('url', 'reason') AND json_type(e, '$."' || x || '"') IN ('VARCHAR', 'NULL')))) = 0)) AS bad_s FROM k),
    c AS (SELECT *, list_filter(list_transform(s, lambda e: trim(coalesce(json_extract_string(e, '$.url'), '')) || ' ' || coalesce(json_extract_string(e, '$.reason'), '')), lambda x: trim(x) <> '' AND x[1] <> ' ') AS kept FROM b),
    d AS (SELECT *, CASE WHEN j IS NULL OR len(bad) > 0 OR len(bad_s) > 0 THEN NULL WHEN action = 'search' AND query <> '' THEN action WHEN action = 'open' AND url <> '' THEN action WHEN action = 'accept' AND len(kept) > 0 THEN action WHEN action = 'done' THEN action END AS kind FROM c)
    SELECT o_orderkey, kind, CASE kind WHEN 'search' THEN query WHEN 'open' THEN url WHEN 'accept' THEN array_to_string(kept, ';') || ' ' || (len(s) - len(kept)) ELSE '' END AS said FROM d""",
)
def model_actions(spark, d):
    answer = F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("o_orderkey") % len(ANSWERS) + 1).cast("int"))
    answer = F.replace(F.replace(answer, F.lit("{c}"), F.col("o_custkey").cast("string")), F.lit("{p}"), F.col("o_orderpriority"))
    a = steps.actions(table(spark, d, "orders").select("o_orderkey", answer.alias("answer")), "answer")
    chosen = F.array_join(F.transform("selections", lambda s: F.concat_ws(" ", s["url"], s["reason"])), ";")
    return a.select("o_orderkey", "kind", F.coalesce("query", "url", F.concat_ws(" ", chosen, F.col("dropped").cast("string")), F.lit("")).alias("said"))


@query(
    "model_budget",
    "SELECT event_id, CASE WHEN n >= 8 THEN 'model_call_budget' WHEN 4000 - n * 700 <= 0 THEN 'completion_token_budget' END AS refused, CASE WHEN n < 8 AND 4000 - n * 700 > 0 THEN least(4000 - n * 700, 700) END AS reserved FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)",
)
def model_budget(spark, d):
    got = steps.reservations(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 700)
    return got.select("event_id", "refused", F.col("reserved").cast("long").alias("reserved"))


@query(
    "session_end",
    "SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'deadline_exceeded' WHEN event_id % 3 = 0 THEN 'proposal_done' WHEN value > 50 THEN 'token_budget' ELSE 'model_call_budget' END AS reason FROM events",
)
def session_end(spark, d):
    k = F.col("event_id")
    error = F.when((F.col("event_type") == "click") & (k % 2 == 0), "deadline_exceeded").when(k % 2 == 0, "other")
    cut = F.when(F.col("value") > 50, F.array(F.lit("pages"), F.lit("completion_token_budget"))).otherwise(F.array(F.lit("pages")))
    return table(spark, d, "events").select("event_id", steps.terminal_reason(error, cut, k % 3 == 0).alias("reason"))


@query(
    "seed_catalogues",
    """SELECT s_nationkey AS catalogue, CASE WHEN count(*) > 8 THEN 'too_many' WHEN NOT bool_and(s_suppkey % 23 <> 0) THEN 'invalid_seed' WHEN count(DISTINCT s_suppkey % 29) < count(*) THEN 'repeated_name' END AS error,
    CASE WHEN error IS NULL THEN string_agg('n' || s_suppkey % 29 || '=https://venue.org/' || s_suppkey, ',' ORDER BY s_suppkey) END AS seeds FROM supplier GROUP BY s_nationkey""",
)
def seed_catalogues(spark, d):
    k = F.col("s_suppkey")
    at = F.concat(F.when(k % 23 == 0, "https://127.0.0.1/").otherwise("HTTPS://Venue.org:443/./"), k.cast("string"))
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("catalogue"), k.alias("ord"), F.concat(F.lit(" n"), (k % 29).cast("string")).alias("name"), at.alias("url"))
    got = crawl.seed_catalogue(rows, "catalogue")
    return got.select("catalogue", "error", F.when(F.col("error").isNull(), F.array_join(F.transform("seeds", lambda s: F.concat_ws("=", s["name"], s["url"])), ",")).alias("seeds"))


@query(
    "host_pacing",
    """WITH r AS (SELECT user_id, event_id, (event_id * 7919 % 5000) // 10 AS made, 2 + user_id % 4 AS step FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY made, event_id) * step AS nth FROM r)
    SELECT event_id, (nth + max(made - nth) OVER (PARTITION BY user_id ORDER BY made, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS starts FROM n""",
)
def host_pacing(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", F.floor((k * 7919 % 5000) / 10).alias("at"))
    return crawl.paced(rows, "user_id", "at", "event_id", 2 + F.col("user_id") % 4).select("event_id", F.col("starts").cast("long").alias("starts"))
