"""Read-side queries: pages, feeds, lookups, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import keyset, search
from marlstone.plans.registry import Registry
from marlstone.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _page(spark, d, name, spec, *cols):
    return keyset.trimmed(keyset.page(table(spark, d, name), spec), spec).select(*cols)


@query(
    "events_filtered_page",
    """SELECT event_id, ts, event_type, value FROM events
       WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND event_type IN ('purchase', 'signup')
       ORDER BY ts, event_id LIMIT 20""",
)
def events_filtered_page(spark, d):
    spec = keyset.PageSpec(["ts", "event_id"], where=[F.col("ts") >= F.expr("timestamp_ntz'2024-01-05'"), F.col("ts") <= F.expr("timestamp_ntz'2024-01-25'"), F.col("event_type").isin("purchase", "signup")])
    return _page(spark, d, "events", spec, "event_id", "ts", "event_type", "value")


@query("events_keyset_first", "SELECT event_id, ts, true AS has_more FROM events ORDER BY ts, event_id LIMIT 100")
def events_keyset_first(spark, d):
    return _page(spark, d, "events", keyset.PageSpec(["ts", "event_id"], limit=100), "event_id", "ts", "has_more")


@query("events_keyset_next", "SELECT event_id, ts, has_more FROM (SELECT event_id, ts, true AS has_more FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10', 50) ORDER BY ts, event_id LIMIT 20)")
def events_keyset_next(spark, d):
    spec = keyset.PageSpec(["ts", "event_id"], after=[F.expr("timestamp_ntz'2024-01-10'"), 50])
    return _page(spark, d, "events", spec, "event_id", "ts", "has_more")


@query("cursor_tokens", """SELECT event_id, rtrim(translate(to_base64(encode(strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(10) || event_id)), '+/', '-_'), '=') AS token, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, event_id AS id FROM events""")
def cursor_tokens(spark, d):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    token = keyset.encode_cursor(at, F.col("event_id").cast("string"))
    back = keyset.decode_cursor(token)
    return table(spark, d, "events").select("event_id", token.alias("token"), back["at"].alias("at"), back["id"].cast("long").alias("id"))


@query("events_changed_since_semi", "SELECT o_orderkey, o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_shipdate >= TIMESTAMP '1998-06-01')")
def events_changed_since_semi(spark, d):
    since = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.expr("timestamp_ntz'1998-06-01'")).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(since, "o_orderkey", "left_semi")



def _feed(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), "l_orderkey", "l_linestatus")


@query("change_feed_page", "SELECT id, l_orderkey, l_linestatus FROM (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS id, l_orderkey, l_linestatus FROM lineitem) f WHERE id > 5000 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.l_orderkey AND o_orderstatus <> 'P') ORDER BY id LIMIT 50")
def change_feed_page(spark, d):
    visible = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    spec = keyset.PageSpec(["id"], limit=50, after=[5000])
    return keyset.trimmed(keyset.page(_feed(spark, d).join(visible, "l_orderkey", "left_semi"), spec), spec).select("id", "l_orderkey", "l_linestatus")


@query("change_feed_state", "SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS id, coalesce(o_orderstatus, '') AS update_state FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) o ON o_orderkey = l_orderkey")
def change_feed_state(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return _feed(spark, d).join(o, "l_orderkey", "left").select("id", F.coalesce("o_orderstatus", F.lit("")).alias("update_state"))


@query("list_kind_partition", "SELECT source ILIKE 'SRC1%' AS benchmark, count(*) AS n FROM documents GROUP BY 1")
def list_kind_partition(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").ilike("SRC1%").alias("benchmark")).agg(F.count(F.lit(1)).alias("n"))


@query("updated_since_text", "SELECT event_id FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS u FROM events) WHERE u >= '2024-01-15T00:00:00Z'")
def updated_since_text(spark, d):
    u = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return table(spark, d, "events").where(u >= "2024-01-15T00:00:00Z").select("event_id")


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice").limit(1)


@query("nested_sources", "SELECT l_orderkey AS o_orderkey, l_partkey, l_suppkey FROM lineitem")
def nested_sources(spark, d):
    nested = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_partkey", "l_suppkey")).alias("sources"))
    return nested.select("o_orderkey", F.inline("sources"))



@query("event_type_facet", "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")
def event_type_facet(spark, d):
    from marlstone.operators.facets import counts

    return counts(table(spark, d, "events").select(F.array("event_type").alias("a")), "a")


@query(
    "search_match_filter",
    """SELECT p_partkey FROM part WHERE contains(lower(p_brand), 'brand#1') AND contains(lower(p_type || ' ' || p_name), 'e') AND contains(lower(p_name), 'a')
       AND (p_size % 5 = 0 OR (printf('2026-%02d-01', p_size % 12 + 1) >= '2026-03-01' AND printf('2026-%02d-01', p_size % 12 + 1) <= '2026-09-01'))""",
)
def search_match_filter(spark, d):
    day = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.format_string("2026-%02d-01", F.col("p_size") % 12 + 1))
    flat = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("category"), F.col("p_type").alias("city"), F.col("p_name").alias("venue"), F.col("p_name").alias("name"), F.lit("").alias("name_en"), day.alias("start_date"))
    return flat.where(search.matches(search.EventFilter(category="brand#1", region="e", keyword="a", from_date="2026-03-01", to_date="2026-09-01"))).select("p_partkey")


@query("category_alias", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'humanoid-robotics' WHEN 1 THEN 'medical-devices' WHEN 2 THEN 'digital-health' ELSE 'bio' END AS category FROM part")
def category_alias(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("robotics", "medical", "health", "bio")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", search.aliased(raw).alias("category"))


@query(
    "search_rank_topk",
    """SELECT page_id, score FROM (SELECT page_id, (3 * contains(lower(t), 'the')::INT + contains(lower(url), 'the')::INT + 3 * contains(lower(t), 'an')::INT + contains(lower(url), 'an')::INT + 3 * contains(lower(t), 'er')::INT + contains(lower(url), 'er')::INT)::BIGINT AS score
       FROM (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages)) ORDER BY score DESC, page_id LIMIT 30""",
)
def search_rank_topk(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return search.ranked(pages, ["the", "an", "er"], "title", "url", "page_id").limit(30).select("page_id", "score")


@query(
    "event_bucket_sort",
    """SELECT o_orderkey, b AS bucket, row_number() OVER (ORDER BY b, CASE WHEN b = 2 THEN e END DESC, s NULLS LAST, o_orderkey) AS pos FROM (
       SELECT o_orderkey, s, e, CASE WHEN s IS NULL THEN 1 WHEN e < '1995-06-01' THEN 2 ELSE 0 END AS b FROM (
       SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS s, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') END AS e FROM orders)) QUALIFY pos <= 200""",
)
def event_bucket_sort(spark, d):
    ok = F.col("o_orderkey") % 9 != 0
    o = table(spark, d, "orders").select("o_orderkey", F.when(ok, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("s"), F.when(ok, F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 2), "yyyy-MM-dd")).alias("e"))
    return search.by_bucket(o, "s", "e", "o_orderkey", "1995-06-01", 200).select("o_orderkey", "bucket", "pos")


@query("ui_name_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_brand), 'al')")
def ui_name_search(spark, d):
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("al")) | F.contains(F.lower("p_brand"), F.lit("al"))).select("p_partkey")


@query(
    "markdown_rows",
    r"""SELECT event_id, '| ' || event_id || ' | ' || regexp_replace(props, '([\\`|*_\[\]()<>&])', '\\\1', 'g') || ' | ' || regexp_replace(event_type, '([\\`|*_\[\]()<>&])', '\\\1', 'g') || ' |' AS row FROM events""",
)
def markdown_rows(spark, d):
    cell = F.concat_ws(" | ", F.col("event_id").cast("string"), T.md_text(F.col("props")), T.md_text(F.col("event_type")))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("| "), cell, F.lit(" |")).alias("row"))


@query("json_envelope", """SELECT '{"data":[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY ts, event_id) || '],"page":{"has_more":true,"limit":20}}' AS body FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 20)""")
def json_envelope(spark, d):
    spec = keyset.PageSpec(["ts", "event_id"])
    p = keyset.trimmed(keyset.page(table(spark, d, "events"), spec), spec)
    return keyset.envelope(p, ["event_id", "event_type"], spec).select("body")


@query("etag", "SELECT doc_id, '\"' || sha256(text) || '\"' AS etag FROM documents")
def etag(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit('"'), F.sha2(F.col("text").cast("binary"), 256), F.lit('"')).alias("etag"))


@query("flat_projection", "SELECT o_orderkey, 'a,b' AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'https://s/' || o_orderkey ELSE 'https://h' END AS source_url FROM orders")
def flat_projection(spark, d):
    k = F.col("o_orderkey")
    src = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("https://s/"), k.cast("string")).alias("url"))))
    rows = table(spark, d, "orders").select("o_orderkey", F.array(F.lit("a"), F.lit("b")).alias("categories"), src.alias("sources"), F.lit("https://h").alias("homepage_url"))
    return search.flat(rows).select("o_orderkey", "category", "source_url")
