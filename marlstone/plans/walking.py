"""Queries of the venues' discovery walks, crawl steps and page parsers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marlstone.functions.urls import host, resolve, slug
from marlstone.operators import discovery, walks
from marlstone.operators.discovery import PROFILES
from marlstone.plans.registry import Registry
from marlstone.sources import venues
from marlstone.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: Paths of a schedule and of exhibitions.
SCHEDULE, EXHIBITIONS = "event/full-schedules", "exhibitions/"


@query(
    "schedule_walk",
    """WITH RECURSIVE w AS (SELECT 1::BIGINT AS k UNION ALL SELECT c FROM w JOIN pages p ON p.page_id = w.k, unnest([2 * w.k, 2 * w.k + 1]) t(c) WHERE w.k % 7 <> 0),
    s AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS visit FROM w QUALIFY visit < 80) SELECT page_id, visit FROM s JOIN pages ON page_id = k""",
)
def schedule_walk(spark, d):
    k, at = F.col("page_id"), lambda c: F.concat(F.lit("/p"), c.cast("string"))
    pages = table(spark, d, "pages").select("page_id", at(k).alias("path"), F.when(k % 7 == 0, 404).otherwise(200).alias("status"), F.array(at(2 * k), at(2 * k + 1), at(F.lit(1))).alias("links"))
    return walks.first_in_first_out(pages, ["/p1"]).select("page_id", F.col("visit").cast("long").alias("visit"))


def _months_sql() -> str:
    """The same walk month by month: the ids that are new, and the pages before the first without one."""
    parts = ["v AS (SELECT c_custkey % 4 AS month, c_custkey // 4 % 8 + 1 AS page, c_custkey AS ord, c_nationkey * 100 + c_custkey // 4 % 8 * (c_custkey % 4 + c_nationkey % 2) AS id FROM customer)"]
    for m in range(walks.BOARD_MONTHS):
        seen = " UNION ALL ".join(f"SELECT id FROM r{i}" for i in range(m)) or "SELECT NULL AS id WHERE false"
        parts.append(f"f{m} AS (SELECT id, min(page) AS page, arg_min(ord, (page, ord)) AS ord FROM v WHERE month = {m} AND page <= {walks.BOARD_PAGES} AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.id = v.id) GROUP BY id)")
        parts.append(f"r{m} AS (SELECT {m} AS month, page, ord, id FROM f{m} WHERE page < (SELECT min(p) FROM range(1, {walks.BOARD_PAGES + 2}) t(p) WHERE p NOT IN (SELECT page FROM f{m})))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM r{m}" for m in range(walks.BOARD_MONTHS))


@query("board_months", _months_sql())
def board_months(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    page = F.floor(k / 4) % 8
    refs = table(spark, d, "customer").select((k % 4).cast("int").alias("month"), (page + 1).cast("long").alias("page"), k.alias("ord"), (n * 100 + page * (k % 4 + n % 2)).alias("id"))
    return walks.month_views(refs)


@query(
    "listing_walk",
    """WITH o AS (SELECT o_custkey AS listing, o_orderkey AS ord, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 + 1 AS page, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate < TIMESTAMP '1996-01-01' END AS past FROM orders),
    r AS (SELECT * FROM o WHERE page <= least(2 + listing % 9, 25)), i AS (SELECT *, sum(CASE WHEN past = false THEN 1 ELSE 0 END) OVER (PARTITION BY listing ORDER BY ord) AS island FROM r),
    n AS (SELECT *, sum(CASE WHEN past THEN 1 ELSE 0 END) OVER (PARTITION BY listing, island ORDER BY ord) AS run FROM i),
    s AS (SELECT *, max(CASE WHEN run >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY listing ORDER BY ord) AS stop FROM n) SELECT listing, page, ord FROM s WHERE stop = 0 AND past = false""",
)
def listing_walk(spark, d):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    past = F.when(k % 11 != 0, F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("listing"), k.alias("ord"), (F.floor((nth - 1) / 3) + 1).alias("page"), past.alias("past"))
    footers = rows.groupBy("listing", "page").agg(F.count("*").alias("rows")).select("listing", "page", "rows", (F.col("page") + 1).alias("next"), (2 + F.col("listing") % 9).alias("total"))
    return walks.listing_rows(rows, footers, "listing", ["ord"], F.col("past"), 3).where("NOT past").select("listing", "page", "ord")


@query("discovered_refs", "SELECT o_custkey, o_orderkey AS ref FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def discovered_refs(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ref"), "o_orderstatus")
    of = lambda s: o.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    return walks.preferred(of("P"), of("F"), "o_custkey")


LINKS = ["/event/full-schedules/?page=", " /event/full-schedules?page=", "https://WWW.venue.org/event/full-schedules/?q=", "https://other.org/event/full-schedules/?page=", "mailto:", "/exhibitions/show-", "exhibitions/x/show-", "https://www.venue.org/about/"]


@query(
    "schedule_links",
    f"""WITH h AS (SELECT page_id, trim({LINKS}[page_id % {len(LINKS)} + 1] || page_id || '#top') AS href FROM pages) SELECT page_id,
    regexp_extract(href, '^(?:https?://(?i:www.venue.org))?(/{SCHEDULE}/?\\?[^#]*)', 1) AS pager, CASE WHEN regexp_matches(href, '^/?{EXHIBITIONS}') THEN 'venue-' || regexp_extract(href, '([^/#]+)#top$', 1) ELSE '' END AS event FROM h""",
)
def schedule_links(spark, d):
    base = F.lit("https://www.venue.org/")
    p = table(spark, d, "pages").select("page_id", F.concat(F.element_at(F.array(*map(F.lit, LINKS)), (F.col("page_id") % len(LINKS) + 1).cast("int")), F.col("page_id").cast("string"), F.lit("#top")).alias("href"))
    u = p.select("page_id", F.regexp_replace(resolve(base, F.col("href")), "#.*$", "").alias("u"))
    path = F.trim(F.try_parse_url("u", F.lit("PATH")), F.lit("/"))
    here = host(F.col("u")) == "www.venue.org"
    pager = F.when(here & (path == SCHEDULE), F.regexp_replace("u", "^https?://[^/]+", ""))
    event = F.when(path.startswith(EXHIBITIONS), F.concat(F.lit("venue-"), slug(F.col("u"))))
    return u.select("page_id", F.coalesce(pager, F.lit("")).alias("pager"), F.coalesce(event, F.lit("")).alias("event"))


URL_SQL = "url || (['', '/training/x', '/press', '/forum?a=news', '/en/Summit'])[page_id % 5 + 1]"


@query("discovery_profiles", " UNION ALL ".join(f"SELECT page_id, '{n}' AS profile FROM (SELECT page_id, {URL_SQL} AS u FROM pages) WHERE regexp_matches(u, '{p.urls}')" for n, p in PROFILES.items()))
def discovery_profiles(spark, d):
    more = F.element_at(F.array(*map(F.lit, ["", "/training/x", "/press", "/forum?a=news", "/en/Summit"])), (F.col("page_id") % 5 + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", F.concat("url", more).alias("u"))
    admitted = F.array_compact(F.array(*[F.when(F.col("u").rlike(x.urls), F.lit(n)) for n, x in PROFILES.items()]))
    return p.select("page_id", F.explode(admitted).alias("profile"))


_CANDIDATE = f"""SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'ftp://' || page_id WHEN page_id % 11 = 0 THEN 'https://localhost/x' ELSE {URL_SQL} END AS u, CASE WHEN page_id % 7 <> 0 THEN 't' ELSE ' ' END AS title, CASE WHEN page_id % 3 <> 0 THEN 'Seoul' END AS location,
    CASE page_id % 4 WHEN 0 THEN '2026-0' || (page_id % 9 + 1) || '-01' WHEN 1 THEN '2026-06-01T0' || (page_id % 9) || ':00:00+05:00' WHEN 2 THEN 'soon' END AS date FROM pages"""
_AT = "CASE WHEN regexp_matches(date, '^[0-9-]{10}$') THEN date || 'T00:00:00Z' WHEN date <> 'soon' THEN date END::TIMESTAMPTZ"


def _profile_sql() -> str:
    parts = []
    for n, p in PROFILES.items():
        need = [f"WHEN page_id % 13 = 0 OR page_id % 11 = 0 THEN 'invalid_url' WHEN NOT regexp_matches(u, '{p.urls}') THEN 'url_pattern' WHEN trim(title) = '' THEN 'missing_title'"]
        need += ["WHEN location IS NULL THEN 'missing_location'"] * p.location + ["WHEN moment IS NULL THEN 'missing_date'"] * p.date + ["WHEN moment < TIMESTAMPTZ '2026-06-01 00:00:00Z' THEN 'past_date'"] * (not p.past)
        parts.append(f"SELECT page_id, '{n}' AS profile, CASE {' '.join(need)} END AS reason FROM c")
    return f"WITH c AS (SELECT *, {_AT} AS moment FROM ({_CANDIDATE})) " + " UNION ALL ".join(parts)


@query("profile_reasons", _profile_sql())
def profile_reasons(spark, d):
    k = F.col("page_id")
    more = F.element_at(F.array(*map(F.lit, ["", "/training/x", "/press", "/forum?a=news", "/en/Summit"])), (k % 5 + 1).cast("int"))
    url = F.when(k % 13 == 0, F.concat(F.lit("ftp://"), k.cast("string"))).when(k % 11 == 0, "https://localhost/x").otherwise(F.concat("url", more))
    date = F.when(k % 4 == 0, F.format_string("2026-0%d-01", k % 9 + 1)).when(k % 4 == 1, F.format_string("2026-06-01T0%d:00:00+05:00", k % 9)).when(k % 4 == 2, "soon")
    rows = table(spark, d, "pages").select("page_id", url.alias("url"), F.when(k % 7 != 0, "t").otherwise(" ").alias("title"), F.when(k % 3 != 0, "Seoul").alias("location"), date.alias("date"))
    return discovery.profile_reasons(rows, "2026-06-01").select("page_id", "profile", "reason")


@query(
    "crawl_edges",
    """SELECT page_id, dst, kind, depth, kind NOT IN ('sitemap', 'feed') AS candidate FROM (SELECT page_id, unnest([url || '/a', url || '/b']) AS dst, unnest(CASE WHEN page_id % 3 = 0 THEN ['sitemap', 'sitemap'] ELSE ['auto', (['feed', 'html', 'sitemap'])[page_id % 3 + 1]] END) AS kind, page_id % 2 + 1 AS depth FROM pages)""",
)
def crawl_edges(spark, d):
    k = F.col("page_id")
    link = lambda tail, kind: F.struct(F.concat("url", F.lit(tail)).alias("url"), kind.alias("kind"))
    second = F.element_at(F.array(*map(F.lit, ["feed", "html", "sitemap"])), (k % 3 + 1).cast("int"))
    route = F.when(k % 3 == 0, "sitemap_index").otherwise("html")
    docs = table(spark, d, "pages").select(k.alias("url"), route.alias("route"), (k % 2).alias("depth"), F.array(link("/a", F.lit(None).cast("string")), link("/b", second), F.struct(F.lit(None).cast("string").alias("url"), F.lit("html").alias("kind"))).alias("links"))
    return walks.edges(docs).withColumnRenamed("url", "page_id")


@query(
    "candidate_slots",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 6 = 0 AS seed, event_type <> 'click' AS candidate, (event_id % 6 = 1)::INT AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
    f AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS r, 0 AS n, 0 AS done, NULL::BOOLEAN AS stored FROM e UNION ALL
    SELECT e.user_id, e.event_id, e.r, f.n + coalesce(x.stored::INT, 0), f.done + e.outcome, x.stored FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1,
    LATERAL (SELECT CASE WHEN e.candidate THEN f.n < CASE WHEN e.seed THEN 30 ELSE 30 - greatest(4 - f.done - e.outcome, 0) END END AS stored) x)
    SELECT user_id, event_id, stored FROM f WHERE r > 0""",
)
def candidate_slots(spark, d):
    k = F.col("event_id")
    kind = F.col("event_type")
    steps = table(spark, d, "events").select("user_id", "event_id", (k % 6 == 0).alias("seed"), (kind != "click").alias("candidate"), (k % 6 == 1).alias("outcome"))
    return walks.slots(steps, "user_id", "event_id", 4)


@query("link_header_bounds", "SELECT page_id, CASE WHEN page_id % 19 <= 16 AND (page_id % 19) * (length(url) + page_id % 700) <= 8192 THEN page_id % 19 END AS n FROM pages")
def link_header_bounds(spark, d):
    k = F.col("page_id")
    value = F.concat("url", F.repeat(F.lit("x"), (k % 700).cast("int")))
    headers = F.array_repeat(value, (k % 19).cast("int"))
    return table(spark, d, "pages").select("page_id", F.size(walks.link_headers_within(headers)).cast("long").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("retry_waits", "SELECT o_orderkey, CASE WHEN a < 500 AND a <> 429 THEN '' WHEN b < 500 AND b <> 429 THEN '500' ELSE '500,1000' END AS waits FROM (SELECT o_orderkey, ([200, 429, 500, 404])[o_orderkey % 4 + 1] AS a, ([503, 200, 429])[o_custkey % 3 + 1] AS b FROM orders)")
def retry_waits(spark, d):
    pick = lambda of, c: F.element_at(F.array(*map(F.lit, of)), (F.col(c) % len(of) + 1).cast("int"))
    tries = F.array(pick([200, 429, 500, 404], "o_orderkey"), pick([503, 200, 429], "o_custkey"), F.lit(503))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(walks.waits(tries), lambda w: w.cast("string")), ",").alias("waits"))


@query("enrichment_wanted", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_size > 40")
def enrichment_wanted(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").where(walks.wants_actions(F.when(k % 2 != 0, "url"), F.when(k % 3 != 0, "2026-01-01"), F.when(F.col("p_size") <= 40, True))).select("p_partkey")


@query("batch_stats_upsert", "SELECT c_nationkey AS source, count(*) AS parsed, 'new' AS batch FROM customer WHERE c_nationkey % 2 = 0 GROUP BY ALL UNION ALL SELECT s_nationkey, count(*), 'old' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0) GROUP BY ALL")
def batch_stats_upsert(spark, d):
    of = lambda t, c, b: table(spark, d, t).groupBy(F.col(c).alias("source")).agg(F.count("*").alias("parsed")).withColumn("batch", F.lit(b))
    return walks.upserted(of("supplier", "s_nationkey", "old"), of("customer", "c_nationkey", "new").where("source % 2 = 0"), "source")


@query("raw_snapshot", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY user_id")
def raw_snapshot(spark, d):
    """The last raw record written for each key."""
    last = F.max(F.struct("ts", "event_id", "props")).alias("_l")
    return table(spark, d, "events").groupBy("user_id").agg(last).select("user_id", "_l.event_id", F.col("_l.props").alias("payload"))


@query("seed_yield", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS seeds, count(*) AS candidates FROM documents GROUP BY source")
def seed_yield(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("seeds"), F.count("*").alias("candidates"))


def _page(name: str, html: str, url: str, fields: dict[str, str]):
    """A parser over one page for each supplier; `{k}` and `{n}` stand for its number and name in page, address and SQL."""
    filled = lambda text: F.concat(*[F.col({"{k}": "k", "{n}": "n"}[x]) if x in ("{k}", "{n}") else F.lit(x) for x in re.split(r"(\{[kn]\})", text) if x])
    said = lambda text: " || ".join({"{k}": "s_suppkey", "{n}": "s_name"}.get(x, "'" + x.replace("'", "''") + "'") for x in re.split(r"(\{[kn]\})", text) if x)

    @query(f"{name}_records", "SELECT " + ", ".join(f"{said(v)} AS {f}" for f, v in fields.items()) + " FROM supplier")
    def run(spark, d):
        s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("n"))
        return venues.parse(s.select(filled(url).alias("url"), filled(html).alias("html")), name).select(*fields)


_page("coex", '<h2 class="SingleTitle">{n}</h2><p class="EventDetailBoxHeader-date">2026.05.01 - 2026.05.{k}</p>', "https://www.venue.org/exhibitions/show-{k}/", {"event_id": "coex-show-{k}", "name": "{n}", "start_raw": "2026.05.01", "end_raw": "2026.05.{k}", "city": "Seoul"})
_page("kintex", '<h3>{n}</h3><ul class="view-info-list"><li><span class="title">기 간</span><span class="info">2026-05-01 ~ 2026-05-{k}</span></li><li><span class="title">주최</span><span class="info">Org {k}</span></li></ul>', "https://k.org/view?seq={k}", {"event_id": "kintex-{k}", "name": "{n}", "start_raw": "2026-05-01", "end_raw": "2026-05-{k}", "organizer": "Org {k}"})
_page("showala", '<ul><li class="kor_tit">{n}</li><li class="date"><p class="des">2026.05.01 ~ 2026.05.{k}</p></li><li class="opener"><p class="des">By {k}</p></li></ul>', "https://s.org/ex?idx={k}", {"event_id": "showala-{k}", "name": "{n}", "start_raw": "2026.05.01", "end_raw": "2026.05.{k}", "organizer": "By {k}", "source_type": "aggregator"})
_page("aiia", '<div class="bbs_view"><div class="tit"><div class="left"><em>[Org {k}] {n}</em></div></div></div><div id="DivContents"><p>일시: 2026-05-01</p></div>', "https://a.org/v?num={k}", {"event_id": "aiia-{k}", "name": "[Org {k}] {n}", "organizer": "Org {k}", "start_raw": "2026-05-01"})
_page("akei", '<div class="bbs_schedule_view"><table><tr><th>전시회명(한글)</th><td>{n}</td></tr><tr><th>기간</th><td>2026-05-01 ~ 2026-05-09</td></tr><tr><th>전화</th><td>02-{k}</td></tr><tr><th>주최</th><td>Org {k}</td></tr></table></div>', "https://b.org/board?wr_id={k}", {"event_id": "akei-{k}", "name": "{n}", "organizer": "Org {k}", "start_raw": "2026-05-01", "end_raw": "2026-05-09"})
