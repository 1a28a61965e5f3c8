"""Queries of the listing connectors and of what they hand on: pages are written from a given table and read back."""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import hashing, web
from marlstone.functions import text as T
from marlstone.operators import keyset, render, search, walks
from marlstone.plans.registry import Registry
from marlstone.session import shared_dir
from marlstone.sources import connector, venues
from marlstone.sources.files import write_bodies
from marlstone.sources.tables import table
from marlstone.streaming import ingest

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _entry(number: Column) -> Column:
    return F.concat(F.lit("<a onclick=\"fnView('./view.do', "), number.cast("string"), F.lit(')">x</a>'))


def _order_pages(spark, d) -> tuple[str, int]:
    """A listing of all orders, a hundred numbers to a page: (folder, pages)."""
    o = table(spark, d, "orders").select((F.floor(F.col("o_orderkey") / 100) + 1).cast("long").alias("page"), "o_orderkey")
    last = o.agg(F.coalesce(F.max("page"), F.lit(0))).first()[0]
    html = o.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), _entry), "\n").alias("html"))
    every = spark.range(1, last + 1).withColumnRenamed("id", "page").join(html, "page", "left")
    folder = _folder(spark, "listing")
    write_bodies(every.select(F.format_string("page-%d.html", "page").alias("file"), "html"), folder, "file", "html")
    return folder, last


_ENTRIES = "SELECT (o_orderkey // 100 + 1)::INT AS page, (row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1)::INT AS ord, o_orderkey::VARCHAR AS ref FROM orders"


@query("listing_batch", _ENTRIES)
def listing_batch(spark, d):
    connector.register(spark)
    folder, last = _order_pages(spark, d)
    return spark.read.format("listing").option("path", folder).option("pages", last).load()


@query("listing_stream", _ENTRIES)
def listing_stream(spark, d):
    connector.register(spark)
    source, sink = _order_pages(spark, d)[0], _folder(spark, "listed")
    ingest.append_once(spark.readStream.format("listing").option("path", source).load(), sink)
    return spark.read.schema("page int, ord int, ref string").parquet(sink).select("page", "ord", "ref")


@query(
    "listing_followed",
    """WITH RECURSIVE c AS (SELECT c_nationkey AS l, c_custkey // 25 % 12 + 1 AS p, c_custkey % 300 AS ref FROM customer),
    w AS (SELECT DISTINCT l, 1::BIGINT AS p FROM c UNION SELECT w.l, n FROM w, unnest([CASE WHEN (w.l + w.p) % 3 <> 0 THEN w.p + 1 END, w.p + 5]) t(n) WHERE n BETWEEN 1 AND 12)
    SELECT DISTINCT l::VARCHAR AS listing, ref::VARCHAR AS ref FROM c JOIN w USING (l, p)""",
)
def listing_followed(spark, d):
    """A listing for each nation, of twelve pages that don't all name the next one."""
    connector.register(spark)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, d, "customer").select(n.cast("long").alias("l"), (F.floor(k / 25) % 12 + 1).alias("p"), (k % 300).alias("ref"))
    html = c.groupBy("l", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ref")), _entry), "\n").alias("html"))
    p = c.select("l").distinct().select("l", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("p")).join(html, ["l", "p"], "left")
    paging = lambda to: F.when(to <= 12, F.concat(F.lit("<a href=\"javascript:fnPaging('"), to.cast("string"), F.lit("')\">")))
    body = F.concat_ws("", F.col("html"), F.when((F.col("l") + F.col("p")) % 3 != 0, paging(F.col("p") + 1)), paging(F.col("p") + 5))
    folder = _folder(spark, "listings")
    write_bodies(p.select(F.format_string("%d/page-%d.html", "l", "p").alias("file"), body.alias("html")), folder, "file", "html")
    return spark.read.format("listing_walk").option("path", folder).option("pages", 12).load().select("listing", "ref")


EVENT = "event_id long, name string, start_date string, categories array<string>, homepage_url string, sources array<struct<url:string>>"


@query(
    "feed_read",
    """SELECT event_type AS feed, event_id, event_type || ' ' || user_id AS name, strftime(ts, '%Y-%m-%d') AS start_date, event_type || ',' || (user_id % 3) AS category,
    CASE WHEN event_id % 2 = 0 THEN 'https://s.org/' || event_id ELSE 'https://h.org/' || user_id END AS source_url FROM events""",
)
def feed_read(spark, d):
    """A feed for each kind of event, in pages by ranges of ids that name the next one; events in the shape that a search shows."""
    connector.register(spark)
    e = table(spark, d, "events").withColumn("page", F.floor(F.col("event_id") / 500))
    text = lambda c: F.col(c).cast("string")
    url = lambda base, c: F.concat(F.lit(base), text(c))
    one = F.struct(
        "event_id",
        F.concat_ws(" ", "event_type", text("user_id")).alias("name"),
        F.date_format("ts", "yyyy-MM-dd").alias("start_date"),
        F.array(F.col("event_type"), (F.col("user_id") % 3).cast("string")).alias("categories"),
        url("https://h.org/", "user_id").alias("homepage_url"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.struct(url("https://s.org/", "event_id").alias("url")))).alias("sources"),
    )
    last = e.agg(F.coalesce(F.max("page"), F.lit(0))).first()[0]
    held = e.groupBy(F.col("event_type").alias("feed"), "page").agg(F.array_sort(F.collect_list(one)).alias("data"))
    every = held.select("feed").distinct().select("feed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("page")).join(held, ["feed", "page"], "left")
    body = F.to_json(F.struct("data", F.struct(F.when(F.col("page") < last, F.format_string("c%d", F.col("page") + 1)).alias("next_cursor")).alias("page")))
    name = F.when(F.col("page") == 0, F.concat("feed", F.lit("/first.json"))).otherwise(F.format_string("%s/c%d.json", "feed", "page"))
    folder = _folder(spark, "feeds")
    write_bodies(every.select(name.alias("file"), body.alias("body")), folder, "file", "body")
    got = spark.read.format("feed").option("path", folder).load().select("feed", F.from_json("event", EVENT).alias("e")).select("feed", "e.*")
    return search.flat(got).select("feed", "event_id", "name", "start_date", "category", "source_url")


@query(
    "board_refs",
    """WITH p AS (SELECT doc_id // 20 AS board, doc_id % 20 AS ord, doc_id % 11 AS num, (['AI 세미나 ', '직원 모집 ', 'Tech-Day ', 'tech day', ' ', 'Notice ', 'MEETUP '])[doc_id % 7 + 1] || lang AS title FROM documents WHERE doc_id % 13 <> 0)
    SELECT board, 'aiia-' || num AS event_id, arg_min(title, ord) AS title FROM p WHERE doc_matches GROUP BY ALL""".replace("doc_matches", "regexp_matches(title, '(?i)세미나|tech[- ]?day|meetup')"),
)
def board_refs(spark, d):
    k = F.col("doc_id")
    title = F.concat(F.element_at(F.array(*map(F.lit, ["AI 세미나 ", "직원 모집 ", "Tech-Day ", "tech day", " ", "Notice ", "MEETUP "])), (k % 7 + 1).cast("int")), F.col("lang"))
    mode = F.when(k % 13 == 0, "LIST").otherwise("VIEW")
    one = F.concat(F.lit('<a href="/bbs/board.php?tbl=bbs41&amp;mode='), mode, F.lit("&amp;num="), (k % 11).cast("string"), F.lit('">'), title, F.lit("</a>"))
    posts = table(spark, d, "documents").select(F.floor(k / 20).alias("board"), F.struct((k % 20).alias("ord"), one.alias("a")).alias("post"))
    html = posts.groupBy("board").agg(F.array_join(F.transform(F.array_sort(F.collect_list("post")), lambda x: x["a"]), "").alias("html"))
    return venues.board_refs(html, "board", "html").select("board", "event_id", "title")


_DAYS = "DATE '2026-01-01' + (o_orderkey % 300)::INT"


@query(
    "showala_listing",
    f"""SELECT o_orderkey // 50 AS page, (row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1)::INT AS ord, o_orderkey::VARCHAR AS idx, (['KINTEX Hall 1', '킨텍스', 'BEXCO'])[o_orderkey % 3 + 1] AS venue,
    strftime({_DAYS}, '%Y-%m-%d') AS start, (o_orderkey // 50 + 1)::INT AS next, 9 AS total, o_orderkey % 3 < 2 AS here FROM orders""",
)
def showala_listing(spark, d):
    k = F.col("o_orderkey")
    venue = F.element_at(F.array(*map(F.lit, ["KINTEX Hall 1", "킨텍스", "BEXCO"])), (k % 3 + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    item = F.concat(
        F.lit('<li class="ex_item"><a class="ex_tit_a" href="ex_detail.php?idx='), k.cast("string"), F.lit('">x</a><div class="ex_date"><span>기간</span> '), day, F.lit(' ~ 2027-12-31</div><div class="ex_place"><span>장소</span> '), venue, F.lit(" </div></li>")
    )
    rows = table(spark, d, "orders").select(F.floor(k / 50).alias("page"), F.struct(k.alias("k"), item.alias("item")).alias("i"))
    html = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["item"]), "").alias("html"))
    html = html.withColumn("html", F.concat("html", F.lit(":::"), (F.col("page") + 1).cast("string"), F.lit(":::9\n")))
    return venues.listing(html, "page", "html").withColumn("here", venues.at_kintex(F.col("venue")))


def _zipped(c: Column) -> Column:
    @F.arrow_udf("binary")
    def run(b: pa.Array) -> pa.Array:
        return pa.array((None if (raw := x.as_py()) is None else gzip.compress(raw, 1, mtime=0) for x in b), pa.binary())

    return run(c)


@query(
    "response_bodies",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 2 THEN CASE WHEN 2 * length(t) + 2 * len(regexp_extract_all(t, '[\\x{10000}-\\x{10FFFF}]')) <= 3000 THEN t END WHEN octet_length(encode(t)) <= 3000 THEN t END AS body
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def response_bodies(spark, d):
    """Bodies as they are, packed, in UTF-16 and in a charset that there isn't, of at most 3,000 bytes."""
    k = F.col("doc_id") % 4
    plain = F.encode("text", "UTF-8")
    rows = table(spark, d, "documents").select("doc_id", F.when(k == 1, _zipped(F.when(k == 1, plain))).when(k == 2, F.encode("text", "UTF-16BE")).otherwise(plain).alias("raw"), F.when(k == 2, "utf-16-be").when(k == 3, "x-none").alias("charset"), (k == 1).alias("packed"))
    return rows.select("doc_id", web.unpacked(F.col("raw"), F.col("charset"), 3000, F.col("packed")).alias("body"))


@query(
    "canonical_sources",
    """SELECT s_suppkey, '[' || array_to_string(list_sort(list_distinct([to_json([u, 'venue', trim(s_name)])::VARCHAR, to_json([u, 'organizer', 'p q'])::VARCHAR, to_json([u, 'venue', trim(s_name)])::VARCHAR, to_json(['https://a.org/' || s_nationkey, 'venue', 'x'])::VARCHAR])), ',') || ']' AS sources
    FROM (SELECT *, 'https://s.org/' || s_suppkey AS u FROM supplier)""",
)
def canonical_sources(spark, d):
    u = F.concat(F.lit("https://s.org/"), F.col("s_suppkey").cast("string"))
    one = lambda url, kind, by, at: F.struct(url.alias("url"), F.lit(kind).alias("type"), by.alias("publisher"), F.lit(at).alias("retrieved_at"))
    a = F.array(one(u, "venue", F.col("s_name"), "1"), one(u, "organizer", F.lit(" p \t q "), "2"), one(F.concat(u, F.lit(" ")), "venue", F.col("s_name"), "3"), one(F.concat(F.lit("https://a.org/"), F.col("s_nationkey").cast("string")), "venue", F.lit("x"), "4"))
    return table(spark, d, "supplier").select("s_suppkey", hashing.canonical_sources(a).alias("sources"))


@query(
    "sitemap_refs",
    """WITH p AS (SELECT page_id // 40 AS site, page_id // 8 % 5 AS s, page_id, 'e' || page_id % 30 AS slug FROM pages)
    SELECT site, 'coex-' || slug AS event_id, 'https://www.venue.org/exhibitions/' || slug || '/' AS url FROM p WHERE (site + s) % 4 <> 0 AND (site + s) % 5 <> 1 GROUP BY ALL""",
)
def sitemap_refs(spark, d):
    """Sitemaps of a site for every forty pages, in five parts, of which some are missing or broken."""
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", F.floor(k / 40).alias("site"), (F.floor(k / 8) % 5).alias("s"), F.concat(F.lit("https://www.venue.org/exhibitions/e"), (k % 30).cast("string"), F.lit("/")).alias("loc"))
    listed = lambda tag, inner, locs: F.concat(F.lit(f"<{tag}>"), F.array_join(F.transform(F.array_sort(locs), lambda x: F.concat(F.lit(f"<{inner}><loc> "), x["loc"], F.lit(f"</loc></{inner}>"))), ""), F.lit(f"</{tag}>"))
    at = F.format_string("https://www.venue.org/%d/wp-sitemap-posts-exhibitions-%d.xml", "site", "s")
    shards = p.groupBy("site", "s").agg(listed("urlset", "url", F.collect_list(F.struct("page_id", "loc"))).alias("xml")).withColumn("url", at)
    other = F.array(F.struct(F.lit(99).cast("long").alias("s"), F.lit("https://www.venue.org/wp-sitemap-posts-page-1.xml").alias("loc")))
    index = shards.groupBy("site").agg(listed("sitemapindex", "sitemap", F.concat(F.collect_list(F.struct("s", F.col("url").alias("loc"))), other)).alias("xml"))
    n = F.col("site") + F.col("s")
    fetched = shards.select("url", F.when(n % 4 == 0, 404).otherwise(200).alias("status"), F.when(n % 5 == 1, "<html>").otherwise(F.col("xml")).alias("xml"))
    return walks.sitemap_refs(index, fetched, "site", "coex")


_MD = r"""replace(regexp_replace({c}, '([\\`|*_\[\]()<>&])', '\\\1', 'g'), chr(10), ' ')"""


@query(
    "markdown_page",
    rf"""WITH p AS (SELECT event_id, {_MD.format(c='event_type')} AS kind, {_MD.format(c='props')} AS props, row_number() OVER (ORDER BY ts, event_id) AS r FROM events QUALIFY r <= 20),
    f AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT 'category_counts: ' || (SELECT string_agg(event_type || ' ' || n, ', ' ORDER BY event_type) FROM f) || chr(10) || chr(10) || '| id | kind | props |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || event_id || ' | ' || kind || ' | ' || props || ' |' || chr(10), '' ORDER BY r) AS body FROM p""",
)
def markdown_page(spark, d):
    events, spec = table(spark, d, "events"), keyset.PageSpec(["ts", "event_id"])
    p = keyset.trimmed(keyset.page(events, spec), spec)
    counts = events.groupBy("event_type").agg(F.count("*").alias("n")).select(F.col("event_type").alias("ord"), F.col("event_type").alias("name"), "n")
    return render.markdown_page(p, {"id": F.col("event_id").cast("string"), "kind": T.md_text(F.col("event_type")), "props": T.md_text(F.col("props"))}, "page_pos", counts)


@query(
    "markdown_detail",
    rf"""SELECT p_partkey, '| field | value |' || chr(10) || '| --- | --- |' || chr(10) || '| name | ' || {_MD.format(c='p_name')} || ' |' || chr(10) || '| brand | ' || CASE WHEN p_partkey % 2 = 0 THEN {_MD.format(c='p_brand')} ELSE '' END || ' |' || chr(10) AS body FROM part""",
)
def markdown_detail(spark, d):
    cols = {"name": T.md_text(F.col("p_name")), "brand": F.when(F.col("p_partkey") % 2 == 0, T.md_text(F.col("p_brand")))}
    return table(spark, d, "part").select("p_partkey", render.markdown_detail(cols).alias("body"))


@query(
    "next_page_urls",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN '/api/v1/events?' || CASE WHEN c_custkey % 2 = 0 THEN 'category=a+b%26c&' ELSE '' END || 'cursor=' || replace(c_mktsegment, ' ', '+') || '-' || c_custkey || '&limit=20' END AS url FROM customer""",
)
def next_page_urls(spark, d):
    k = F.col("c_custkey")
    cursor = F.when(k % 5 != 0, F.concat_ws("-", "c_mktsegment", k.cast("string"))).otherwise("")
    url = render.next_page(F.lit("/api/v1/events"), {"limit": F.lit("20"), "category": F.when(k % 2 == 0, "a b&c")}, cursor)
    return table(spark, d, "customer").select("c_custkey", url.alias("url"))
