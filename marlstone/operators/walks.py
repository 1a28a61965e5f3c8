"""Walks over fetched list pages: in which order they are read, and where a walk ends.

The bounds are features of the walks: a site's schedule is read for 80 pages at most, a board for a few months of a few
pages each, a listing for 25 pages. Only addresses within such a bound are held by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import web
from marlstone.functions.urls import slug
from marlstone.operators.sequence import before_run, first_seen, folded
from marlstone.session import cut

#: Bounds of the walks.
SCHEDULE_PAGES, BOARD_MONTHS, BOARD_PAGES, LISTING_PAGES = 80, 3, 6, 25


def first_in_first_out(pages: DataFrame, starts: list[str], most: int = SCHEDULE_PAGES) -> DataFrame:
    """Rows of `pages` (path, status, links) that a queue reads, with `visit`, the place in the order of reading.

    An address takes a place whether or not its page is there; only pages of status 200 hand on links. Null links and
    repeated ones are passed over; without pages or starts the result is empty.
    """
    spark = pages.sparkSession
    seen = list(dict.fromkeys(starts))[:most]
    placed = lambda paths, at: spark.createDataFrame(list(zip(paths, range(at, at + len(paths)), strict=True)), "path string, visit int")
    level, at = seen, 0
    while level and len(seen) < most:
        links = pages.where("status = 200").join(F.broadcast(placed(level, at)), "path").select("visit", F.posexplode("links").alias("_at", "_to"))
        new = links.where(F.col("_to").isNotNull() & ~F.col("_to").isin(seen)).groupBy("_to").agg(F.min(F.struct("visit", "_at")).alias("_first"))
        at, level = len(seen), [r["_to"] for r in new.orderBy("_first").limit(most - len(seen)).collect()]
        seen = seen + level
    return pages.join(F.broadcast(placed(seen, 0)), "path")


def month_views(refs: DataFrame, months: int = BOARD_MONTHS, pages: int = BOARD_PAGES) -> DataFrame:
    """(month, page, ord, id) of the entries that a walk over months 0, 1, ... finds new; a month ends at its first page
    without a new entry. rows: (month, page, ord, id); a null id is no entry."""
    seen = None
    for m in range(months):
        view = refs.where((F.col("month") == m) & F.col("page").between(1, pages) & F.col("id").isNotNull())
        if seen is not None:
            view = view.join(seen.select("id"), "id", "left_anti")
        fresh = cut(first_seen(view.select("month", "page", "ord", "id"), ["id"], ["page", "ord"]))
        having = fresh.agg(F.collect_set("page").alias("_p"))
        upto = having.select(F.explode(F.filter(F.sequence(F.lit(1), F.lit(pages)), lambda p: F.forall(F.sequence(F.lit(1), p), lambda q: F.array_contains("_p", q.cast(refs.schema["page"].dataType))))).alias("_page"))
        read = fresh.join(F.broadcast(upto), F.col("page") == F.col("_page"), "left_semi")
        seen = read if seen is None else seen.unionByName(read)
    return seen


def listing_rows(rows: DataFrame, footers: DataFrame, by: str, order: list[str], past: Column, run: int, most: int = LISTING_PAGES) -> DataFrame:
    """Rows of each listing that are read before `run` past ones follow on one another, or before the pages end.

    footers: (by, page, rows, next, total), 0 where a page names none. From page 2 on a page is the last if it has no
    rows, if the total is reached, or if the next page isn't a later one. Rows without a date (`past` is null) count for
    nothing but are handed on.
    """
    ends = (F.col("rows") == 0) | ((F.col("total") > 0) & (F.col("page") >= F.col("total"))) | ((F.col("next") > 0) & (F.col("next") <= F.col("page")))
    last = footers.where((F.col("page") >= 2) & ends).groupBy(by).agg(F.min("page").alias("_last"))
    read = rows.join(last, by, "left").where(F.col("page") <= F.least(F.coalesce("_last", F.lit(most)), F.lit(most))).drop("_last")
    return before_run(read, by, order, past.isNotNull(), F.coalesce(past, F.lit(False)), run)


def preferred(first: DataFrame, other: DataFrame, by: str) -> DataFrame:
    """The rows of `first`, and those of `other` of groups that have none in `first`."""
    return first.unionByName(other.join(first.select(by), by, "left_anti").select(*first.columns))


#: Fixed value: which parts of a sitemap index hold exhibitions.
SHARDS = r"/wp-sitemap-posts-exhibitions-[0-9]+\.xml$"


def sitemap_refs(index: DataFrame, shards: DataFrame, site: str, source: str, pattern: str = SHARDS) -> DataFrame:
    """(site, event_id, url) of the pages that the sitemaps of each site name, the first of each id.

    index: (site, xml), shards: (url, status, xml). Only parts that match `pattern` are read, in the index's order; one that
    is missing, not of status 200 or no url set is passed over. A site whose index names no such part has no rows; so the
    caller can tell it from one whose parts are empty by the index.
    """
    named = index.select(site, F.posexplode(web.sitemap(F.col("xml"))["locs"]).alias("_i", "_shard")).where(F.regexp_like("_shard", F.lit(pattern)))
    read = shards.where("status = 200").select(F.col("url").alias("_shard"), web.sitemap(F.col("xml")).alias("_s")).where("_s.kind = 'urlset'")
    locs = named.join(read, "_shard").select(site, "_i", F.posexplode("_s.locs").alias("_j", "url"))
    refs = locs.withColumn("event_id", F.concat(F.lit(f"{source}-"), slug(F.col("url")))).where("event_id IS NOT NULL")
    return first_seen(refs, [site, "event_id"], ["_i", "_j"]).select(site, "event_id", "url")


def edges(docs: DataFrame) -> DataFrame:
    """(url, dst, kind, depth, candidate) for each link of fetched documents (url, route, depth, links).

    links: array of (url, kind). An index's children and links to sitemaps and feeds are only read on; all others are
    candidates too. Links without an address are dropped; a document without links gives no row.
    """
    link = docs.select("url", "route", (F.col("depth") + 1).alias("depth"), F.explode("links").alias("_l"))
    kind = F.when(F.col("route") == "sitemap_index", "sitemap").otherwise(F.coalesce("_l.kind", F.lit("auto")))
    out = link.select("url", F.col("_l.url").alias("dst"), kind.alias("kind"), "depth").where("dst IS NOT NULL")
    return out.withColumn("candidate", ~F.col("kind").isin("sitemap", "feed"))


def slots(found: DataFrame, crawl: str, order: str, seeds: int, most: int = 30) -> DataFrame:
    """(crawl, order, stored) of a crawl's steps: whether a found candidate is stored, null for steps that are none.

    found: (crawl, order, seed, candidate, outcome). Every seed that has no outcome yet keeps a place, so others are
    stored below `most` less the seeds that are open, and seeds below `most`. A crawl's steps follow from one another; they are
    read in order by one task that holds two counts, so their number doesn't matter. Null flags are false.
    """

    def judge():
        n = done = 0

        def ask(_: float, seed: bool | None, candidate: bool | None, outcome: bool | None) -> bool | None:
            nonlocal n, done
            done += bool(outcome)
            if not candidate:
                return None
            stored = n < (most if seed else max(most - max(seeds - done, 0), 0))
            n += stored
            return stored

        return ask

    return folded(found, crawl, F.lit(0.0), (order,), judge, ("seed", "candidate", "outcome"), "stored")


def link_headers_within(values: Column, most: int = 16, size: int = 8 << 10) -> Column:
    """The Link headers of a response, null if they are too many or too large; none is an empty array."""
    values = F.coalesce(values, F.array().cast("array<string>"))
    bytes_ = F.aggregate(values, F.lit(0), lambda a, v: a + F.octet_length(F.coalesce(v, F.lit(""))))
    return F.when((F.size(values) <= most) & (bytes_ <= size), values)


def waits(statuses: Column, base: int = 500, retries: int = 2) -> Column:
    """Milliseconds waited before each further try of a fetch whose tries answer with these statuses; tries end at the
    first status that is neither 429 nor 500 or above, and after `retries` further ones."""
    again = lambda s: (s == 429) | (s >= 500)
    tries = F.filter(F.sequence(F.lit(1), F.lit(retries)), lambda i: (i < F.size(statuses)) & F.forall(F.slice(statuses, 1, i), again))
    return F.transform(tries, lambda i: (F.lit(base) * F.pow(F.lit(2), i - 1)).cast("int"))


def wants_actions(*signals: Column) -> Column:
    """Whether any signal is still unknown, so that asking a model is worth a call."""
    want = F.lit(False)
    for s in signals:
        want |= s.isNull()
    return want


def upserted(prev: DataFrame, inc: DataFrame, key: str) -> DataFrame:
    """The rows of both, those of `inc` in place of those with their key; each side has a key once."""
    return inc.unionByName(prev.join(inc.select(key), key, "left_anti"))
