"""A crawl as level-synchronous joins over fetched pages: frontier, dispatch, edges, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.urls import canonicalize, is_allowed
from marlstone.operators.graph import reach
from marlstone.operators.sequence import first_seen

#: Ceilings of one crawl.
LIMITS = {"seeds": 8, "depth": 2, "protocol_documents": 12, "pages": 24, "candidates": 30, "attempts": 64, "bytes": 6 << 20, "seconds": 60}


def clamped(option: Column, name: str) -> Column:
    """A budget within its ceiling; nothing or less than one is the ceiling."""
    return F.when(option >= 1, F.least(option, F.lit(LIMITS[name]))).otherwise(LIMITS[name])


def document_route(media: Column, body: Column) -> Column:
    """Which parser a fetched document goes to."""
    return (
        F.when(media.isin("application/feed+json", "application/json"), "json_feed")
        .when(F.contains(body, F.lit("<urlset")) | F.contains(body, F.lit("<sitemapindex")), "sitemap")
        .when(media.isin("application/rss+xml", "application/atom+xml", "application/xml", "text/xml") & (F.contains(body, F.lit("<rss")) | F.contains(body, F.lit("<feed"))), "xml_feed")
        .when(media.isin("text/html", "application/xhtml+xml"), "html")
        .otherwise("malformed")
    )


def seed_documents(seeds: DataFrame, robots: DataFrame, host: str) -> DataFrame:
    """(host, url) of a seed's sitemaps: those that its robots file names, else the usual place; none without robots."""
    named = robots.select(host, "status", F.filter("rules", lambda r: r["directive"] == "sitemap").alias("maps"))
    j = seeds.join(named, host, "left")
    usual = F.array(F.concat(F.lit("https://"), F.col(host), F.lit("/sitemap.xml")))
    urls = F.when(F.col("status").isNull() | (F.col("status") >= 500), F.lit(None).cast("array<string>")).when(F.size("maps") > 0, F.transform("maps", lambda r: r["value"])).otherwise(usual)
    return j.select(host, F.explode(urls).alias("url"))


def failure(status: Column, robots_denied: Column, budget: Column) -> Column:
    """The outcome that a failed fetch gives its seed."""
    return F.when(budget, "budget").when(robots_denied, "robots_disallowed").when(status.isNull() | (status >= 400), "fetch_failed")


def crawl(pages: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = LIMITS["depth"]) -> DataFrame:
    """(url, depth, title) of the pages reached; a page without a title of its own gets that of its first link."""
    got = reach(edges.select("src", "dst"), seeds, depth).withColumnRenamed("node", "url")
    said = first_seen(edges.where("text <> ''").select(F.col("dst").alias("url"), "ord", "text"), ["url"], ["ord", "text"]).select("url", "text")
    return got.join(pages, "url", "left").join(said, "url", "left").select("url", "depth", F.coalesce(F.nullif("title", F.lit("")), "text").alias("title"))


def seed_catalogue(seeds: DataFrame, catalogue: str, most: int = LIMITS["seeds"]) -> DataFrame:
    """(catalogue, error, seeds) of rows (catalogue, ord, name, url): a catalogue has one seed to `most`, each with a name
    of its own and an address that may be fetched; names come without outer blanks, addresses in canonical form."""
    name, url = F.trim("name"), canonicalize(F.col("url"))
    good = F.coalesce((name != "") & url.isNotNull() & is_allowed(F.col("url")), F.lit(False))
    row = F.struct("ord", name.alias("name"), url.alias("url"), good.alias("good"))
    got = seeds.groupBy(catalogue).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(name).alias("names"), F.bool_and(good).alias("good"), F.array_sort(F.collect_list(row)).alias("all"))
    error = F.when(F.col("n") > most, "too_many").when(~F.col("good"), "invalid_seed").when(F.col("names") < F.col("n"), "repeated_name")
    kept = F.transform("all", lambda s: F.struct(s["name"].alias("name"), s["url"].alias("url")))
    return got.select(catalogue, error.alias("error"), F.when(error.isNull(), kept).alias("seeds"))


def paced(requests: DataFrame, host: str, at: str, order: str, interval: Column) -> DataFrame:
    """The rows with `starts`, the second at which a host's request may begin: in order, never before it is made and never
    less than `interval` seconds, the same for all of a host, after the one before. A null interval is 0."""
    step = F.coalesce(interval, F.lit(0)).cast("double")
    by = Window.partitionBy(host).orderBy(at, order)
    nth = F.row_number().over(by) * step
    ahead = F.max(F.col(at).cast("double") - F.col("_nth")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("_nth", nth).withColumn("starts", F.col("_nth") + ahead).drop("_nth")
