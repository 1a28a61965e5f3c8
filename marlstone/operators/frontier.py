"""Crawls with two queues and budgets, many at a time: protocol documents before pages, each queue in order of discovery.

A round takes from every open crawl what can be read without looking at what follows: all of its queued protocol
documents, or, if there are none, its pages up to the first one that leads to a new protocol document, which goes before the pages
behind it. What fits a crawl's budgets is found by running sums over the round's documents in their order, so a round is a few
joins and windows over narrow rows, and the number of rounds is bounded by the budgets of one crawl, not by the number of crawls.
A crawl's rows in a round are bounded by its budgets as well (`pages` documents of `LINKS` links), so none of them is a large
group. Documents are read as a whole once for each link of depth, to find those that any crawl may reach; rounds read only these.

* A document beyond its kind's number isn't read; neither is what is queued behind it.
* A fetch that needs more attempts or bytes than are left uses them up and stops its crawl.
* A fetch that fails costs its attempts and bytes and leads nowhere. An address without a document fails at one attempt.
* Links below the depth, links already queued and null links aren't queued; of a link found twice the first counts.

The number of candidates never decides what is read: with the fixed values a crawl reads 24 pages, and a link is refused a
candidate's place only once 30 are queued. `walks.slots` gives these places.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import web
from marlstone.operators.crawl import LIMITS
from marlstone.operators.graph import reach
from marlstone.operators.sequence import first_seen
from marlstone.session import cut

#: Fixed value: links taken from one document.
LINKS = 96


def page_links(links: Column, most: int = LINKS) -> Column:
    """array<struct<href, protocol>> of a parsed page's links: sitemaps and feeds first, then its anchors, `most` in all.

    links: as `web.pages` gives them. A `<link>` to anything else isn't one."""
    kind = lambda x: web.document_kind(x["rel"], x["type"])
    heads = F.filter(links, lambda x: (x["tag"] == "link") & (kind(x) != "page"))
    anchors = F.filter(links, lambda x: x["tag"] == "a")
    return F.transform(F.slice(F.concat(heads, anchors), 1, most), lambda x: F.struct(F.trim(x["href"]).alias("href"), (x["tag"] == "link").alias("protocol")))


def _used(done: DataFrame | None, open_: DataFrame) -> DataFrame:
    """What each crawl has used so far."""
    zero = {"used_attempts": 0, "used_bytes": 0, "used_protocol": 0, "used_pages": 0}
    if done is None:
        return open_.select("crawl").distinct().withColumns({**{c: F.lit(v).cast("long") for c, v in zero.items()}, "stopped": F.lit(False)})
    return done.groupBy("crawl").agg(
        F.sum("attempts").alias("used_attempts"),
        F.sum("bytes").alias("used_bytes"),
        F.count_if("protocol").alias("used_protocol"),
        F.count_if(~F.col("protocol")).alias("used_pages"),
        F.bool_or(F.col("status").startswith("stopped")).alias("stopped"),
    )


def _within(batch: DataFrame, limits: dict) -> DataFrame:
    """The rows of a round with `status` and what each costs, up to the one that stops its crawl."""
    so_far = Window.partitionBy("crawl").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("crawl").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = batch.withColumns({"all_attempts": F.col("used_attempts") + F.sum("attempts").over(so_far), "all_bytes": F.col("used_bytes") + F.sum("bytes").over(so_far)})
    over = F.when(F.col("all_attempts") > limits["attempts"], "stopped: attempts").when(F.col("all_bytes") > limits["bytes"], "stopped: bytes")
    status = sums.withColumn("status", F.coalesce(over, F.when(F.col("ok"), "read").otherwise("failed")))
    kept = status.withColumn("late", F.coalesce(F.count_if(F.col("status").startswith("stopped")).over(before), F.lit(0))).where("late = 0")
    left_attempts = F.greatest(F.lit(limits["attempts"]) - (F.col("all_attempts") - F.col("attempts")), F.lit(0))
    left_bytes = F.greatest(F.lit(limits["bytes"]) - (F.col("all_bytes") - F.col("bytes")), F.lit(0))
    return kept.withColumns({"attempts": F.least("attempts", left_attempts), "bytes": F.when(F.col("status") == "stopped: attempts", 0).otherwise(F.least("bytes", left_bytes))})


def crawled(docs: DataFrame, seeds: DataFrame, limits: dict | None = None) -> DataFrame:
    """(crawl, url, parent, protocol, depth, visit, status, attempts, bytes, deep) of every address that a crawl queues.

    docs: (url, attempts, bytes, ok, links: array of (href, protocol)), one row for an address, best a table that is written; seeds: (crawl, ord, url,
    protocol), in the order in which a crawl queues them. `visit` counts a crawl's fetches from 1. `status` is read,
    failed, stopped: attempts, stopped: bytes or not attempted (`visit` null, nothing used). `deep`: links lay below the
    depth. limits: values in place of those of `crawl.LIMITS`. Without seeds the result is empty.
    """
    limits = {**LIMITS, **(limits or {})}
    kind = seeds.schema["crawl"].dataType.simpleString()
    docs = docs.select("url", F.coalesce("attempts", F.lit(1)).cast("long").alias("attempts"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("ok", F.lit(False)).alias("ok"), "links")
    linked = docs.select(F.col("url").alias("src"), F.explode("links.href").alias("dst")).where("dst IS NOT NULL")
    near = reach(linked, seeds.where("url IS NOT NULL").select("url"), limits["depth"]).select(F.col("node").alias("url"))
    docs = cut(docs.join(near, "url", "left_semi"))
    start = first_seen(seeds.where("url IS NOT NULL").select("crawl", "url", "ord", "protocol"), ["crawl", "url"], ["ord", "protocol"])
    nth = F.row_number().over(Window.partitionBy("crawl").orderBy("ord", "url")).cast("long")
    open_ = cut(start.select("crawl", "url", F.lit(None).cast("string").alias("parent"), "protocol", F.lit(0).alias("depth"), nth.alias("place")))
    seen, done = open_.select("crawl", "url"), None
    by_kind, all_rows = Window.partitionBy("crawl", "protocol").orderBy("place"), Window.partitionBy("crawl")
    for r in count(1):
        have = open_.join(_used(done, open_), "crawl", "left").fillna(0, ["used_attempts", "used_bytes", "used_protocol", "used_pages"]).where("NOT coalesce(stopped, false)").drop("stopped")
        room = F.when(F.col("protocol"), limits["protocol_documents"] - F.col("used_protocol")).otherwise(limits["pages"] - F.col("used_pages"))
        fit = have.withColumn("nth", F.row_number().over(by_kind)).where(F.col("nth") <= room)
        turn = fit.withColumn("any_protocol", F.bool_or("protocol").over(all_rows)).where("protocol = any_protocol")
        step = turn.drop("nth", "any_protocol").join(docs, "url", "left").fillna({"attempts": 1, "bytes": 0, "ok": False})
        deep = (F.col("depth") >= limits["depth"]) & (F.size(F.coalesce("links", F.array().cast(docs.schema["links"].dataType))) > 0)
        step = cut(_within(step, limits).withColumn("deep", (F.col("status") == "read") & deep).drop("used_attempts", "used_bytes", "used_protocol", "used_pages", "all_attempts", "all_bytes", "late", "ok"))
        if step.isEmpty():
            break
        found = step.where(F.col("status") == "read").where(F.col("depth") < limits["depth"])
        found = found.select("crawl", "place", F.col("url").alias("parent"), F.col("protocol").alias("from_protocol"), (F.col("depth") + 1).alias("depth"), F.posexplode("links").alias("at", "l"))
        found = found.select("crawl", F.col("l.href").alias("url"), "place", "at", "parent", "from_protocol", "depth", F.coalesce("l.protocol", F.lit(False)).alias("protocol")).where("url IS NOT NULL")
        fresh = first_seen(found, ["crawl", "url"], ["place", "at"]).join(seen, ["crawl", "url"], "left_anti")
        # A page that leads to a protocol document is the last one of its round.
        fresh = cut(fresh.withColumn("last", F.min(F.when(F.col("protocol") & ~F.col("from_protocol"), F.col("place"))).over(all_rows)))
        last = fresh.where("last IS NOT NULL").groupBy("crawl").agg(F.first("last").alias("last"))
        # What later rounds look at is written, so that no round plans the ones before it anew.
        step = cut(step.join(last, "crawl", "left").where("last IS NULL OR place <= last").drop("last", "links").withColumn("round", F.lit(r)))
        done = step if done is None else done.unionByName(step)
        nth = F.row_number().over(Window.partitionBy("crawl").orderBy("place", "at"))
        new = cut(fresh.where("last IS NULL OR place <= last").select("crawl", "url", "parent", "protocol", "depth", (F.lit(r).cast("long") * (1 << 32) + nth).alias("place")))
        open_ = cut(open_.join(step.select("crawl", "url"), ["crawl", "url"], "left_anti").unionByName(new))
        seen = seen.unionByName(new.select("crawl", "url"))
    cols = ["crawl", "url", "parent", "protocol", "depth"]
    left = open_.select(*cols, F.lit(None).cast("int").alias("visit"), F.lit("not attempted").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("deep"))
    if done is None:
        return left
    visit = F.row_number().over(Window.partitionBy("crawl").orderBy("round", "place"))
    return done.withColumn("visit", visit).select(F.col("crawl").cast(kind).alias("crawl"), *cols[1:], "visit", "status", "attempts", "bytes", "deep").unionByName(left)


def usage(rows: DataFrame, limits: dict | None = None) -> DataFrame:
    """(crawl, attempts, bytes, protocol_documents, pages, reasons) of `crawled`: what was used and, in the order of the budgets'
    names, which of them cut the crawl short."""
    limits = {**LIMITS, **(limits or {})}
    tried, waits = F.col("visit").isNotNull(), F.col("visit").isNull()
    stop = lambda what: F.bool_or(F.col("status") == f"stopped: {what}")
    sums = rows.groupBy("crawl").agg(
        F.sum("attempts").alias("attempts"),
        F.sum("bytes").alias("bytes"),
        F.count_if(tried & F.col("protocol")).alias("protocol_documents"),
        F.count_if(tried & ~F.col("protocol")).alias("pages"),
        F.bool_or("deep").alias("deep"),
        F.bool_or(waits & F.col("protocol")).alias("protocol_waits"),
        F.bool_or(waits & ~F.col("protocol")).alias("page_waits"),
        F.bool_or(F.col("status").startswith("stopped") & F.col("protocol")).alias("protocol_stops"),
        stop("attempts").alias("no_attempts"),
        stop("bytes").alias("no_bytes"),
    )
    stopped = F.col("no_attempts") | F.col("no_bytes")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("deep"), "depth_limit"),
            F.when(F.col("protocol_waits") & (F.col("protocol_documents") >= limits["protocol_documents"]) & ~F.col("protocol_stops"), "protocol_document_limit"),
            F.when(F.col("page_waits") & (F.col("pages") >= limits["pages"]) & ~stopped, "html_page_limit"),
            F.when(F.col("no_attempts"), "http_attempt_limit"),
            F.when(F.col("no_bytes"), "response_body_limit"),
        )
    )
    return sums.select("crawl", "attempts", "bytes", "protocol_documents", "pages", reasons.alias("reasons"))
