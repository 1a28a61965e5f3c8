"""Filling gaps of records from pages, structured data and suggested facts; what a source says itself always wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import dates, urls, web
from marlstone.functions import text as T
from marlstone.functions.records import http_url


def filled(base: Column, *others: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(T.blank_to_null(base), *[T.blank_to_null(o) for o in others])


def open_graph(html: Column, name: str) -> Column:
    """The content of an Open Graph tag."""
    return F.nullif(F.regexp_extract(html, f'<meta[^>]*property="og:{name}"[^>]*content="([^"]*)"', 1), F.lit(""))


def attendance(mode: Column) -> Column:
    """Format from a schema.org attendance mode."""
    return F.when(F.contains(mode, F.lit("Mixed")), "hybrid").when(F.contains(mode, F.lit("Online")), "online").when(F.contains(mode, F.lit("Offline")), "onsite")


def opened(df: DataFrame, title: str, snippet: str, page_title: str, page_text: str, bare_titles: bool = False) -> DataFrame:
    """A candidate's empty title and snippet from the opened page, contacts removed, at most 300 and 500 code points.

    bare_titles: a page's title is taken as it stands, neither redacted nor cut.
    """
    t = F.col(page_title) if bare_titles else T.left_runes(T.strip_contacts(F.col(page_title)), 300)
    s = T.left_runes(T.strip_contacts(F.col(page_text)), 500)
    return df.withColumns({title: filled(F.col(title), t), snippet: filled(F.col(snippet), s)}).drop(page_title, page_text)


def unmet(title: Column, location: Column, date: Column) -> Column:
    """The requirements that a candidate doesn't meet yet."""
    none = lambda c: T.blank_to_null(c).isNull()
    return F.array_compact(F.array(F.when(none(title), "title"), F.when(none(location), "location"), F.when(none(date), "date")))


def suggested_deadline(current: Column, suggested: Column, pages: Column) -> Column:
    """A suggested deadline where none is known, and only if one of the pages read bears it out."""
    shapes = F.transform(F.array(dates.normalize_deadline(suggested)), dates.date_shapes)  # once, however many pages there are
    borne = F.transform(shapes, lambda s: F.when(F.exists(pages, lambda p: dates.stands_in(p, s)), s["iso"]))
    return F.coalesce(current, borne[0])


def suggested_name(current: Column, suggested: Column, source_name: Column) -> Column:
    return F.coalesce(T.blank_to_null(current), F.when(T.latin_name(suggested, source_name), F.trim(suggested)))


def suggested_url(current: Column, suggested: Column) -> Column:
    return F.coalesce(http_url(current), http_url(suggested))


def with_provenance(sources: Column, changed: Column, url: Column, publisher: str) -> Column:
    """One more source where enrichment changed something."""
    one = F.struct(url.alias("url"), F.lit("organizer").alias("type"), F.lit(publisher).alias("publisher"), F.lit(None).cast("string").alias("retrieved_at"))
    return F.when(changed, F.concat(sources, F.array(one))).otherwise(sources)


def page_actions(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page (key, url, html): what its anchors let one do, by the first group of words that an anchor's text
    and address hold, the first address to register and to exhibit, what it costs, and the deadlines that it names.

    Flags are true or null. Addresses that are not http(s) don't count.
    """
    p = web.pages(pages.select(key, url, html), html)
    p = p.select(key, url, F.lower(F.concat_ws(" ", "title", "body")).alias("_low"), F.filter("links", lambda x: x["tag"] == "a").alias("_l"))
    p = p.withColumn("_to", urls.resolve_all(F.col(url), F.transform("_l", lambda x: x["href"])))
    said = lambda x: web.action_of(F.lower(F.concat_ws(" ", x["text"], F.trim(x["href"]))))
    p = p.withColumn("_a", F.zip_with("_l", "_to", lambda x, to: F.struct(F.when(to.isNotNull(), said(x)).alias("kind"), to.alias("to"))))
    of = lambda k: F.filter("_a", lambda a: a["kind"] == k)
    has = lambda k: F.exists("_a", lambda a: a["kind"] == k)
    flags = {"can_register": "register", "can_exhibit": "exhibit", "can_sponsor": "sponsor", "has_matchmaking": "match", "has_startup_program": "startup"}
    return p.select(
        key,
        T.cost_hint(F.col("_low")).alias("cost_hint"),
        dates.deadline_near(F.col("_low"), web.REGISTRATION_LABELS).alias("registration_deadline"),
        dates.deadline_near(F.col("_low"), web.EXHIBITOR_LABELS).alias("exhibitor_deadline"),
        *[F.when(has(k), F.lit(True)).alias(c) for c, k in flags.items()],
        F.get(of("register"), F.lit(0))["to"].alias("register_url"),
        F.get(of("exhibit"), F.lit(0))["to"].alias("exhibit_url"),
    )


def merged(steps: DataFrame, key: str, rank: Column, origin: str, url: str, fields: list[str]) -> DataFrame:
    """(key, fields, provenance, sources): field by field the value of the best-ranked origin that has one.

    steps: one row for each thing said of a key, from parsed pages down to suggestions. A blank text is no value. Of equal
    ranks the origin, then the address, then the value that comes first in the order of code points wins, so neither the
    order of arrival nor repeated rows change anything. provenance: array of (field, origin, url), in the order of
    `fields`; sources: the (origin, url) that gave a value, best rank first. All of it is minima, combined before the shuffle.
    """

    def said(f: str) -> Column:
        value = F.nullif(F.trim(f), F.lit("")).isNotNull() if steps.schema[f].dataType.simpleString() == "string" else F.col(f).isNotNull()
        return F.min(F.when(value, F.struct(rank.alias("rank"), F.col(origin).alias("origin"), F.col(url).alias("url"), F.col(f).alias("value")))).alias(f)

    best = steps.groupBy(key).agg(*[said(f) for f in fields])
    at = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"{f}.origin").alias("origin"), F.col(f"{f}.url").alias("url"))) for f in fields]))
    by = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.col(f"{f}.rank").alias("rank"), F.col(f"{f}.origin").alias("origin"), F.col(f"{f}.url").alias("url"))) for f in fields]))
    sources = F.transform(F.array_sort(F.array_distinct(by)), lambda s: F.struct(s["origin"].alias("origin"), s["url"].alias("url")))
    return best.select(key, *[F.col(f"{f}.value").alias(f) for f in fields], at.alias("provenance"), sources.alias("sources"))
