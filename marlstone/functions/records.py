"""Building and checking canonical event records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import CATEGORIES, blank_to_null

#: Kinds of sources.
SOURCE_TYPES = ("venue", "organizer", "association", "press", "social", "aggregator")


def missing(paths: dict[str, Column]) -> Column:
    """Sorted paths whose condition holds."""
    return F.filter(F.array(*[F.when(F.coalesce(paths[p], F.lit(False)), F.lit(p)) for p in sorted(paths)]), lambda x: x.isNotNull())


def is_http(url: Column) -> Column:
    return F.coalesce(F.regexp_like(F.trim(url), F.lit(r"(?i)^https?://\S")), F.lit(False))


def http_url(url: Column) -> Column:
    return F.when(is_http(url), F.trim(url))


def venue(venue_id: Column, name: Column, hall: Column, city: Column) -> tuple[Column, Column]:
    """The venue, null if it has neither name, hall nor city, and the missing paths."""
    i, n, h, c = (blank_to_null(x) for x in (venue_id, name, hall, city))
    none = n.isNull() & h.isNull() & c.isNull()
    made = F.when(~none, F.struct(i.alias("venue_id"), n.alias("name"), h.alias("hall"), c.alias("city")))
    return made, missing({f"venue.{k}": none | v.isNull() for k, v in (("venue_id", i), ("name", n), ("hall", h), ("city", c))})


def sources(url: Column, kind: Column, publisher: Column, venue_name: Column, source_id: Column, retrieved: Column, extra: Column) -> Column:
    """The primary source and the valid further ones; none at all if the page's own address is invalid."""
    first = F.struct(F.trim(url).alias("url"), F.coalesce(blank_to_null(kind), F.lit("venue")).alias("type"), F.coalesce(blank_to_null(publisher), blank_to_null(venue_name), source_id).alias("publisher"), retrieved.alias("retrieved_at"))
    more = F.filter(extra, lambda s: is_http(s["url"]) & s["type"].isin(*SOURCE_TYPES) & (F.trim(s["publisher"]) != ""))
    every = F.concat(F.array(first), more)
    return F.when(is_http(url), every).otherwise(F.slice(every, 1, 0))


def validate() -> Column:
    """The first rule that a record breaks, or null; reads the record's columns by name."""
    c = F.col

    def blank(x: str) -> Column:
        return F.coalesce(F.trim(c(x)) == "", F.lit(True))

    src = c("sources")
    out = F.when(blank("event_id"), "rule1: event_id required")
    for f in ("schema_version", "name", "country", "confidence"):
        out = out.when(blank(f), f"rule1: {f} required")
    return (
        out.when(c("missing_fields").isNull(), "rule1: missing_fields required")
        .when(blank("last_checked_at"), "rule1: last_checked_at required")
        .when(~c("excluded") & (F.size("categories") <= 0), "rule1: categories required (>=1) for non-excluded event")
        .when(F.exists("categories", lambda x: ~x.isin(*CATEGORIES)), "rule4: category not in taxonomy")
        .when(c("end_date") < c("start_date"), "rule3: end_date before start_date")
        .when(F.coalesce(F.size(src), F.lit(0)) <= 0, "rule5: at least one source required")
        .when(F.exists(src, lambda s: ~is_http(s["url"])), "rule5: source url not http(s)")
        .when(F.exists(src, lambda s: ~s["type"].isin(*SOURCE_TYPES)), "rule5: source type not in enum")
        .when(F.exists(src, lambda s: F.trim(s["publisher"]) == ""), "rule5: source publisher required")
        .when(F.exists(src, lambda s: F.trim(s["retrieved_at"]) == ""), "rule5: source retrieved_at required")
    )


def without_template_summary(summary: Column, name: Column) -> Column:
    """Null where a summary only repeats the name, alone or before a dash or an at sign; ASCII case aside."""
    s, n = F.lower(summary), F.lower(name)
    return F.when(~((s == n) | F.startswith(s, F.concat(n, F.lit(" — "))) | F.startswith(s, F.concat(n, F.lit(" @ ")))), summary)


def appended(paths: Column, path: str) -> Column:
    """The paths with one more at the end if it isn't there; null becomes that one alone."""
    return F.when(paths.isNull(), F.array(F.lit(path))).when(F.array_contains(paths, path), paths).otherwise(F.array_append(paths, F.lit(path)))
