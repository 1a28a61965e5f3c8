"""Raw records to canonical events, in column expressions: dates, venue, vocabulary, provenance, missing fields, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import dates, hashing, records
from marlstone.functions import text as T

RAW = ("name_ko", "name_en", "edition", "start_raw", "end_raw", "venue_name", "hall", "city", "country", "timezone", "format", "organizer", "publisher", "source_type", "homepage_url", "summary_text", "classify_text")
SUMMARY = 240


def _or(c: Column, default: str) -> Column:
    return F.coalesce(T.blank_to_null(c), F.lit(default))


def normalized(raw: DataFrame, now: str) -> DataFrame:
    """One event per raw record, with `error` for those that break a rule; null honesty is kept in `missing_fields`."""
    have = set(raw.columns)
    df = raw.withColumns({c: F.lit(None).cast("string") for c in RAW if c not in have})
    span = dates.date_range(F.col("start_raw"), F.col("end_raw"))
    vid = T.venue_id(F.col("source_id"), F.coalesce("venue_name", F.lit("")))
    place, place_missing = records.venue(vid, F.col("venue_name"), F.col("hall"), F.col("city"))
    cls = T.classify(F.col("classify_text"))
    none = F.expr("CAST(array() AS array<struct<url:string,type:string,publisher:string,retrieved_at:string>>)")
    src = records.sources(F.col("url"), F.col("source_type"), F.col("publisher"), F.col("venue_name"), F.col("source_id"), F.lit(now), none)
    df = df.withColumns({"_d": span, "_c": cls, "venue": place, "_vm": place_missing, "sources": src})
    optional = {"name_ko": T.blank_to_null(F.col("name_ko")), "name_en": T.blank_to_null(F.col("name_en")), "edition": T.blank_to_null(F.col("edition")), "homepage_url": records.http_url(F.col("homepage_url")), "summary": T.blank_to_null(T.left_runes(T.ws(F.col("summary_text")), SUMMARY))}
    fmt = T.blank_to_null(F.lower("format"))
    df = df.select(
        F.trim("event_id").alias("event_id"), F.lit("0.1").alias("schema_version"), T.ws(F.coalesce("name", F.lit(""))).alias("name"),
        *[v.alias(k) for k, v in optional.items()],
        F.col("_d.start").alias("start_date"), F.col("_d.end").alias("end_date"), F.col("_d.confidence").alias("date_confidence"), F.nullif(F.col("_d.note"), F.lit("")).alias("ambiguity_notes"),
        _or(F.col("timezone"), "Asia/Seoul").alias("timezone"), F.lit("scheduled").alias("status"), F.when(fmt.isin("onsite", "hybrid", "online"), fmt).otherwise("onsite").alias("format"),
        "venue", F.upper(_or(F.col("country"), "KR")).alias("country"), F.col("_c.categories").alias("categories"), F.col("_c.excluded").alias("excluded"), F.col("_c.confidence").alias("confidence"),
        "sources", F.lit(now).alias("last_checked_at"), "_vm",
    )
    gaps = records.missing({k: F.col(k).isNull() for k in ("name_ko", "name_en", "edition", "homepage_url", "summary", "start_date", "end_date")})
    df = df.withColumn("missing_fields", F.array_sort(F.array_distinct(F.concat(gaps, "_vm")))).drop("_vm")
    key = hashing.content_key(F.col("name"), F.coalesce("start_date", F.lit("")), F.coalesce("venue.venue_id", F.lit("")))
    return df.withColumn("content_key", key).withColumn("error", records.validate())


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and dead letters (event_id, stage, message)."""
    bad = events.where("error IS NOT NULL").select(F.nullif("event_id", F.lit("")).alias("event_id"), F.lit("normalize").alias("stage"), F.col("error").alias("message"))
    return events.where("error IS NULL").drop("error"), bad
