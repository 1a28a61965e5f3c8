"""Filters and rankings of event lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import CATEGORY_ALIASES


@dataclass
class EventFilter:
    """Empty fields don't filter."""

    category: str = ""
    region: str = ""
    keyword: str = ""
    from_date: str = ""
    to_date: str = ""


def matches(f: EventFilter) -> Column:
    """Case-insensitive substrings over a flat event row; a row without a start date passes both bounds."""

    def has(text: Column, part: str) -> Column:
        return F.contains(F.lower(text), F.lit(part.lower()))

    def joined(*cols: str) -> Column:
        return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])

    out = F.lit(True)
    if f.category:
        out &= has(F.col("category"), f.category)
    if f.region:
        out &= has(joined("city", "venue"), f.region)
    if f.keyword:
        out &= has(joined("name", "name_en"), f.keyword)
    undated = F.coalesce(F.col("start_date") == "", F.lit(True))
    if f.from_date:
        out &= undated | (F.col("start_date") >= f.from_date)
    if f.to_date:
        out &= undated | (F.col("start_date") <= f.to_date)
    return out


def aliased(category: Column) -> Column:
    out = category
    for k, v in CATEGORY_ALIASES.items():
        out = F.when(category == k, v).otherwise(out)
    return out


def score(tokens: list[str], title: Column, url: Column) -> Column:
    """Three for each token in the title, one for each in the address."""
    out = F.lit(0).cast("long")
    for t in tokens:
        part = F.lit(t.lower())
        out = out + F.when(F.contains(F.lower(title), part), 3).otherwise(0) + F.when(F.contains(F.lower(url), part), 1).otherwise(0)
    return out


def ranked(df: DataFrame, tokens: list[str], title: str, url: str, order: str) -> DataFrame:
    """By score, then the original order; rows that score nothing stay."""
    return df.withColumn("score", score(tokens, F.col(title), F.col(url))).orderBy(F.desc("score"), order)


def by_bucket(df: DataFrame, start: str, end: str, name: str, today: str, limit: int) -> DataFrame:
    """The first `limit` rows: upcoming by start, then undated, then past by end from the latest on."""
    b = F.when(F.col(start).isNull(), 1).when(F.coalesce(F.col(end), F.col(start)) < today, 2).otherwise(0)
    rows = df.withColumn("bucket", b)
    keys = [F.col("bucket"), F.when(F.col("bucket") == 2, F.col(end)).desc(), F.col(start).asc_nulls_last(), F.col(name)]
    top = rows.orderBy(*keys).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*keys)))


def flat(events: DataFrame) -> DataFrame:
    """Categories joined by commas, and the first source's address, else the home page."""
    return events.withColumn("category", F.array_join("categories", ",")).withColumn("source_url", F.coalesce(F.get("sources", F.lit(0))["url"], F.col("homepage_url")))
