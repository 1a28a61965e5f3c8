"""Keyset pages: filter, order by a unique key, read one row beyond the page to learn whether more follow."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 20
MAX_LIMIT = 100


def clamp_limit(raw: Any) -> int:
    """A page size: anything unreadable or below 1 is the default, anything above the maximum is the maximum."""
    try:
        n = int(raw)
    except (TypeError, ValueError):
        return DEFAULT_LIMIT
    return DEFAULT_LIMIT if n <= 0 else min(n, MAX_LIMIT)


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def after(keys: list[str], values: list[Any]) -> Column:
    """Rows whose key tuple is greater than `values`, as nested comparisons so that the scan can use them."""
    out = F.lit(False)
    for i, (k, v) in enumerate(zip(keys, values, strict=True)):
        same = conjunction([F.col(a) == F.lit(b) for a, b in zip(keys[:i], values[:i], strict=True)])
        out = out | (same & (F.col(k) > F.lit(v)))
    return out


@dataclass
class PageSpec:
    """keys: the total order. after: the last row's keys, None at the start."""

    keys: list[str]
    limit: int = DEFAULT_LIMIT
    after: list[Any] | None = None
    where: list[Column] = field(default_factory=list)


def page(df: DataFrame, spec: PageSpec) -> DataFrame:
    """At most limit + 1 rows in key order (TakeOrderedAndProject); the extra row only says that more follow."""
    preds = list(spec.where)
    if spec.after is not None:
        preds.append(after(spec.keys, spec.after))
    return df.where(conjunction(preds)).orderBy(*spec.keys).limit(spec.limit + 1)


def trimmed(probed: DataFrame, spec: PageSpec) -> DataFrame:
    """The page's rows with has_more on each; works on at most limit + 1 rows."""
    from pyspark.sql import Window

    w = Window.orderBy(*spec.keys)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return (
        probed.withColumn("page_pos", F.row_number().over(w))
        .withColumn("has_more", n > spec.limit)
        .where(F.col("page_pos") <= spec.limit)
    )


def encode_cursor(at: Column, key: Column) -> Column:
    """Opaque URL-safe token of a position."""
    raw = F.base64(F.concat(at, F.lit("\n"), key).cast("binary"))
    return F.regexp_replace(F.translate(raw, "+/", "-_"), "[=\r\n]", "")


def decode_cursor(token: Column) -> Column:
    """struct<at, id>; null for the start and for a malformed token."""
    raw = F.translate(token, "-_", "+/")
    text = F.try_to_binary(F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string")
    ok = (F.coalesce(token, F.lit("")) != "") & F.contains(text, F.lit("\n"))
    return F.when(ok, F.struct(F.substring_index(text, "\n", 1).alias("at"), F.substring_index(text, "\n", -1).alias("id")))


def envelope(paged: DataFrame, cols: list[str], spec: PageSpec) -> DataFrame:
    """One JSON body for a trimmed page; a page is bounded by its limit."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("page_pos", *cols))), lambda r: F.struct(*[r[c].alias(c) for c in cols]))
    one = paged.agg(rows.alias("data"), F.coalesce(F.bool_or("has_more"), F.lit(False)).alias("has_more"))
    return one.select(F.to_json(F.struct("data", F.struct("has_more", F.lit(spec.limit).alias("limit")).alias("page"))).alias("body"))
