"""Pages as Markdown: tables whose keys stand once in the header, details as a list of fields, addresses of next pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |\n"))


def _head(names: list[str]) -> str:
    return f"| {' | '.join(names)} |\n| {' | '.join(['---'] * len(names))} |\n"


def markdown_page(paged: DataFrame, cols: dict[str, Column], order: str, facets: DataFrame | None = None) -> DataFrame:
    """(body) of one page: a table of `cols` (escaped cells by name), rows by `order`. A page is bounded by its limit.

    facets: (ord, name, n) of the collection, a line above the table where there are any. No rows: the header alone."""
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), _line(list(cols.values())).alias("line")))), lambda r: r["line"]), "")
    one = paged.agg(F.concat(F.lit(_head(list(cols))), rows).alias("body"))
    if facets is None:
        return one
    said = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "n"))), lambda f: F.concat_ws(" ", f["name"], f["n"].cast("string")))
    line = facets.agg(F.array_join(said, ", ").alias("said")).select(F.when(F.col("said") != "", F.concat(F.lit("category_counts: "), "said", F.lit("\n\n"))).otherwise("").alias("_above"))
    both = one.withColumn("_one", F.lit(1)).join(line.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.concat("_above", "body").alias("body"))


def markdown_detail(cols: dict[str, Column]) -> Column:
    """One record's fields, a line each."""
    return F.concat(F.lit(_head(["field", "value"])), *[_line([F.lit(n), c]) for n, c in cols.items()])


def next_page(path: Column, query: dict[str, Column], cursor: Column) -> Column:
    """The address of the page behind a cursor: parameters by name, encoded as in a form; null without a cursor."""
    params = {**query, "cursor": cursor}
    part = lambda n: F.when(params[n].isNotNull(), F.concat(F.lit(f"{n}="), F.url_encode(params[n])))
    return F.when(cursor != "", F.concat(path, F.lit("?"), F.concat_ws("&", *[part(n) for n in sorted(params)])))
