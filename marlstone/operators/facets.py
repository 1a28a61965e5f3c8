"""Facet counts over array members, with the zeros of a fixed vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, array_col: str, name: str = "category") -> DataFrame:
    """Rows per member; a member twice in one array counts twice, an empty array counts nowhere."""
    return df.select(F.explode(array_col).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(spark, members: tuple[str, ...], name: str = "category") -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(m) for m in members])).alias("ord", name))


def zero_filled(df: DataFrame, array_col: str, members: tuple[str, ...], name: str = "category") -> DataFrame:
    """(ord, member, n) for each member of the vocabulary, in its order."""
    base = vocabulary(df.sparkSession, members, name).withColumn("ord", F.col("ord").cast("long"))
    return base.join(counts(df, array_col, name), name, "left").select("ord", name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
