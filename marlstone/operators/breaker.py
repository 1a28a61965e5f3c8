"""Per-source counts of a batch and the decision whether to apply it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(rows: DataFrame, source: str, raw: Column, parsed: Column, stored: Column) -> DataFrame:
    """(source, discovered, parsed, stored, skipped) from one flag per row and step."""
    return rows.groupBy(source).agg(F.count_if(raw).alias("discovered"), F.count_if(parsed).alias("parsed"), F.count_if(stored).alias("stored"), F.count_if(parsed & ~stored).alias("skipped"))


def changed_fraction(batch: DataFrame, stored: DataFrame, key: str, source: str) -> DataFrame:
    """(source, changed, total, known): rows of the batch whose hash differs from the stored one's, null-safe."""
    s = stored.select(F.col(key).alias("_key"), F.col("content_hash").alias("_hash"))
    both = batch.join(s, batch[key] == s["_key"], "left")
    known = F.col("_key").isNotNull()
    return both.groupBy(source).agg(F.count_if(known & ~F.col("content_hash").eqNullSafe(F.col("_hash"))).alias("changed"), F.count(F.lit(1)).alias("total"), F.count_if(known).alias("known"))


def decision(discovered: Column, last_discovered: Column, changed: Column, known: Column, floor: int = 1, drop_to: float = 0.5, most_changed: float = 0.0) -> Column:
    """Why a source's batch is not applied, by the first rule that holds; null if it is."""
    return (
        F.when(discovered == 0, "zero_refs")
        .when(discovered < floor, "below_floor")
        .when((last_discovered > 0) & (discovered < drop_to * last_discovered), "discovery_drop")
        .when(F.lit(most_changed > 0) & (known > 0) & (changed > most_changed * known), "change_spike")
    )
