"""Change-detecting merge of a batch into a snapshot, as one plan: state, field differences, new rows, change log.

Rows are matched by one full outer join on the key; everything else is column expressions on its result. Rows that are
absent from the batch pass through untouched. The snapshot carries `content_hash`; differences are unpivoted only for
rows whose hash changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import hashing


def latest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last occurrence of each key in the batch."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hashed(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumn("content_hash", hashing.content_hash({f: F.col(f) for f in fields}))


def joined(prev: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """(key, prev, inc): both sides as structs, null where a side has no row. Each side has `content_hash`."""
    p = prev.select(F.col(key), F.struct("*").alias("prev"))
    i = batch.select(F.col(key), F.struct("*").alias("inc"))
    return p.join(i, key, "full_outer").withColumn("state", state())


def state() -> Column:
    return F.when(F.col("inc").isNull(), F.col("prev.update_state")).when(F.col("prev").isNull(), "new").when(F.col("inc.content_hash") == F.col("prev.content_hash"), "unchanged").otherwise("updated")


def snapshot(both: DataFrame, key: str, fields: list[str], checked: Column, now: Column) -> DataFrame:
    """The table after the merge: fields, content_hash, created_at, updated_at, last_checked_at, update_state.

    An unchanged row is only marked as checked; an updated one takes the batch's fields and a new time, and keeps the
    time of its creation.
    """
    fresh = F.col("inc").isNotNull() & (F.col("state") != "unchanged")
    cols = [F.when(fresh, F.col(f"inc.{f}")).otherwise(F.col(f"prev.{f}")).alias(f) for f in [*fields, "content_hash"]]
    return both.select(
        key,
        *cols,
        F.coalesce("prev.created_at", now).alias("created_at"),
        F.when(fresh, now).otherwise(F.col("prev.updated_at")).alias("updated_at"),
        F.when(F.col("inc").isNotNull(), F.coalesce(F.nullif(checked, F.lit("")), F.col("prev.last_checked_at"))).otherwise(F.col("prev.last_checked_at")).alias("last_checked_at"),
        F.col("state").alias("update_state"),
    )


def differences(both: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_path, old_value, new_value) for each differing canonical field of updated rows."""
    changed = both.where("state = 'updated'")

    def text(side: str, f: str) -> Column:
        return hashing.ws(F.col(f"{side}.{f}").cast("string"))

    pairs = F.array(*[F.struct(F.lit(f).alias("field_path"), text("prev", f).alias("old_value"), text("inc", f).alias("new_value")) for f in sorted(fields)])
    return changed.select(key, F.explode(F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))).alias("d")).select(key, "d.*")


def change_log(diff: DataFrame, key: str, changed_at: Column, last_id: int) -> DataFrame:
    """Log rows with ids that go on from `last_id`, by key, then field.

    Ids are dense and global. Keys are cut into ranges; each range is numbered by itself and shifted by what stands
    before it, so no task sees all rows.
    """
    groups = diff.select(F.pmod(F.xxhash64(key), F.lit(64)).alias("_g"), "*")
    counts = groups.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_g", "_b")
    inner = Window.partitionBy("_g").orderBy(key, "field_path")
    return groups.withColumn("_r", F.row_number().over(inner)).join(before, "_g").select((F.lit(last_id) + F.col("_b") + F.col("_r")).alias("id"), key, "field_path", "old_value", "new_value", changed_at.alias("changed_at"))


def coalesced(base: str, extra: str, fields: list[str]) -> list[Column]:
    """Field by field the base's value, or the extra one's where it has none."""
    return [F.coalesce(F.col(f"{base}.{f}"), F.col(f"{extra}.{f}")).alias(f) for f in fields]
