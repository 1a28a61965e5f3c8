"""One canonical row per content key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import hashing


def elect(df: DataFrame, id_col: str = "event_id", key_col: str = "content_key", rank: Column | None = None, keyless: Column | None = None) -> DataFrame:
    """Sets `superseded`: false for the row of the highest authority, then the least id, of each key; true for its others.

    A row without a key keeps what `keyless` says (false by default). The winner of a key is an aggregate with map-side
    combining, joined back; rows without a key take no part, so neither they nor a common key gather in one task.
    """
    rank = hashing.authority(hashing.source_of(F.col(id_col))) if rank is None else rank
    ranked = df.withColumn("_rank", rank)
    has = F.col(key_col).isNotNull() & (F.col(key_col) != "")
    best = ranked.where(has).groupBy(F.col(key_col).alias("_key")).agg(F.min(F.struct(-F.col("_rank"), F.col(id_col).alias("id")))["id"].alias("_winner"))
    out = ranked.join(best, has & (F.col(key_col) == F.col("_key")), "left")
    return out.withColumn("superseded", F.when(has, F.col(id_col) != F.col("_winner")).otherwise(keyless if keyless is not None else F.lit(False))).drop("_rank", "_key", "_winner")


def reelect(stored: DataFrame, changes: DataFrame, rank: Column | None = None) -> DataFrame:
    """(event_id, content_key, superseded, was, come) of all rows after a batch, the clusters that it touches elected anew; was: the
    flag stored under this key, null for a row that is new to it; come: whether the batch names the row.

    stored: (event_id, content_key, superseded) of keyed rows, at least those of the touched keys; changes: (event_id,
    old_key, new_key), one row for an id; blank keys are none. The old and the new key of every changed row are touched:
    one has lost a row, the other has won one. Rows of other keys keep their flags. An id that is stored without its
    `old_key` being named stays in its old cluster, so the batch has to name it.

    Rows meet by key and id, so a common key is spread; its winner is an aggregate that is joined back, as in `elect`.
    """
    named = changes.select("event_id", F.explode(F.array(F.struct(F.col("old_key").alias("content_key"), F.lit(False).alias("come")), F.struct(F.col("new_key").alias("content_key"), F.lit(True).alias("come")))).alias("_n"))
    named = named.select("event_id", "_n.content_key", F.lit(None).cast("boolean").alias("was"), "_n.come").where("content_key <> ''")
    rows = stored.select("event_id", "content_key", F.col("superseded").alias("was"), F.lit(None).cast("boolean").alias("come")).unionByName(named)
    met = rows.groupBy("content_key", "event_id").agg(F.max("was").alias("was"), F.max("come").alias("come"))
    rank = hashing.authority(hashing.source_of(F.col("event_id"))) if rank is None else rank
    here = F.coalesce("come", F.lit(True))
    best = met.groupBy("content_key").agg(F.min(F.when(here, F.struct(-rank, F.col("event_id").alias("id"))))["id"].alias("_winner"), F.count("come").alias("_named")).where("_named > 0").drop("_named")
    out = met.where(here).join(best, "content_key", "left")
    return out.select("event_id", "content_key", F.coalesce(F.col("event_id") != F.col("_winner"), "was").alias("superseded"), "was", F.coalesce("come", F.lit(False)).alias("come"))
