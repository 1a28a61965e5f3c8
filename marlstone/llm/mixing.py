"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets: the sources, by code point, null last, share `share` times all words by weight; none gets more than `most`
times its own words, and what it can't take goes to the others. The mix is a row of slots of about `block` words. Slot i
draws the point i * g mod 2**31, g the golden ratio's multiple: such points fill every interval evenly at every length
of the schedule. A source owns an interval as wide as its share; the rank of a slot among its source's slots numbers the
block it plays. A source's documents stand in hashed order on one line, passed through again when it ends, and the
line's first `target` words are cut into as many equal blocks as the source has slots.

Words, slots and documents of a source are ranked in many groups, so a hot source is never one task; the table of
sources and one total are all that is gathered. A source that no point meets gets one slot after the others.

Null and empty texts have no words and are never taken. Repeated rows are taken each by itself. Null ids and sources are
values like others. Other columns are not read. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import absent, cut, documents, spread_rank, word_count

#: round(2**31 / golden ratio), odd, so a period has each multiple of 2**-31 once.
GOLDEN = 1_327_217_885
PERIOD = 1 << 31
CELLS = 4096
GROUPS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Its windows run over the table of sources, which has a row per source, never per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("goal", share * F.sum("source_size").over(every))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    t = t.withColumn("full", F.col("cap") / F.col("w") < level)
    left = F.col("goal") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("w") * left / free)))
    return t.select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def schedule(goals: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, source, nth): the slots in order and their rank in their source, from (source, goal) with goals above 0."""
    n = -(-total // block)
    reach = F.sum("goal").over(Window.orderBy(F.col("source").asc_nulls_last())) / F.lit(float(total)) * PERIOD
    width = F.col("goal") / F.lit(float(total)) * PERIOD
    owned = goals.select("source", F.floor(reach - width + 0.5).alias("lo"), F.floor(reach + 0.5).alias("hi")).where("hi > lo")
    cells = owned.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / (PERIOD // CELLS)), F.floor((F.col("hi") - 1) / (PERIOD // CELLS)))))
    spark = goals.sparkSession
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * F.lit(GOLDEN), F.lit(PERIOD)).alias("p"))
    slots = slots.withColumn("cell", F.floor(F.col("p") / (PERIOD // CELLS)))
    met = slots.join(cells, (slots.cell == cells.cell) & (slots.p >= cells.lo) & (slots.p < cells.hi)).select("slot", "source")
    ranked = spread_rank(met, ["source"], ["slot"], F.floor(F.col("slot") / max(1, -(-n // GROUPS))), into="nth")
    some = met.select("source").distinct().withColumnRenamed("source", "_had")
    spare = goals.join(some, F.col("source").eqNullSafe(F.col("_had")), "left_anti")
    spare = spare.select((F.lit(n) + F.row_number().over(Window.orderBy("source")) - 1).alias("slot"), "source", F.lit(0).cast("long").alias("nth"))
    return ranked.select("slot", "source", "nth").union(spare)


def _rows(df: DataFrame, id_col: str, source_col: str, size: Column) -> DataFrame:
    """Narrow rows of the table, each with a number of its own; what follows never reads the texts again."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("h", F.xxhash64(F.lit(17), "id", "source", "size")))


def mix(rows: DataFrame, block: int = 1024, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix: what every slot plays. A row for each stretch of a document in a slot, and one for each that has none.

    Columns: uid, id, source, size, source_size, target, copy (0 on the first pass), slot, at (place on the source's
    line), first and last (words of the document, end exclusive); the last five are null where nothing is taken.
    """
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    goals = sources.select("source", F.floor(F.least(F.col("target") + 0.5, most * F.col("source_size"))).alias("goal")).where("goal > 0")
    total = goals.agg(F.sum("goal")).first()[0]
    if not total:
        nothing = [F.lit(None).cast("long").alias(c) for c in ("copy", "slot", "at", "first", "last")]
        same = F.col("source").eqNullSafe(F.col("_source"))
        return rows.join(sources.withColumnRenamed("source", "_source"), same).select("uid", "id", "source", "size", "source_size", "target", *nothing)
    slots = cut(schedule(goals, total, block))
    count = slots.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    a, b, c = (x.withColumnRenamed("source", f"_s{i}") for i, x in enumerate((sources, goals, count)))
    per = a.join(b, F.col("_s0").eqNullSafe(F.col("_s1")), "left").join(c, F.col("_s0").eqNullSafe(F.col("_s2")), "left")
    per = per.select(F.col("_s0").alias("source"), "source_size", "target", F.coalesce("goal", F.lit(0)).alias("goal"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("goal") / F.col("n"))).alias("span"))
    salt = F.shiftrightunsigned("h", 64 - GROUPS.bit_length() + 1)
    lined = spread_rank(rows, ["source"], ["h", "uid"], salt, weight=F.col("size"), into="start", carry=per)
    passes = ", ".join(f"{e}L" for e in range(math.ceil(most)))
    stretches = f"""flatten(transform(array({passes}), e -> CASE WHEN size > 0 AND e * source_size + start < goal THEN
        transform(sequence((e * source_size + start) div span, (least(e * source_size + start + size, goal) - 1) div span), k -> named_struct(
            'copy', e, 'nth', k,
            'at', greatest(e * source_size + start, k * span),
            'first', greatest(e * source_size + start, k * span) - e * source_size - start,
            'last', least(e * source_size + start + size, goal, (k + 1) * span) - e * source_size - start))
        ELSE array() END))"""
    parts = lined.withColumn("part", F.explode_outer(F.expr(stretches))).select("uid", "id", "source", "size", "source_size", "target", "part.*")
    played = slots.select(F.col("slot"), F.col("source").alias("_source"), F.col("nth").alias("_nth"))
    parts = parts.withColumn("_key", F.coalesce("nth", -1 - F.col("uid")))  # rows without a stretch are spread over tasks
    out = parts.join(played, parts["source"].eqNullSafe(played["_source"]) & (parts["_key"] == played["_nth"]), "left")
    return out.select("uid", "id", "source", "size", "source_size", "target", "copy", "slot", "at", "first", "last")


def op8_mixing(spark, sf_dir):
    rows = _rows(documents(spark, sf_dir), "doc_id", "source", word_count("text"))
    taken = F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("taken")
    per = mix(rows).groupBy("uid", F.col("id").alias("doc_id"), "size", "source_size", "target").agg(taken)
    return per.select("doc_id", "size", "source_size", "target", "taken")


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The table's rows, each as often as the mix takes at least half of its words in one pass; whole, with all columns."""
    size = word_count(text_col)
    rows = _rows(df, id_col, source_col, size)
    whole = mix(rows).groupBy("uid", "id", "source", "size", "copy").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    copies = whole.groupBy("uid", "id", "source", "size").agg(F.count_if(2 * F.col("taken") >= F.col("size")).alias("_copies"))
    # Rows that agree in id, source and size are told apart by number only.
    id_, source_, size_, nth, times, words, row, copy = (absent(df, c) for c in ("_id", "_source", "_size", "_nth", "_copies", "_words", "_row", "_copy"))
    mine = Window.partitionBy("id", "source", "size").orderBy(F.desc("_copies"), "uid")
    copies = copies.select(F.col("id").alias(id_), F.col("source").alias(source_), F.col("size").alias(size_), F.row_number().over(mine).alias(nth), F.col("_copies").alias(times)).where(F.col(times) > 0)
    theirs = Window.partitionBy(id_col, source_col, words).orderBy(text_col)
    out = df.withColumn(words, size).withColumn(row, F.row_number().over(theirs))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & F.col(source_col).eqNullSafe(F.col(source_)) & (F.col(words) == F.col(size_)) & (F.col(row) == F.col(nth))
    out = out.join(copies, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return out.select(*[F.col(c) for c in df.columns])
