"""Names for newcomers that no one has yet, without a loop: the nth newcomer to a stem takes its nth free number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.sequence import numbered

#: Places of a stem that are looked up together.
STRETCH = 1 << 14
_NUMBER = r"-([1-9][0-9]{0,17})$"


def free_names(newcomers: DataFrame, taken: DataFrame, stem: str, order: list[str], name: str, stretch: int = STRETCH) -> DataFrame:
    """The rows of `newcomers` with `name`: the stem itself if it is free, else the stem with the least number from 2 on that is.

    In `order`, each newcomer counts as taken for the ones behind it. taken: names, one column. Only numbers written
    without leading zeros count as such. A newcomer's stem that itself ends in such a number is kept for it: others of the stem before
    that number pass it over even if they come first, so that names are unique whatever the order.

    Taken numbers are cut into runs; the free numbers between them are ranges, of which each knows how many free ones stand before
    it; a newcomer's place falls into one range. Places and ranges meet by stretches of `stretch` places, in which a
    running maximum finds the range, so neither a stem with many taken numbers nor one with many newcomers is one group. Null
    and empty stems are stems like any other; null order values come first.
    """
    own = newcomers.select(F.coalesce(F.col(stem), F.lit("")).alias("n")).distinct()
    names = taken.select(F.col(taken.columns[0]).alias("n")).where("n IS NOT NULL").distinct()
    ends = F.regexp_extract("n", _NUMBER, 1)
    split = lambda df: df.where(ends != "").select(F.regexp_replace("n", _NUMBER, "").alias("s"), ends.cast("long").alias("k")).where("k >= 2")
    used = names.select(F.col("n").alias("s"), F.lit(1).cast("long").alias("k")).unionByName(split(names)).unionByName(split(own)).distinct().join(own.withColumnRenamed("n", "s"), "s", "left_semi")
    # Of the free numbers, `free` stand before the ith taken one k: k - i. The run of free ones behind it starts at k + 1.
    ranges = numbered(used, "s", ["k"], "i").select("s", (F.col("k") - F.col("i")).alias("free"), "k")
    ranges = ranges.groupBy("s", "free").agg(F.max("k").alias("k"))  # of adjoining numbers the last
    new = numbered(newcomers.withColumn("_s", F.coalesce(F.col(stem), F.lit(""))), "_s", order, "_place")
    last = new.groupBy(F.col("_s").alias("s")).agg(F.max("_place").alias("most"))
    # A range counts from place free + 1 on; each stretch also needs the last range that starts before it.
    at = ranges.join(last, "s").where(F.col("free") < F.col("most")).withColumn("b", F.floor(F.col("free") / stretch)).select("s", "b", (F.col("free") + 1).alias("p"), (F.col("k") - F.col("free")).alias("add"))
    firsts = new.groupBy(F.col("_s").alias("s"), F.floor((F.col("_place") - 1) / stretch).alias("b")).agg(F.lit(0).cast("long").alias("p"))
    tops = at.groupBy("s", "b").agg(F.max("add").alias("top"))
    carry = firsts.join(tops, ["s", "b"], "full").withColumn("add", F.max("top").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    carry = carry.where("p IS NOT NULL AND add IS NOT NULL").select("s", "b", "p", "add")
    held = at.unionByName(carry).select(F.col("s").alias("_s"), F.col("b").alias("_b"), F.col("p").alias("_place"), F.col("add").alias("_add"))
    rows = new.withColumn("_b", F.floor((F.col("_place") - 1) / stretch)).unionByName(held, allowMissingColumns=True)
    up_to = Window.partitionBy("_s", "_b").orderBy("_place").rangeBetween(Window.unboundedPreceding, 0)
    number = F.col("_place") + F.coalesce(F.max("_add").over(up_to), F.lit(0))
    out = rows.withColumn("_new", F.col("_add").isNull()).withColumn("_number", number).where("_new")
    return out.withColumn(name, F.when(F.col("_number") == 1, F.col("_s")).otherwise(F.concat_ws("-", "_s", F.col("_number").cast("string")))).drop("_s", "_b", "_place", "_add", "_new", "_number")
