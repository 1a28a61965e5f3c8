"""Exact top-k search over binary codes by incremental multi-index hashing.

An embedding's code is its signs. Codes are cut into segments of about 0.8 * log2(n) bits, and every distinct code is
filed under each of its segments. In round r the queries still open look up all keys at exactly r bits from their own in every
segment; after it, any code within segments * (r + 1) - 1 bits has been met. A query closes once its kth verified
distance is covered by that, so its answer, ties by id included, is proven. A candidate counts only in the segment and
round in which it is met first, so nothing is met twice, and the last round reaches every code.

Equal codes are one entry with their k least ids, so a very common vector costs no more than a rare one; queries with
equal codes are searched once. Rows without an embedding are neither indexed nor asked; a null or missing element counts
as not positive. Repeated rows each take a place. A query finds itself. Fewer than k rows: all are returned; an empty table or
no queries: none. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut, table

K = 10


def sign_code(embedding: Column, bits: int = 64) -> Column:
    """The signs of the first `bits` (at most 64) elements as a 64-bit integer; bit i is 1 where element i is above 0."""
    one = F.transform(F.slice(embedding, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(one, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def bounds(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments for n codes: n ** 0.8 keys in each, so a key holds n ** 0.2 codes on average and
    neither the keys looked up nor the codes under them outgrow the other."""
    parts = max(1, math.ceil(bits / max(4, min(20, round(0.8 * math.log2(max(n, 2)))))))
    edge = [round(bits * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _part(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, radius: int) -> Column:
    """All numbers of `width` bits with `radius` ones."""
    every = [sum(1 << b for b in c) for c in combinations(range(width), radius)]
    return F.split(F.lit(",".join(map(str, every))), ",").cast("array<long>")


def search(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = 64) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) for each query; rows and queries: (id, code)."""
    nth = Window.partitionBy("code").orderBy("id")
    near = rows.where("code IS NOT NULL").withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= k)
    index = cut(near.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = queries.where("code IS NOT NULL")
    n = index.count()
    parts = bounds(bits, n)
    entry = F.array(*[F.struct(F.lit(s).alias("seg"), _part(F.col("code"), a, w).alias("key")) for s, (a, w) in enumerate(parts)])
    filed = cut(index.select("code", F.size("ids").alias("n_ids"), F.col("ids")[0].alias("first_id"), F.explode(entry).alias("e")).select("code", "n_ids", "first_id", "e.*"))
    still = cut(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(bits)))
    best = None
    done = []
    widest = max(w for _, w in parts)
    for r in range(widest + 1):
        looked = [(s, a, w) for s, (a, w) in enumerate(parts) if r <= w]
        probe = F.array(*[F.struct(F.lit(s).alias("seg"), _part(F.col("q"), a, w).alias("own"), F.lit(w).alias("width")) for s, a, w in looked])
        masks = F.lit(None).cast("array<long>")
        for w in {w for _, _, w in looked}:
            masks = F.when(F.col("width") == w, _masks(w, r)).otherwise(masks)
        probes = still.select("q", "bound", F.explode(probe).alias("p")).select("q", "bound", "p.*").select("q", "bound", "seg", "own", F.explode(masks).alias("m"))
        probes = probes.select("q", "bound", F.col("seg").alias("pseg"), F.col("own").bitwiseXOR(F.col("m")).alias("pkey"))
        x = F.col("q").bitwiseXOR(F.col("code"))
        apart = [F.bit_count(_part(x, a, w)) for a, w in parts]
        first_seg = F.array_position(F.array(*[d == r for d in apart]), F.lit(True)) - 1
        met = probes.join(filed, (F.col("pseg") == F.col("seg")) & (F.col("pkey") == F.col("key")) & (F.least(*apart) == r if len(apart) > 1 else apart[0] == r) & (first_seg == F.col("seg")) & (F.bit_count(x) <= F.col("bound")))
        met = met.select("q", "code", "n_ids", "first_id", F.bit_count(x).cast("long").alias("distance"))
        if best is not None:
            met = met.union(best)
        top = Window.partitionBy("q").orderBy("distance", "first_id", "code")
        best = met.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n")
        cover = sum(min(r, w) + 1 for _, w in parts) - 1
        mine = Window.partitionBy("q")
        sure, held = F.sum(F.when(F.col("distance") <= cover, F.col("n_ids")).otherwise(0)).over(mine), F.sum("n_ids").over(mine)
        best = cut(best.withColumn("_sure", sure).withColumn("_bound", F.when(held >= k, F.max("distance").over(mine)).otherwise(bits)))
        closed = F.lit(r == widest) | (F.col("_sure") >= k)
        done.append(best.where(closed).drop("_sure", "_bound"))
        if r == widest:
            break
        # A query that has met nothing yet stays open too.
        near = best.where(~closed).groupBy("q").agg(F.max("_bound").alias("_b"))
        still = still.join(done[-1].select("q").distinct(), "q", "left_anti").join(near, "q", "left")
        still = cut(still.select("q", F.coalesce("_b", F.lit(bits)).cast("int").alias("bound")))
        if still.isEmpty():
            break
        best = best.where(~closed).drop("_sure", "_bound")
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    hits = found.join(index.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    rank = Window.partitionBy("q").orderBy("distance", "neighbor_id")
    hits = hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(hits, "q").select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "distance")


def op10_topk(spark, sf_dir):
    rows = cut(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")))
    return search(rows, rows.where("id % 50 = 0"))


ORACLE = """
WITH p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id,
         len(list_filter(range(1, 65), lambda i: (q.embedding[i] > 0) <> (d.embedding[i] > 0)))::BIGINT AS distance
  FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance
FROM p QUALIFY rank <= 10
"""
