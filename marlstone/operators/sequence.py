"""Order-aware operators: first seen, caps, runs, quotas."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. An aggregate, so a very common key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    got = df.groupBy(*keys).agg(pick)
    return got.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def numbered(df: DataFrame, key: str, order: list[str], into: str) -> DataFrame:
    """Adds `into`, the place from 1 of each row among the rows of its key. Rows are dealt by ranges of key and order and ranked
    inside them, so that no task holds more than a range of a very common key."""
    dealt = cut(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    held = dealt.groupBy(F.col("_range").alias("_r"), F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order))
    both = dealt.withColumn(into, nth).join(before, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")))
    return both.withColumn(into, (F.col(into) + F.col("_before")).cast("long")).drop("_range", "_r", "_k", "_before")


def keep_last(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The last n rows of each source."""
    w = Window.partitionBy(source).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def capped(df: DataFrame, source: str, order: list[str], per_source: int, total: int) -> DataFrame:
    """At most `per_source` rows of each source and `total` in all, in order; a row beyond its source's cap takes no place."""
    w = Window.partitionBy(source).orderBy(*order)
    some = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_source).drop("_n")
    return some.orderBy(*order).limit(total)


def before_run(df: DataFrame, by: str, order: list[str], dated: Column, past: Column, run: int) -> DataFrame:
    """Rows before the `run`th of consecutive past rows, per group; undated rows neither count nor break a run."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_island", F.sum(F.when(dated & ~past, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_run", F.sum(F.when(dated & past, 1).otherwise(0)).over(inside))
    stop = F.max(F.when(F.col("_run") >= run, 1).otherwise(0)).over(w)
    return d.withColumn("_stop", stop).where("_stop = 0").drop("_island", "_run", "_stop")


def folded(df: DataFrame, client: str, at: Column, keep: tuple[str, ...], judge: Callable[[], Callable[..., bool | None]], facts: tuple[str, ...] = (), into: str = "allowed") -> DataFrame:
    """(client, kept columns, `into`): the requests of each client in order of time, then of the kept columns, each put with
    its time and `facts` to the client's own judge, which `judge` makes anew.

    A task reads its clients one after the other in sorted batches and holds one client's state, never its history; so the
    work is linear in the requests, and one client's requests, which follow from one another, are read by one task.
    """
    rows = df.select(F.col(client), *keep, *[F.col(c).alias(f"_f{i}") for i, c in enumerate(facts)], at.cast("double").alias("_t"))
    kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (client, *keep)), f"`{into}` boolean"])
    n = 1 + len(keep)

    def run(batches):
        ask, whose = None, object()
        for b in batches:
            clients, times = b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            more = zip(*[b.column(i).to_pylist() for i in range(n, n + len(facts))], strict=True) if facts else [()] * len(times)
            allowed = []
            for c, t, f in zip(clients, times, more, strict=True):
                if ask is None or c != whose:
                    ask, whose = judge(), c
                allowed.append(ask(t, *f))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(allowed, pa.bool_())], names=[client, *keep, into])

    return rows.repartition(client).sortWithinPartitions(client, "_t", *keep).mapInArrow(run, kinds)


def _anchored(*windows: tuple[int, float]) -> Callable[[], Callable[[float], bool]]:
    """Windows of (limit, seconds), each opened by a request and reopened by the first one after it has passed. A request
    counts if all allow it."""

    def judge():
        opened, count = [None] * len(windows), [0] * len(windows)

        def ask(t: float) -> bool:
            for i, (_, seconds) in enumerate(windows):
                if opened[i] is None or t - opened[i] >= seconds:
                    opened[i], count[i] = t, 0
            ok = all(n < limit for n, (limit, _) in zip(count, windows, strict=True))
            for i in range(len(windows)):
                count[i] += ok
            return ok

        return ask

    return judge


def fixed_window_quota(df: DataFrame, client: str, at: Column, limit: int, seconds: int, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Requests with `allowed`, under a window that opens at a client's first request and reopens when it has passed."""
    return folded(df, client, at, keep, _anchored((limit, seconds)))


def two_window_quota(df: DataFrame, client: str, at: Column, short: tuple[int, int], long: tuple[int, int], keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """As above with two windows of (limit, seconds); a request counts in both, and only if both allow it."""
    return folded(df, client, at, keep, _anchored(short, long))


def token_bucket(df: DataFrame, client: str, at: Column, rate: float, burst: float, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Requests with `allowed`, under a bucket of `burst` tokens refilled continuously at `rate` a second."""

    def judge():
        last, left = None, float(burst)

        def ask(t: float) -> bool:
            nonlocal last, left
            have = float(burst) if last is None else min(float(burst), left + (t - last) * rate)
            ok = have >= 1.0
            last, left = t, have - ok
            return ok

        return ask

    return folded(df, client, at, keep, judge)


def within_budget(df: DataFrame, client: str, order: list[str], cost: Column, limit: int) -> DataFrame:
    """Rows whose running cost, per client and in order, stays within the limit."""
    w = Window.partitionBy(client).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(cost).over(w)).where(F.col("_used") <= limit).drop("_used")
