"""What is fetched once and served from memory for a while: which request is served by which fetch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.sequence import first_seen

#: Fixed value: seconds for which a host's robots file is good.
ROBOTS_TTL = 24 * 3600


def fetches(requests: DataFrame, host: str, at: str, order: str, took: str, ok: str, ttl: float = ROBOTS_TTL) -> DataFrame:
    """(host, started, ended, until, ok) of the fetches that requests give rise to; times in seconds.

    A request for which nothing is held starts a fetch, which takes the request's `took` seconds and goes as its `ok`
    says. Until it ends all requests of the host wait for it, whatever it brings. What a good fetch has brought is held for
    `ttl` seconds from its end; a bad one leaves nothing. So the next fetch starts with the first request at `until` or later.

    Requests of one second are one before the shuffle. A host's moments follow from one another and are read by one task
    in sorted batches, which leaps from fetch to fetch and holds one number between batches. Null hosts are one host; rows
    without a time are passed over; null `took` is 0, null `ok` is bad; of several at one time the first in `order` starts it.
    """
    rows = requests.where(F.col(at).isNotNull()).select(F.col(host).alias("_h"), F.col(at).cast("double").alias("_t"), F.col(order).alias("_o"), F.greatest(F.coalesce(F.col(took).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_d"), F.coalesce(F.col(ok), F.lit(False)).alias("_k"))
    moments = first_seen(rows, ["_h", "_t"], ["_o", "_d", "_k"]).select("_h", "_t", "_d", "_k")
    kind = requests.schema[host].dataType.simpleString()

    def run(batches):
        whose, until = object(), -np.inf
        for b in batches:
            hosts, t, d, k = b.column(0).to_pylist(), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            out: list[tuple] = []
            lo = 0
            while lo < len(hosts):
                h = hosts[lo]
                hi = lo + 1
                step = 1
                while hi < len(hosts) and hosts[min(hi + step, len(hosts)) - 1] == h:
                    hi, step = min(hi + step, len(hosts)), step * 2
                while hi < len(hosts) and hosts[hi] == h:
                    hi += 1
                if h != whose:
                    whose, until = h, -np.inf
                i = lo + int(np.searchsorted(t[lo:hi], until))
                while i < hi:
                    end = t[i] + d[i]
                    # A fetch that takes no time and brings nothing still serves its own moment.
                    until = end + ttl if k[i] else max(end, np.nextafter(t[i], np.inf))
                    out.append((h, t[i], end, until, bool(k[i])))
                    i += max(1, int(np.searchsorted(t[i:hi], until)))
                lo = hi
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.float64()) for c in cols[1:4]), pa.array(cols[4], pa.bool_())], names=["host", "started", "ended", "until", "ok"])

    return moments.repartition("_h").sortWithinPartitions("_h", "_t").mapInArrow(run, f"host {kind}, started double, ended double, until double, ok boolean")


def served(requests: DataFrame, held: DataFrame, host: str, at: str, width: float = ROBOTS_TTL) -> DataFrame:
    """The rows of `requests` with `started` of the fetch that serves each, `waits`, the seconds until it has ended, and `got`,
    whether it brought anything; null where none does.

    held: (host, started, ended, until, ok), intervals of a host that don't overlap. Intervals are filed under the stretches of
    `width` seconds that they touch (three, if they are no longer than twice that), and requests meet those of their own
    host and stretch only: a very common host is spread over its stretches.
    """
    stretch = lambda c: F.floor(c / F.lit(float(width)))
    filed = held.select(F.col("host").alias("_h"), "started", F.col("ended").alias("_e"), F.col("until").alias("_u"), F.col("ok").alias("got"), F.explode(F.sequence(stretch(F.col("started")), stretch(F.col("until")))).alias("_b"))
    t = F.col(at).cast("double")
    both = requests.withColumn("_s", stretch(t)).join(filed, F.col(host).eqNullSafe(F.col("_h")) & (F.col("_s") == F.col("_b")) & (t >= F.col("started")) & (t < F.col("_u")), "left")
    return both.withColumn("waits", F.greatest(F.col("_e") - t, F.lit(0.0))).drop("_s", "_h", "_b", "_e", "_u")
