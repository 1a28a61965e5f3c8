"""Fetches served from memory, precedence of origins, free names and observed counts, each against plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from marlstone.operators import caching, enrich, naming, sequence
from marlstone.streaming import ingest

REQUESTS = "host string, t double, n long, took double, ok boolean, started string"


def loop(rows, ttl):
    """(started, waits, got) of each request, one after the other."""
    held, out = {}, {}
    for h, t, n, took, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        s = held.get(h)
        if s is None or (t >= s[2] and t > s[0]):
            end = t + (took or 0)
            s = held[h] = (t, end, end + (ttl if ok else 0), bool(ok))
        out[n] = (s[0], max(s[1] - t, 0.0), s[3])
    return out


def test_fetches_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), float(rng.randrange(4000)), n, rng.choice([0.0, 0.0, 3.0, 40.0, None]), rng.choice([True, True, False, None])) for n in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], REQUESTS)
    for ttl in (100.0, 7.0):
        held = caching.fetches(df, "host", "t", "n", "took", "ok", ttl)
        got = {r.n: (r[6], r.waits, r.got) for r in caching.served(df.drop("started").withColumn("started_", F.lit("x")).select("host", "t", "n", "took", "ok", "started_"), held, "host", "t", ttl).select("host", "t", "n", "took", "ok", "started_", "started", "waits", "got").collect()}
        assert got == loop(rows, ttl)
        starts = {(r.host, r.started) for r in held.collect()}
        assert len(starts) == held.count() == len({(r[0], got[r[2]][0]) for r in rows})
    plan = caching.served(df.drop("started"), held, "host", "t")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fetches_of_many_batches_and_of_none(spark):
    many = spark.range(200_000).select(F.lit("h").alias("host"), (F.col("id") / 2).alias("t"), F.col("id").alias("n"), F.lit(10.0).alias("took"), (F.col("id") % 2 == 0).alias("ok"))
    held = caching.fetches(many, "host", "t", "n", "took", "ok", 90.0)
    assert held.count() == 1000 and held.agg(F.min("started"), F.max("started")).first()[:] == (0.0, 99900.0)
    none = many.limit(0)
    assert caching.fetches(none, "host", "t", "n", "took", "ok").count() == 0
    lone = caching.served(many.limit(3), held.limit(0), "host", "t").collect()
    assert [r.started for r in lone] == [None] * 3


def test_precedence_is_independent_of_order(spark):
    rows = [("e", 2, "model", "u1", "M", 7), ("e", 0, "parsed", "u2", " ", None), ("e", 1, "page", "u3", "P", None), ("e", 1, "page", "u0", "Q", None), ("f", 3, "x", "u", None, None)]
    schema = "k string, rank int, origin string, url string, name string, n int"
    want = None
    for order in itertools.permutations(rows):
        if want is not None and random.Random(str(order)).random() > 0.15:
            continue
        got = sorted(enrich.merged(spark.createDataFrame([*order, order[0]], schema), "k", F.col("rank"), "origin", "url", ["name", "n"]).collect())
        want = want or got
        assert got == want
    e, f = want
    assert (e.name, e.n) == ("Q", 7) and [tuple(p) for p in e.provenance] == [("name", "page", "u0"), ("n", "model", "u1")] and [tuple(s) for s in e.sources] == [("page", "u0"), ("model", "u1")]
    assert f.name is None and f.provenance == [] and f.sources == []


def test_free_names_equal_a_greedy_loop(spark):
    rng = random.Random(6)
    stems = ["hot"] * 5 + ["a", "b", "c-x", ""]
    taken = {rng.choice(stems) + rng.choice(["", f"-{rng.randrange(2, 60)}", "-02", "-1", "-x"]) for _ in range(120)}
    new = [(i, rng.choice(stems) or None, "z") for i in range(400)]
    used, want = set(taken), {}
    for i, s, _ in new:
        s, k = s or "", 1
        while (s if k == 1 else f"{s}-{k}") in used:
            k += 1
        want[i] = s if k == 1 else f"{s}-{k}"
        used.add(want[i])
    df, t = spark.createDataFrame(new, "i long, stem string, name string"), spark.createDataFrame([(x,) for x in taken] + [(None,)], "n string")
    for stretch in (7, 1 << 14):
        got = {r.i: r.id for r in naming.free_names(df, t, "stem", ["i"], "id", stretch).collect()}
        assert got == want
    assert naming.free_names(df.limit(0), t, "stem", ["i"], "id").count() == 0
    none = naming.free_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a-2")], "i long, stem string"), t.limit(0), "stem", ["i"], "id")
    assert {r.i: r.id for r in none.collect()} == {1: "a", 2: "a-3", 3: "a-2", 4: "a-2-2"}


def test_numbered(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "x", None]), i) for i in range(500)]
    got = sequence.numbered(spark.createDataFrame(rows, "k string, i long").repartition(4), "k", ["i"], "n").collect()
    seen = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        rows[i] = (k, i, seen[k])
    assert sorted(map(tuple, got), key=lambda r: r[1]) == rows


def test_counts_come_with_the_write(spark, tmp_path):
    rows = [(1, 1, True), (1, 0, True), (2, 5, False), (2, 6, None), (3, 7, True), (None, 8, True), (None, 9, True)]
    df, stored = spark.createDataFrame(rows, "k int, n int, good boolean"), spark.createDataFrame([(3,), (4,)], "k int")
    df.write.parquet(str(tmp_path / "in"))
    source, out = spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out")
    got = ingest.add_missing(stored, source, ["k"], ["n"], F.col("good"), out)
    assert got == {"raw": 7, "dropped": 2, "repeated": 3, "added": 2}
    assert sorted((r.k or 0, r.n) for r in spark.read.parquet(out).collect()) == [(0, 8), (1, 0)]
    assert ingest.add_missing(None, source, ["k"], ["n"], F.col("good"), out) == {"raw": 7, "dropped": 2, "repeated": 2, "added": 3}
    assert ingest.add_missing(stored, source.limit(0), ["k"], ["n"], F.col("good"), out)["added"] == 0
