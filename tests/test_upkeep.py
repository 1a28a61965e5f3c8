"""Stores kept up by batches: against full elections, and with sources that stop midway."""

import random

from pyspark.sql import functions as F

from marlstone.operators.election import elect
from marlstone.streaming import upkeep

CHANGES = "event_id string, old_key string, new_key string"


def test_elections_equal_a_full_one_after_every_batch(spark, tmp_path):
    rng = random.Random(4)
    store, now, flags = upkeep.clusters(spark, str(tmp_path / "s"), 16), {}, {}
    rank = F.when(F.col("event_id") % 2 == 0, 5).otherwise(1)
    for n in range(5):
        ids = rng.sample(range(200), 60) if n < 4 else [1]
        new = {str(i): rng.choice([None, "", "hot", "hot", "hot", f"k{rng.randrange(30)}"]) for i in ids}
        changes = [(i, now.get(i), k) for i, k in new.items()]
        now.update(new)
        for again in range(2 if n == 2 else 1):  # a batch that is run again changes nothing
            got = upkeep.elect_batch(store, spark.createDataFrame(changes, CHANGES), rank, "s", n, 16)
            flips = {r.event_id: r.superseded for r in got.collect()}
            if not again:
                flags.update(flips)
        full = elect(spark.createDataFrame(list(now.items()), "event_id string, content_key string"), rank=rank).collect()
        assert {(r.event_id, r.content_key, r.superseded) for r in full if r.content_key} == {tuple(r) for r in store.read().collect()}
        assert {r.event_id: r.superseded for r in full} == {r.event_id: flags.get(r.event_id, False) for r in full}
    before = store.current()
    read = store.read(["3"]).inputFiles()
    assert all("_slice=s3" in f for f in read)
    upkeep.elect_batch(store, spark.createDataFrame([("1", now["1"], "k1")], CHANGES), rank, "s", 9, 16)
    changed = [s for s, v in store.current().items() if before.get(s) != v]
    assert 1 <= len(changed) <= 2  # only the buckets of the old and the new key were written


def test_empty_batch_and_unknown_ids(spark, tmp_path):
    store = upkeep.clusters(spark, str(tmp_path / "s"))
    assert upkeep.elect_batch(store, spark.createDataFrame([], CHANGES)).count() == 0 and store.read().count() == 0
    out = upkeep.elect_batch(store, spark.createDataFrame([("a", "x", "y"), ("b", None, None)], CHANGES), stream="t")
    assert out.count() == 0 and [tuple(r) for r in store.read().collect()] == [("a", "y", False)]
    out = upkeep.elect_batch(store, spark.createDataFrame([("a", "y", None)], CHANGES), stream="u")
    assert out.count() == 0 and store.read().count() == 0


BATCH, REPORT = "id string, source string, v string, extra int", "source string, discovered long, finished boolean"


def test_a_source_that_stops_midway_keeps_rows_and_counts(spark, tmp_path):
    store = upkeep.sources(spark, str(tmp_path / "s"), "id", "source", {"v": "string"})

    def commit(n, rows, report, **how):
        return upkeep.commit_sources(store, spark.createDataFrame(rows, BATCH), spark.createDataFrame(report, REPORT), "id", "source", ["v"], f"t{n}", "in", n, **how)

    rows = lambda s, n, v: [(f"{s}-{i}", s, v, 0) for i in range(n)]
    first = rows("a", 10, "1") + rows("b", 10, "1") + rows("c", 10, "1")
    assert commit(0, first, [("a", 10, True), ("b", 10, True), ("c", 10, True)]) == {"a": None, "b": None, "c": None}
    # b stops after three of its rows, and c finds too few.
    second = rows("a", 12, "2") + rows("b", 3, "2") + rows("c", 2, "2") + rows("d", 1, "2")
    told = [("a", 12, True), ("b", 10, False), ("c", 2, True), ("e", 0, True)]
    for _ in range(2):  # a batch that is run again gives the same
        assert commit(1, second, told) == {"a": None, "b": "cancelled", "c": "discovery_drop", "e": "zero_refs"}
        got = {s: sorted((r.id, r.v, r.update_state) for r in store.read([s]).collect()) for s in "abcd"}
        assert len(got["a"]) == 12 and {x[1] for x in got["a"]} == {"2"} and [x[2] for x in got["a"]].count("updated") == 10
        assert got["b"] == [(f"b-{i}", "1", "new") for i in range(10)] and len(got["c"]) == 10 and got["d"] == []
    notes = {s: note for s, (_, _, note) in store.current().items()}
    assert notes == {"a": {"discovered": 12, "parsed": 12, "stored": 12}, "b": {"discovered": 10, "parsed": 10, "stored": 10}, "c": {"discovered": 10, "parsed": 10, "stored": 10}}
    # The breaker's next decision on b is that of its last good batch: 4 of 10 is a drop, 6 of 10 is none.
    assert commit(2, rows("b", 4, "3"), [("b", 4, True)]) == {"b": "discovery_drop"}
    assert commit(3, rows("b", 6, "3"), [("b", 6, True)], most_changed=0.5) == {"b": "change_spike"}
    assert commit(4, rows("b", 6, "3"), [("b", 6, True)]) == {"b": None}
    assert store.read(["b"]).where("v = '3'").count() == 6 and store.read(["b"]).count() == 10
    assert commit(5, [], []) == {}


def test_a_stream_touches_its_own_buckets(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "at")
    store = upkeep.keyed(spark, str(tmp_path / "s"), "id", {"id": "long", "v": "string"}, 8)

    def drain(rows):
        spark.createDataFrame(rows, "id long, v string, ts long").coalesce(1).write.mode("append").parquet(source)
        before = store.current()
        upkeep.merge_stream(spark.readStream.schema("id long, v string, ts long").parquet(source), store, "id", ["v"], "ts", "t", at, 8)
        return [b for b, v in store.current().items() if before.get(b) != v]

    assert len(drain([(i, "a", 0) for i in range(100)])) == 8
    assert len(drain([(5, "b", 1), (5, "c", 2)])) == 1
    assert len(drain([(5, "c", 3), (6, "x", 3), (100, "n", 3)])) <= 3
    got = {r.id: (r.v, r.update_state) for r in store.read().collect()}
    assert len(got) == 101 and got[5] == ("c", "unchanged") and got[6] == ("x", "updated") and got[100] == ("n", "new") and got[7] == ("a", "new")


def test_a_batch_is_elected_with_one_join(spark):
    """Stored and named rows meet in one aggregate; only the winners are joined, so rows are moved few times."""
    from marlstone.operators.election import reelect

    stored = spark.createDataFrame([("a", "x", False), ("b", "x", True), ("c", "z", True)], "event_id string, content_key string, superseded boolean")
    out = reelect(stored, spark.createDataFrame([("a", "x", "y"), ("d", None, "")], CHANGES), F.lit(1))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.event_id, r.content_key, r.superseded) for r in out.collect()) == [("a", "y", False), ("b", "x", False), ("c", "z", True)]
