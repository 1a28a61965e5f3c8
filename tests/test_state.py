"""Quotas against a plain loop, and a store that outlives its process."""

import random
import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from marlstone.operators import sequence
from marlstone.streaming import ingest

ROOT = str(Path(__file__).resolve().parents[1])


def test_quotas_match_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), i, float(rng.randrange(3000))) for i in range(600)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double")
    want, state = {}, {}
    for c, i, t in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        s = state.setdefault(c, {"open": None, "n": 0, "a": None, "b": None, "na": 0, "nb": 0, "t": None, "left": 3.0})
        if s["open"] is None or t - s["open"] >= 200:
            s["open"], s["n"] = t, 0
        s["n"] += 1
        if s["a"] is None or t - s["a"] >= 50:
            s["a"], s["na"] = t, 0
        if s["b"] is None or t - s["b"] >= 400:
            s["b"], s["nb"] = t, 0
        both = s["na"] < 2 and s["nb"] < 5
        s["na"] += both
        s["nb"] += both
        s["left"] = 3.0 if s["t"] is None else min(3.0, s["left"] + (t - s["t"]) * 0.01)
        token = s["left"] >= 1
        s["left"], s["t"] = s["left"] - token, t
        want[i] = (s["n"] <= 4, both, token)
    t = F.col("t")
    got = [sequence.fixed_window_quota(df, "user_id", t, 4, 200), sequence.two_window_quota(df, "user_id", t, (2, 50), (5, 400)), sequence.token_bucket(df, "user_id", t, 0.01, 3.0)]
    got = [{r.event_id: r.allowed for r in g.collect()} for g in got]
    assert {i: tuple(g[i] for g in got) for i in want} == want
    assert sequence.token_bucket(df.limit(0), "user_id", t, 0.01, 3.0).count() == 0


def test_one_busy_client_is_linear(spark):
    began = time.time()
    many = spark.range(1_000_000).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"))
    assert sequence.token_bucket(many, "user_id", F.col("event_id") / 10, 1.0, 5.0).where("allowed").count() > 90_000
    assert time.time() - began < 60


INGEST = """
import sys
from marlstone import session
from marlstone.streaming import ingest
spark = session.build(2, "ingest", **{"spark.sql.shuffle.partitions": "2"})
folder = sys.argv[1]
stream = spark.readStream.schema("id long, v string, ts long").parquet(folder + "/in")
store = ingest.Versions(spark, folder + "/store")
ingest.merge_stream(stream, store, "id", ["v"], "ts", "2026-01-01", folder + "/checkpoint")
print("ROWS", sorted((r.id, r.v) for r in store.read().collect()))
"""


def test_restart_and_retry(spark, tmp_path):
    def batch(rows, n):
        spark.createDataFrame(rows, "id long, v string, ts long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        said = subprocess.run([sys.executable, "-c", INGEST, str(tmp_path)], cwd=ROOT, env={**__import__("os").environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=200)
        return next(line for line in said.stdout.splitlines() if line.startswith("ROWS"))

    batch([(i, "a", 1) for i in range(5)], 0)
    assert run() == f"ROWS {[(i, 'a') for i in range(5)]}"
    batch([(4, "b", 2), (7, "c", 2), (8, "d", 2)], 1)
    want = [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "b"), (7, "c"), (8, "d")]
    assert run() == f"ROWS {want}"
    store = ingest.Versions(spark, f"{tmp_path}/store")
    stream = f"{tmp_path}/checkpoint"
    assert store.place(stream, 0) == (None, 0) and store.place(stream, 1) == (0, 1) and store.place(stream, 2) == (1, 2) and store.place("another", 0) == (1, 2)
    store.publish(store.read(0), 1, stream, 1)  # a published micro-batch is run again
    assert store.place(stream, 1) == (0, 1) and store.read().count() == 5
