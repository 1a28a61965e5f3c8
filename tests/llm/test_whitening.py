import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def brute(vectors, components=16):
    """(n, deviations, whitened up to the sign, explained) by numpy over grid points held as Python's integers."""
    x = [[int(np.floor(64 * c)) + 1000000 for c in v] for v in vectors]
    fit = [list(t) for t in sorted(set(map(tuple, x)))]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centre = lambda rows: np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in rows])
    v = centre(fit).T @ centre(fit) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, len(e))
    return n, deviation, centre(x) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_equals_numpy(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 20)) * np.arange(1, 21)).astype(np.float32).tolist()
    good += [good[0]] * 60 + [[c + 1e-6 for c in good[1]]]  # copies, and one that falls on the same grid point or beside it
    good = np.array(good, np.float32).tolist()
    bad = [None, [None] + [1.0] * 19, [NAN] + [1.0] * 19, [INF] * 20, [-INF] + [0.0] * 19, [], [1.0] * 7]
    df = table(spark, list(enumerate(good)) + [(1000 + i, v) for i, v in enumerate(bad)])
    m = W.fit(df)
    got = {r.id: r for r in W.whiten(df, m).collect()}
    n, deviation, white, explained = brute(good)
    assert m.n == n and sorted(got) == list(range(len(good)))
    assert [int(got[i].deviation) for i in sorted(got)] == deviation
    assert np.allclose(m.explained, explained, rtol=1e-9)
    mine = np.array([got[i].whitened for i in sorted(got)])
    assert np.allclose(np.abs(mine), np.abs(white), atol=1e-8) and (np.abs(mine - white).max(0) < 1e-8).tolist() == (np.abs(mine + white).max(0) > 1e-8).tolist()
    assert m.identity_error < 1e-9


def test_far_values_stay_exact(spark):
    rng = random.Random(6)
    rows = [[rng.uniform(-1, 1) * 1e13, rng.uniform(-1, 1) * 1e12, rng.uniform(-1, 1)] for _ in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    m = W.fit(df)
    n, deviation, _, explained = brute(rows)
    got = W.whiten(df, m).orderBy("id").collect()
    assert m.n == n and [int(r.deviation) for r in got] == deviation and np.allclose(m.explained, explained, rtol=1e-9)
    wide = spark.createDataFrame([(i, [v * 1e200 for v in x]) for i, x in enumerate(rows)] + [(99, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert W.fit(wide).n > 1  # entries beyond 2 ** 53 steps saturate


def test_wide_rows_are_centred_in_decimals(spark):
    df = spark.createDataFrame([([1 << 50, -7],), ([-(1 << 50), 9],)], "g array<bigint>")
    for n, reach in ((2, 1 << 50), (1 << 40, 1 << 50)):
        got = [r[0] for r in df.select(W._centred(F.col("g"), n, [3, 1], reach)).collect()]
        assert got == [[(n * a - s) / n for a, s in zip(g, [3, 1], strict=True)] for g in ([1 << 50, -7], [-(1 << 50), 9])]


def test_components_without_variance(spark):
    rows = [(i, [float(i % 5), 2.0, float(i % 5) * 2]) for i in range(30)]
    df = table(spark, rows)
    m = W.fit(df)
    assert m.n == 5 and m.sound.tolist() == [True, False, False] and m.identity_error < 1e-9
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in W.whiten(df, m).collect())
    one = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    m = W.fit(one)
    assert m.n == 1 and m.explained == [None, None] and m.identity_error is None
    assert [(r.deviation, r.whitened) for r in W.whiten(one, m).collect()] == [(0, [None, None])] * 2


def test_no_usable_rows(spark, tmp_path):
    df = table(spark, [(1, None), (2, []), (3, [NAN])])
    assert W.fit(df) is None and W.fit(df.limit(0)) is None
    df.withColumn("n", F.lit("clash")).withColumn("g", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = W.op12_whitening(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=18).tolist()) for i in range(100)]
    table(spark, rows).withColumn("id", F.lit("clash")).withColumn("g", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op12_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 1600 and {r.component for r in got} == set(range(1, 17)) and {r.n for r in got} == {100}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    white = np.zeros((100, 16))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(white.T @ white / 100 - np.eye(16)).max() < 1e-9
