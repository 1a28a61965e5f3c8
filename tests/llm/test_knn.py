import random

from marlstone.llm import knn


def brute(rows, queries, k):
    out = []
    for qi, q in queries:
        if q is not None:
            near = sorted((bin((q ^ c) & (1 << 64) - 1).count("1"), i) for i, c in rows if c is not None)[:k]
            out += [(qi, n, i, d) for n, (d, i) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, queries, k=10):
    a, b = (spark.createDataFrame(x, "id long, code long") for x in (rows, queries))
    return sorted(map(tuple, knn.search(a, b, k).collect()))


def test_exact(spark):
    rng = random.Random(4)
    base = rng.getrandbits(63)
    rows = [(i, base) for i in range(30)] + [(100 + i, base ^ (1 << rng.randrange(64)) - (1 << 63) if False else base ^ (1 << rng.randrange(62))) for i in range(40)]
    rows += [(200 + i, rng.getrandbits(64) - (1 << 63)) for i in range(120)] + [(999, None), (5, base)]
    queries = [rows[0], rows[1], rows[45], rows[150], (1000, -1), (999, None)]
    assert run(spark, rows, queries) == brute(rows, queries, 10)
    assert run(spark, rows[:4], queries[:1], 10) == brute(rows[:4], queries[:1], 10)
    assert run(spark, rows, []) == [] == run(spark, [], queries)


def test_codes(spark):
    from pyspark.sql import functions as F

    e = [[1.0, -1.0, 0.0, 2.0], [], None, [None, 1.0], [-1.0] * 63 + [1.0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(e)], "id long, e array<float>")
    got = {r.id: r.c for r in df.select("id", knn.sign_code(F.col("e")).alias("c")).collect()}
    assert got == {0: 9, 1: 0, 2: None, 3: 2, 4: -(1 << 63)}
