"""Running sums and overlaps of spans inside a row, against plain Python, and a long text of many matches."""

import random
import time

from pyspark.sql import functions as F

from marlstone.llm import pii

SPANS = "c array<struct<start:bigint,kind:int,end:bigint,margin:double>>, b array<struct<start:bigint,kind:int,end:bigint>>"


def test_running(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 300, 5000)]
    df = spark.createDataFrame([(r,) for r in rows], "a array<int>")
    for r in df.select("a", pii.running(F.col("a"), lambda x: x, "sum").alias("s"), pii.running(F.col("a"), lambda x: x, "max").alias("m")).collect():
        assert r.s == [sum(r.a[: i + 1]) for i in range(len(r.a))] and r.m == [max(r.a[: i + 1]) for i in range(len(r.a))]


def test_overlaps(spark):
    rng = random.Random(2)

    def spans(n, wide):
        return [(s, rng.randrange(4), s + rng.randrange(1, wide), rng.choice([0.5, 1.0, 2.0])) for s in (rng.randrange(400) for _ in range(n))]

    rows = [(spans(n, w), [x[:3] for x in spans(m, v)]) for n, w, m, v in [(0, 9, 3, 9), (1, 9, 0, 9), (80, 9, 30, 20), (200, 30, 5, 200), (60, 3, 60, 3), (150, 90, 0, 2)]]
    over = lambda x, y: x[0] < y[2] and y[0] < x[2]
    df = spark.createDataFrame(rows, SPANS).select(pii.apart(F.col("c"), F.col("b")).alias("free"), pii.strongest(F.col("c")).alias("best"), "c", "b")
    for r in df.collect():
        c = [tuple(x) for x in r.c]
        assert [tuple(x) for x in r.free] == [x for x in c if not any(over(x, y) for y in r.b)]
        rank = lambda x: (x[3], -x[0], -x[1])
        assert sorted(tuple(x) for x in r.best) == sorted(x for x in c if not any(over(x, y) and rank(y) > rank(x) for y in c))


def test_many_matches_in_one_text(spark):
    line = "+49 30 1234567, mail a.b@c.de or call 030 1234567 "
    df = spark.createDataFrame([(1, line * 8000), (2, ""), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r.id: r for r in pii.find(df).collect()}
    assert len(got[1].base) == 16000 and got[1].base[-1].start == line.index("a.b@") + len(line) * 7999 and got[2].spans == got[3].spans == []
    assert time.time() - began < 90
