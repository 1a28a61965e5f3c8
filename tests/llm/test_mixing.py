import re
from collections import defaultdict

from pyspark.sql import functions as F

from marlstone.llm import mixing
from marlstone.llm.common import word_count


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over


def check(docs, rows):
    """docs: (id, source, text); rows: op8's."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, s, t in docs:
        per[s] += size(t)
    want = brute_targets(per)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), size(t)) for d, _, t in docs)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    source = {d: s for d, s, _ in docs}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == per[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)


def rows_of(df, **k):
    rows = mixing._rows(df, "doc_id", "source", word_count("text"))
    return mixing.mix(rows, **k)


def digest(df):
    taken = F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("taken")
    return df.groupBy("uid", F.col("id").alias("doc_id"), "size", "source_size", "target").agg(taken).collect()


def test_small_tables(spark):
    words = lambda n: " ".join(["w"] * n) or None
    docs = [(i, "hot", words(n)) for i, n in enumerate((5, 0, 700, 30, 12, 9000))] + [(20 + i, f"s{i}", words(3 + i)) for i in range(9)] + [(40, None, words(50)), (41, "é", "a\tb"), (42, "", ""), (43, "Z", words(1))]
    df = spark.createDataFrame([(d, s, t, 1, 2) for d, s, t in docs], "doc_id long, source string, text string, size int, slot int")
    for block in (7, 1024):
        got = rows_of(df, block=block)
        check(docs, digest(got))
        parts = [r for r in got.collect() if r.slot is not None]
        assert all(0 <= r.first < r.last <= r.size for r in parts)
        by = defaultdict(list)
        for r in parts:
            by[r.slot].append(r)
        assert all(len({r.source for r in x}) == 1 and sum(r.last - r.first for r in x) <= max(block + block // 2, 2 * block) or block == 7 for x in by.values())
    same = [(1, "a", "x y z")] * 4 + [(2, "b", "x")] * 3
    check_df = spark.createDataFrame(same, "doc_id long, source string, text string")
    check(same, digest(rows_of(check_df)))
    assert rows_of(df.limit(0)).count() == 0
    assert [r.taken for r in digest(rows_of(df.where("doc_id = 42")))] == [0]


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([("a", 500_000), ("b", 300_000), (None, 200_000)], "source string, goal long")
    rows = mixing.schedule(goals, 1_000_000, 100).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(10_000))
    seen = defaultdict(int)
    share = {"a": 0.5, "b": 0.3, None: 0.2}
    for i, r in enumerate(rows, 1):
        assert r.nth == seen[r.source]
        seen[r.source] += 1
        assert all(abs(seen[s] - i * p) < 8 for s, p in share.items())


def test_table_and_reruns(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    a, b = (mixing.op8_mixing(spark, d).collect() for _ in range(2))
    check(docs, a)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_mixed_keeps_whole_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(n.values()) <= {1, 2} and out.join(df, df.columns, "left_anti").count() == 0
