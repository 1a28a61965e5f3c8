import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from marlstone.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n=2):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=2, buckets=10000, percent=25, min_words=20):
    file = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(file(g) for _, x in rows for g in features(x, n)[1]) for rows in (docs, target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        w, f = features(x, n)
        weight = sum(gain[file(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((tuple([*r, rank.get(id(r))]) for r in out), key=str)


def run(spark, docs, target, **how):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, R.draw(a, spark.createDataFrame(target, "item_id long, text string"), **how).collect()), key=str)


def some(rng, n):
    pool = ["a", "the", "Über", "x1", "naïve", "東京", "0", "word" * 9, "LOUD", "émeute", "z" * 70, "q" * 200]
    return rng.choice([" ", "  ", "\n", "-", ", "]).join(rng.choice(pool) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") for _ in range(n))


def test_shift_is_zlibs_combination():
    rng = random.Random(1)
    for size in [*range(70), 127, 128, 1000, 65536, 1 << 20]:
        a, b = rng.randbytes(rng.randrange(20)), rng.randbytes(size)
        got = R.shift(np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0] ^ np.uint32(zlib.crc32(b))
        assert got == zlib.crc32(a + b)


def test_grams_of_up_to_four_words(monkeypatch):
    rng = random.Random(2)
    texts = [some(rng, k) for k in (0, 1, 2, 3, 5, 40, 900)] + ["", "---", "A b", "é", "x" * 5000 + " y", "\x00ab\x7fcd"]
    for block in (R.BLOCK, 64):  # a small one makes every slice a long text
        monkeypatch.setattr(R, "BLOCK", block)
        if block == 64:
            monkeypatch.setattr(R, "slices", lambda t: ((i, i + 1) for i in range(len(t))))
        for n in (1, 2, 4):
            got = [[] for _ in texts]
            for row, crc, _ in R.grams([t.encode() for t in texts], n):
                for i, c in zip(row.tolist(), crc.tolist(), strict=True):
                    got[i].append(c)
            assert [sorted(x) for x in got] == [sorted(zlib.crc32(g.encode()) for g in features(t, n)[1]) for t in texts]


def test_draw_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, some(rng, rng.choice([0, 3, 19, 20, 21, 60]))) for i in range(200)] + [(500, None), (501, ""), (502, "x" * 100000), (None, some(rng, 30))]
    docs += [(600 + i, docs[5][1]) for i in range(40)] + [(700, some(rng, 60000))]
    target = [(i, some(rng, 25)) for i in range(10)] + [(99, None)]
    assert run(spark, docs, target) == brute(docs, target)
    assert run(spark, docs, target, ngrams=3, buckets=50, percent=60, min_words=0) == brute(docs, target, 3, 50, 60, 0)
    assert run(spark, docs[:30], []) == brute(docs[:30], [])
    assert run(spark, [], target) == []


def test_repeated_rows_each_take_a_place(spark):
    docs = [(1, "w " * 30)] * 6 + [(2, "v " * 30)] * 2
    got = run(spark, docs, [(1, "v w")], percent=50)
    assert len(got) == 8 and sorted(r[5] for r in got if r[5]) == [1, 2, 3, 4]


def test_resample_keeps_columns_and_follows_the_target(spark):
    docs = spark.createDataFrame([(i, ("apple pear " if i % 2 else "steel iron ") * 20, i, "s") for i in range(400)], "doc_id long, text string, rank long, range string")
    out = R.resample(docs, spark.createDataFrame([(1, "apple pear " * 200)], "item_id long, text string"))
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == 100 and sum(r.doc_id % 2 for r in rows) > 90
