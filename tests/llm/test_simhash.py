import re

import numpy as np
import xxhash

from marlstone.llm import components, simhash


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(codes, radius=2):
    codes = sorted(codes)
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def near_codes(seed, n, spread):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    out = set()
    while len(out) < n:
        c = int(base[rng.integers(4)])
        for b in rng.integers(0, 64, rng.integers(0, spread)):
            c ^= 1 << int(b)
        out.add(c)
    return sorted(out)


def test_fingerprints():
    texts = [None, "", "A b", "a", "One two  three", "x y z X Y Z x y z", "é à ü\n é", "w " * 5000]
    got = simhash.fingerprints_of([(t or "").encode() for t in texts])
    assert [int(x) for x in got] == [brute_fp(t) for t in texts]


def test_forest_joins_the_same_codes():
    for seed, n, spread in ((1, 300, 4), (2, 700, 7), (3, 5, 3), (4, 1, 2)):
        codes = np.array(near_codes(seed, n, spread), np.uint64)
        a, b = simhash.forest(np.zeros(n, np.int64), codes)
        want = brute_roots([int(c) for c in codes])
        root = {int(c): int(c) for c in codes} | {int(x): int(y) for x, y in zip(a, b, strict=True)}
        groups = {}
        for c in root:
            groups.setdefault(root[c], set()).add(c)
        brute = {}
        for c, r in want.items():
            brute.setdefault(r, set()).add(c)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_links_with_and_without_refiling(spark):
    codes = near_codes(5, 400, 6)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    want = brute_roots(codes)
    for most in (4096, 8):
        found = components.components(simhash.links(df, "fp", most=most)).collect()
        root = {c: c for c in codes} | {r.node % (1 << 64): r.root % (1 << 64) for r in found}
        assert len(set(root.values())) == len(set(want.values()))
        by = {}
        for c in codes:
            by.setdefault(root[c], set()).add(want[c])
        assert all(len(x) == 1 for x in by.values())


def test_rows(spark):
    same = "one two three four five six seven"
    rows = [(3, same, 1), (1, same, 2), (None, same, 3), (7, None, 4), (5, "", 5), (9, "quite another text of nine words stands here now", 6), (1, same, 2), (None, "a text without an id that is its own", 7), (None, "a second text without an id and nothing more", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.id, r.fp): r.component_id for r in simhash.near_duplicates(df).collect()}
    assert {k[0]: v for k, v in got.items() if k[0]} == {3: 1, 1: 1, 7: 5, 5: 5, 9: 9}
    assert sorted(str(v) for k, v in got.items() if k[0] is None) == ["1", "None", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fp = {r.doc_id: brute_fp(r.text) for r in df.collect()}
    roots = brute_roots(set(fp.values()))
    least = {}
    for d, f in fp.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (f"{f:016x}", least[roots[f]]) for d, f in fp.items()}
