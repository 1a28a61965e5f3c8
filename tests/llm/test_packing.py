import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from marlstone.llm import packing

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "\n\n", "a", "Don't they'll 'S x''s 'tis", "<|endoftext|> a<|startoftext|>b <|", "ÀÉÎ ß ªº ×÷ ǅ İ ﬁ", "é àb ́", "tab\tsep nb　x\x0b\x1c", "漢字かな 한글", "12 345 6,7.8", "🙂👍🏽 ok", "w" * 5000, "A.B.C!!??"]


def brute(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_matches_the_tokenizer():
    texts = [r.text for r in __import__("pandas").read_parquet("/root/testdata/sf0.001/documents.parquet").itertuples()][:60] + ODD
    for most in (1 << 20, 50):
        encode = packing.Encoder(most=most)
        for a in range(0, len(texts), 7):
            for t, ids in zip(texts[a : a + 7], encode([t.encode() for t in texts[a : a + 7]]), strict=True):
                assert ids.tolist() == brute(t)[:-1], t[:80]


def check_places(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for s in at.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= capacity
    return len(at)


def test_pack_is_whole_and_tight(spark):
    rng = random.Random(7)
    texts = [None, *ODD, *[" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(rng.randrange(1, 4000))) for _ in range(80)]]
    df = spark.createDataFrame([(i if i != 3 else None, t, 5) for i, t in enumerate(texts)] * 2, "doc_id long, text string, length int")
    rows = packing.pack(df).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, t in enumerate(texts):
        ids = brute(t)
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[(i if i != 3 else None, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 2
    assert got == want
    used = check_places(rows, 2048)
    assert used <= 1 + 1.01 * sum(r.length for r in rows) / 2048
    assert packing.pack(df.limit(0)).count() == 0


def test_solve_reaches_small_optima():
    assert packing.solve({6: 2, 5: 2, 4: 2, 3: 2, 2: 4}, 10).sequences == 5
    assert packing.solve({10: 3}, 10).sequences == 3
    assert packing.solve({7: 5, 3: 5}, 10).sequences == 5
    assert packing.solve({}, 10).sequences == 0
    for seed in range(20):
        rng = random.Random(seed)
        h = Counter(rng.randrange(1, 61) for _ in range(200))
        total = sum(k * n for k, n in h.items())
        assert packing.solve(h, 100).sequences <= -(-total // 100) + 1


def fewest(items, capacity):
    """The least number of sequences, over all subsets of the items."""
    best = [(1, 0)] + [(len(items) + 1, 0)] * ((1 << len(items)) - 1)
    for m in range(1, 1 << len(items)):
        for i, x in enumerate(items):
            if m >> i & 1:
                n, used = best[m ^ 1 << i]
                best[m] = min(best[m], (n, used + x) if used + x <= capacity else (n + 1, x))
    return best[-1][0]


def test_search_to_proof_matches_an_exact_solver():
    better = 0
    for seed in range(120):
        rng = random.Random(seed)
        capacity = rng.choice([20, 50, 100, 101])
        items = [rng.randrange(max(1, capacity // rng.choice([3, 5, 8])), capacity // rng.choice([1, 2]) + 1) for _ in range(rng.randrange(1, 12))]
        plan, first, want = packing.solve(Counter(items), capacity, effort=None), packing.solve(Counter(items), capacity, effort=0), fewest(items, capacity)
        assert plan.proved and plan.sequences == want and plan.bound <= want
        assert first.sequences >= want and (not first.proved or first.sequences == want)
        better += first.sequences > want
    assert packing._dominated([5, 3], 0, 1 << 8) and not packing._dominated([5, 3], 0, 1 << 7 | 1 << 5)
    assert packing._dominated([5, 3], 2, 1 << 10) and packing._dominated([5, 3], 2, 1 << 7) and not packing._dominated([5, 3], 1, 1 << 7)


def test_first_packing_is_improved():
    rng = random.Random(2)
    items = []
    for _ in range(20):  # triples that fill a sequence
        a = rng.randrange(380, 490)
        b = rng.randrange(251, max(252, (1000 - a) // 2 + 1))
        items += [a, b, 1000 - a - b]
    plan = packing.solve(Counter(items), 1000)
    assert plan.sequences == plan.bound == 20 and plan.proved


def test_colliding_hashes():
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    x, y = ("".join(s[b] for b in bits) for s in ("ab", "ba"))
    encode = packing.Encoder()
    for texts in ([x, f"{y} {x} {y}"], [y, x], [f"{x} end"]):
        for t, ids in zip(texts, encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == brute(t)[:-1]


def test_bounds_hold_and_prove():
    rng = random.Random(12)
    assert packing.solve({3: 1_000_000}).proved and packing.solve({3: 1_000_000}).bound == 1467
    assert packing.solve({700: 400}, effort=0).proved  # two to a sequence, whatever the lengths add up to
    for _ in range(300):
        capacity = rng.choice([7, 10, 12])
        items = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 9))]
        counts = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        assert packing.lower_bound(counts, capacity) <= fewest(items, capacity)


def test_plan_and_effort_reach_the_operator(spark):
    rng = random.Random(13)
    rows = spark.createDataFrame([(i, 0, rng.randint(200, 1100)) for i in range(60)], "id long, piece int, length int").cache()
    rows = rows.select("id", "piece", rows.length.cast("long").alias("length"))
    plan = packing.plan_of(rows, effort=None)
    out = packing.place(rows, plan=plan).collect()
    assert plan.proved and plan.bound <= plan.sequences == len({r.sequence_id for r in out}) and len(out) == 60
    assert packing.place(rows, effort=None).select("sequence_id").distinct().count() == plan.sequences
    docs = spark.createDataFrame([(1, "a few words"), (2, "more of them here"), (3, None)], "doc_id long, text string")
    assert packing.pack(docs, effort=None).count() == 3
