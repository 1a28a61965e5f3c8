import re

from marlstone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def share(text, n):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    inside = {j for at in seen.values() for i in at[1:] for j in range(i, i + n)}
    return sum(len(words[j]) for j in inside) / max(1, sum(map(len, words)))


TEXTS = [None, "", " \t\n\x0b", "a", "a a a a", "é ü x # *", "x\n" * 60, " ".join(f"w{i}" for i in range(60)), "l one\nl two\nl one\n\n\n l one", " ".join(f"w{i % 25}" for i in range(90)), "one two three four five six seven\n" * 9 + " ".join(f"v{i}" for i in range(200)), "z" * 300000]


def check(rows, texts):
    for r, t in zip(rows, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        for n in (5, 10):
            assert abs(r[f"share_{n}"] - share(t, n)) < 1e-9
        assert not (r.kept and r.base_failed)


def test_counts_match_brute_force(spark):
    texts = TEXTS * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    check(sorted(quality.score(df).collect(), key=lambda r: r.doc_id), texts)
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(df).collect() if r.kept} and 7 in {r.doc_id for r in kept.collect()}
    assert quality.score(df.limit(0)).count() == quality.keep(df.limit(0)).count() == 0


def test_tables_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in quality.score(df).collect()}
    rows = df.collect()
    check([got[r.doc_id] for r in rows], [r.text for r in rows])


def thue_morse(n):
    """Two texts that every rolling hash modulo 2**64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_colliding_hashes():
    x, y = thue_morse(4096)
    more = " ".join(f"w{i}" for i in range(60))
    texts = [f"{x}\n{y}", f"{x} p q {y} p q {more}", f"{x} {y} z\n{y} {x} z\n{x} {y} z\n{more}", f"{x}\n{y}\n{x}\n{y}\n{more}", "z" * 5000 + "a\n" + "z" * 5000 + "b\n" + "z" * 5000 + "a"]
    got = quality.judged([t.encode() for t in texts], quality.Rules())
    for i, t in enumerate(texts):
        assert tuple(got[c][i] for c in (*quality.COUNTS, "base_failed")) == brute(t)
        assert abs(got["share_5"][i] - share(t, 5)) < 1e-9
