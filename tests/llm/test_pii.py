import hashlib
import re

from marlstone.llm import pii


def luhn(d):
    return sum(x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "é a@b.c@d.e x", "a@b.c.@d.e", "a@b.c_d@e.f-g.h a@b", "..@-.-", "x@y..z", "1.2.3.4.5.6.7.8 0001.002.3.255 256.1.1.1 1.2.3", "4111 1111-1111 1111", "4111  1111 1111 1111 1", "41111111111111111111111",
    "5500005555555559 12 34", "+1 (017) 555-7713 +12", "++1 23456789 x", "+1((((((((2", "call 555-123-4567 now", "🙂 mail🙂 a.b@c.de🙂", "a" * 50000 + "@" + "b." * 30000 + "c", "1" * 60000, "1.2." * 3000, "+" + "1" * 14 + "(" * 9000, "1.2." * 20000, "at " * 3000, ": " * 2000 + ":" * 3000,
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, base string")
    for r in pii.find(df).collect():
        assert [tuple(s) for s in r.base] == brute(TEXTS[r.id]), r.id
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert pii.find(df.limit(0)).count() == 0


def test_added_spans(spark):
    good = ["please call 555-123-4567 today", "Tel. (030) 1234-5678 und", "write john.doe (at) example (dot) com soon", "anna [at] acme.org", "host 2001:db8::ff00:42 was", "card 4111.1111.1111.1111 ok"]
    clean = ["from 1998 - 2004 the", "on 2024-01-15 we", "ISBN 978-3-161-48410-0", "the 1234567890123456 of", "look at the tree. Then", "at 12:30:45 it", "version 10.2.3", "order 123456789012 sent", "in 3.14159 2.7182"]
    df = spark.createDataFrame(list(enumerate(good + clean)), "doc_id long, text string")
    got = {r.id: [tuple(s) for s in r.spans] for r in pii.find(df).collect()}
    assert all(got[i] for i in range(len(good))), {g: got[i] for i, g in enumerate(good)}
    assert not any(got[len(good) + i] for i in range(len(clean))), {g: got[len(good) + i] for i, g in enumerate(clean)}


def test_table(spark):
    rows = {r.doc_id: r for r in pii.op1_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want = brute(r.text)
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
