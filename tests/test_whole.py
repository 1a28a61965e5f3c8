"""Whole-job queries against brute force on the same files."""

import re
from collections import Counter

import pyarrow.parquet as pq

from marlstone import catalog
from marlstone.operators import evidence

D = "/root/testdata/sf0.001"


def read(name, *cols):
    t = pq.read_table(f"{D}/{name}.parquet", columns=list(cols))
    return list(zip(*[t.column(c).to_pylist() for c in cols]))


def got(spark, name):
    return [tuple(r) for r in catalog.queries()[name](spark, D).collect()]


def classes(items, texts):
    flat = lambda t: re.sub(r"[ \t\n\v\f\r]+", " ", t).lower()
    hay, out = [flat(t) for t in texts if t is not None], {}
    for k, v in items:
        v = flat(v).strip(" ")
        words = [w for w in re.split("[^a-z0-9]+", v) if len(w) > 2]
        ranks = [2 if v and v in t else 1 if words and all(w in t for w in words) else 0 for t in hay]
        out[k] = ["unverified", "partial", "verified"][max(ranks, default=0)] if texts else "unreachable"
    return out


def test_audit(spark):
    want = classes(read("benchmark", "item_id", "text"), [t for (t,) in read("documents", "text")])
    assert dict(got(spark, "evidence_audit")) == want
    row = catalog.queries()["audit_summary"](spark, D).first().asDict()
    assert row == {c: Counter(want.values())[c] for c in evidence.CLASSES} | {"total": len(want)}
    assert row["verified"] == Counter(c for _, c in got(spark, "evidence_audit"))["verified"]


def test_audit_fixture(spark):
    start = "one and the same beginning of forty letters, "
    items = [(1, start + "Then\n this"), (2, start + "then that"), (41, "words any order"), (5, ""), (6, "é ü"), (7, "no such thing")]
    texts = ["x " + start + "THEN this y", "any order of wordsmiths", None, "", "the é  Ü"]
    rows = spark.createDataFrame(items, "k long, v string")
    for t in (texts, []):
        pages = spark.createDataFrame([(x,) for x in t], "t string")
        assert {r[0]: r[1] for r in evidence.name_classes_anywhere(rows, pages, "k", "v", "t").collect()} == classes(items, t)


def test_nested_sources(spark):
    rows = got(spark, "nested_sources")
    assert Counter(rows) == Counter(read("lineitem", "l_orderkey", "l_partkey", "l_suppkey"))
    assert len(rows) == len(got(spark, "nested_sources"))


def test_whole_texts(spark):
    docs, words = read("documents", "doc_id", "text"), ("the", "der", "qué", "les ")
    assert sorted(got(spark, "fixture_search")) == sorted((i, w) for i, t in docs for w in words if t and w in t.lower())
    signs = (("register", "register|registration|ticket"), ("exhibit", "exhibit|booth"), ("sponsor", "sponsor"), ("match", "matchmaking|buyer meeting"), ("startup", "startup|pitch|demo day"))
    tails = ("Registration now", "a booth", "our sponsors", "x", "startups pitch")
    said = lambda i, t: next((a for a, p in signs if re.search(p, (t + tails[i % 5]).lower())), None)
    assert dict(got(spark, "action_signals")) == {i: said(i, t) for i, t in docs}


def test_action_past_the_beginning(spark, tmp_path):
    spark.createDataFrame([(3, "far " * 40 + "Sponsors")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.queries()["action_signals"](spark, str(tmp_path)).collect()] == [(3, "sponsor")]


def test_opened_page_fill(spark):
    pages = {i: (re.search("<title>(.*?)</title>", h) or [0, ""])[1] for i, h in read("pages", "page_id", "html")}
    want = {(i, "kept" if i % 2 == 0 else t.strip(" ") or None, "kept too" if i % 3 == 0 else "call [phone removed]") for i, t in pages.items()}
    rows = got(spark, "opened_page_fill")
    assert len(rows) == len(pages) and set(rows) == want
    assert any(t != t.strip(" ") for t in pages.values()) and len(rows) == len(got(spark, "opened_page_fill"))


def test_opened_titles_stay_as_they_stand(spark, tmp_path):
    """Contacts, long titles, white space inside and no title at all: what the SQL gives."""
    import duckdb

    titles = {1: "ask a.b@mail.example.com", 3: " two \t\tgaps ", 5: "x" * 400, 7: "call 010-1234-5678", 9: " ", 2: "a@b.example.com"}
    rows = [(i, f"<html><title>{t}</title></html>") for i, t in titles.items()] + [(11, "<p>none"), (13, None)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["opened_page_fill"](spark, str(tmp_path)).select("page_id", "title", "snippet").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.oracle_sql()["opened_page_fill"]).fetchall())
    assert dict(r[:2] for r in map(tuple, got))[1] == titles[1]


def test_pages_read_the_references_of_their_sql(spark, tmp_path):
    """References that a cut has left without their semicolon stay as they stand, as do those that a query's SQL doesn't name."""
    import duckdb

    title, body = 'a &amp; b &quot;c&quot; &amp', "x &amp; y &lt;z&gt; &amp. &quot"
    html = f'<html><title>{title}</title><body><p>{body}</p><a href="/q?a=1&amp;b=2&copy">A&amp;B &amp</a> R&am</body></html>'
    spark.createDataFrame([(1, html), (2, html.replace("&amp<", "&quo<")), (3, "")], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name, cols in (("page_title", "page_id, title"), ("page_text", "page_id, body"), ("page_links", "page_id, ord, href, text")):
        got = catalog.queries()[name](spark, str(tmp_path)).selectExpr(*cols.split(", ")).collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {cols} FROM ({catalog.oracle_sql()[name]})").fetchall()), name


def test_pieces_are_bounded():
    import pyarrow as pa

    from marlstone.functions.batches import pieces

    texts = ["a" * 40, None, "b" * 200, "", "c" * 30, "d" * 30, "é" * 30] + ["e"] * 30
    got = list(pieces([pa.record_batch({"t": texts, "n": list(range(len(texts)))}).slice(1), pa.record_batch({"t": ["z"], "n": [99]})], "t", 100, 10))
    assert [x for b in got for x in b.column(0).to_pylist()] == texts[1:] + ["z"] and [x for b in got for x in b.column(1).to_pylist()] == [*range(1, len(texts)), 99]
    assert all(b.num_rows == 1 or (b.num_rows <= 10 and sum(len((x or "").encode()) for x in b.column(0).to_pylist()) <= 100) for b in got)
