"""Invariants and literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates, hashing, records, text, urls, web
from marlstone.operators import breaker, election, facets, keyset, merge, sequence
from marlstone.operators.normalize import normalized, split
from marlstone.sources import venues
from marlstone.sources.dom import tree


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_dates(spark):
    raw = ["2026.05.01", "2026.5.1", "2026-05-01", "2026-5-1", "2026-05-01T23:00:00+09:00", "2026-02-30", "2026/05/01", "", " 2026.05.01 ", "2026-05-01T25:00:00Z"]
    got = one(spark, *[dates.parse_date(F.lit(r)) for r in raw])
    assert list(got) == ["2026-05-01"] * 5 + [None, None, None, "2026-05-01", None]
    assert one(spark, dates.normalize_deadline(F.lit("2026년 9월 1일 까지")), dates.normalize_deadline(F.lit("1999.1.1")), dates.normalize_deadline(F.lit("선착순 마감"))) == ("2026-09-01", None, None)
    r = one(spark, dates.date_range(F.lit("2026.05.03"), F.lit("2026.05.01"))).c0
    assert (r.start, r.end, r.confidence) == (None, None, "low") and "precedes" in r.note
    assert one(spark, dates.date_evidence(F.lit("접수 9월 1일 마감"), F.lit("2026-09-01")), dates.date_evidence(F.lit("19.10"), F.lit("2026-09-01"))) == (True, False)


def test_classifier(spark):
    cases = {"AI안전보건박람회": ["ai"], "available email": [], "AI 유학설명회": [], "Smart Factory and Robot World": ["humanoid-robotics"], "BIO KOREA AI expo": ["ai", "bio"], "의료기기 헬스케어 전시": ["medical-devices", "digital-health"], None: []}
    got = one(spark, *[text.classify(F.lit(k)) for k in cases])
    assert [list(g.categories) for g in got] == list(cases.values())
    assert [g.excluded for g in got] == [not v for v in cases.values()]


def test_facet_counts(spark):
    df = spark.createDataFrame([(["ai"],), (["ai", "bio"],), (["humanoid-robotics"],), (["ai"],), ([],), (["medical-devices"],)], "categories array<string>")
    got = {r.category: r.n for r in facets.zero_filled(df, "categories", text.CATEGORIES).collect()}
    assert got == {"ai": 3, "bio": 1, "humanoid-robotics": 1, "medical-devices": 1, "digital-health": 0}


def test_hash_and_key(spark):
    h = lambda a, b: hashing.content_hash({"a": a, "b": b})
    s = lambda x: F.lit(x).cast("string")
    got = one(spark, h(s("x y"), s(None)), h(s(" x \t y "), s(None)), h(s("x y"), s("")), h(s("x"), s("y")), h(s("xy"), s("")))
    assert got[0] == got[1] and len(set(got)) == 4
    keys = one(spark, *[hashing.content_key(F.lit(n), F.lit("2026-01-01"), F.lit("coex")) for n in ("2026 로보월드", "로보월드 (제 5회)", "5th 로보월드!", "로봇월드", "2026년 제5회")])
    assert keys[0] == keys[1] == keys[2] != keys[3] and keys[4] is None
    a = one(spark, hashing.canonical_array(F.array(F.lit("b"), F.lit(" a"), F.lit("b")))).c0
    assert a == '["a","b","b"]'


def test_merge_is_idempotent_and_hash_agrees_with_diff(spark):
    fields = ["v", "w"]
    prev = merge.hashed(spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "k int, v string, w string"), fields).withColumns({c: F.lit("t0") for c in ("created_at", "updated_at", "last_checked_at", "update_state")})
    inc = merge.hashed(merge.latest(spark.createDataFrame([(1, " a ", "x", 1), (2, "old", "y", 1), (2, "b", "", 2), (4, "d", None, 1)], "k int, v string, w string, o int"), "k", "o").drop("o"), fields)
    both = merge.joined(prev, inc, "k")
    snap = {r.k: r for r in merge.snapshot(both, "k", fields, F.lit("t1"), F.lit("t1")).collect()}
    assert {k: r.update_state for k, r in snap.items()} == {1: "unchanged", 2: "updated", 3: "t0", 4: "new"}
    assert (snap[1].updated_at, snap[1].last_checked_at, snap[2].updated_at, snap[2].created_at, snap[3].last_checked_at) == ("t0", "t1", "t1", "t0", "t0")
    diff = [(r.k, r.field_path, r.old_value, r.new_value) for r in merge.differences(both, "k", fields).collect()]
    assert diff == [(2, "w", None, "")]
    again = merge.joined(merge.snapshot(both, "k", fields, F.lit("t1"), F.lit("t1")), inc, "k")
    assert merge.differences(again, "k", fields).count() == 0


def test_election_does_not_depend_on_order(spark):
    rows = [("showala-1", "k"), ("kintex-9", "k"), ("coex-2", "k"), ("akei-7", "k"), ("coex-3", None), ("x", "")]
    a, b = ({r.event_id: r.superseded for r in election.elect(spark.createDataFrame(x, "event_id string, content_key string")).collect()} for x in (rows, rows[::-1]))
    assert a == b == {"showala-1": True, "kintex-9": True, "coex-2": True, "akei-7": False, "coex-3": False, "x": False}


def test_keyset_walk_has_no_gaps(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(50)], "u int, id int")
    seen, at = [], None
    while True:
        spec = keyset.PageSpec(["u", "id"], limit=7, after=at)
        rows = keyset.trimmed(keyset.page(df, spec), spec).orderBy("page_pos").collect()
        seen += [r.id for r in rows]
        if not rows or not rows[0].has_more:
            break
        at = [rows[-1].u, rows[-1].id]
    assert seen == list(range(50))
    assert [keyset.clamp_limit(x) for x in (None, "x", 0, -1, 5, "7", 1000)] == [20, 20, 20, 20, 5, 7, 100]
    bad = one(spark, *[keyset.decode_cursor(F.lit(x)) for x in ("", "!!", "abc")])
    assert list(bad) == [None] * 3


def test_breaker(spark):
    d = lambda *a, **k: breaker.decision(*[F.lit(x) for x in a], **k)
    assert list(one(spark, d(0, 9, 0, 0), d(1, 9, 0, 0, floor=2), d(4, 9, 0, 0), d(5, 9, 9, 9), d(5, 9, 9, 9, most_changed=0.5), d(1, 0, 0, 0))) == ["zero_refs", "below_floor", "discovery_drop", None, "change_spike", None]


def test_early_stop_and_caps(spark):
    rows = [("s", i, d) for i, d in enumerate(["f", "p", None, "p", "f", "p", "p", None, "p", "f"])]
    df = spark.createDataFrame(rows, "g string, o int, d string")
    got = [r.o for r in sequence.before_run(df, "g", ["o"], F.col("d").isNotNull(), F.coalesce(F.col("d") == "p", F.lit(False)), 3).collect()]
    assert sorted(got) == list(range(8))
    assert [r.o for r in sequence.keep_last(df, "g", "o", 2).collect()] == [9, 8]


def test_urls_and_robots(spark):
    assert urls.canonical_url("HTTP://Example.ORG:80/a/../b/./c/?q=1#f") == "http://example.org/b/c/?q=1"
    assert [urls.canonical_url(x) for x in ("ftp://x/", "http://u@x/", "http:///p", None)] == [None] * 4
    assert [urls.allowed_url(x) for x in ("https://example.org/", "http://10.1.2.3/", "http://a.local/", "http://[::1]/", "http://100.64.0.1/", "http://8.8.8.8/")] == [True, False, False, False, False, True]
    rules = web.robots_rules("User-agent: Special\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\n", "plain")
    assert {r["directive"] for r in rules} == {"disallow", "allow", "crawl-delay"}
    arr = F.array(*[F.struct(F.lit(r["directive"]).alias("directive"), F.lit(r["value"]).alias("value")) for r in rules])
    assert list(one(spark, *[web.allows(arr, F.lit(p)) for p in ("/", "/a", "/a/b/c", "/ab", "")])) == [True, False, True, False, True]
    assert web.last_json_object('x {"a": {"b": "}"}} y {"c": 1} {') == '{"c": 1}' and web.last_json_object("none") is None
    assert web.strict_object('{"a": 1}', ("a",)) and web.strict_object('{"z": 1}', ("a",)) is None


def test_markdown_and_contacts(spark):
    got = one(spark, text.md_text(F.lit("a|b\r\n[c](d)\\ <x>&")), text.md_url(F.lit(" https://x/ y<z> ")), text.strip_contacts(F.lit("mail a.b@c.de or 010-1234-5678")), text.slugify(F.lit(" Ab--C d! ")), text.left_runes(F.lit("가나다라"), 2))
    assert list(got) == ["a\\|b \\[c\\]\\(d\\)\\\\ \\<x\\>\\&", "<https://x/%20yz>", "mail [email removed] or [phone removed]", "ab-c-d", "가나"]


KINTEX = """<h3> Robot  World </h3><ul class="view-info-list"><li><span class="title">기 간</span><span class="info">2026.05.01 ~ 2026.05.03</span></li><li><span class="title">장소</span>
<div class="info">Hall 3 <a class="btn-table-info">map</a></div></li></ul><div class="read-table"><table><tr><th scope="row">홈페이지</th><td><a href=" https://r.org ">x</a></td></tr><tr><th scope="row">행사내용</th><td>robots &amp; more</td></tr></table></div>"""
SHOWALA = """<ul><li class="kor_tit">로보월드</li><li class="eng_tit">Robot World</li><li class="date"><p class="tit">기간</dt><p class="des">2026-05-01</p></li><li class="where"><p class="tit">개최장소</p><p class="des">KINTEX</p></li></ul>"""
AIIA = """<div class="bbs_view"><div class="tit"><div class="left"><em>[AI Org] Seminar</em></div></div></div><div id="DivContents">posted 2025.1.1\n일시: 2026.5.1 ~ 2026.5.2\nother 2026.6.1</div>"""


def test_venue_parsers(spark):
    k = venues.parse_one("kintex", "https://k/view.do?seq=77", KINTEX)
    assert (k["event_id"], k["name"], k["start_raw"], k["end_raw"], k["hall"], k["homepage_url"], k["summary_text"], k["error"]) == ("kintex-77", "Robot World", "2026.05.01", "2026.05.03", "Hall 3", "https://r.org", "robots & more", None)
    s = venues.parse_one("showala", "https://s/ex.php?idx=5", SHOWALA)
    assert (s["event_id"], s["name_en"], s["start_raw"], s["end_raw"], s["venue_name"], s["source_type"]) == ("showala-5", "Robot World", "2026-05-01", "2026-05-01", "KINTEX", "aggregator")
    a = venues.parse_one("aiia", "https://a/?num=3", AIIA)
    assert (a["organizer"], a["start_raw"], a["end_raw"]) == ("AI Org", "2026.5.1", "2026.5.2")
    assert venues.parse_one("akei", "https://a/?wr_id=3", "<p>").get("error")
    assert venues.event_dates("2026.1.1\n2026.2.2") == (None, None)
    rows, nxt, total = venues.showala_rows('<li class="ex_item"><a class="ex_tit_a" href="d.php?idx=9"></a><div class="ex_date"><span>기간</span>2026-01-02 ~ 2026-01-03</div><div class="ex_place">KINTEX</div></li>:::2:::7')
    assert rows == [{"idx": "9", "venue": "KINTEX", "start": "2026-01-02"}] and (nxt, total) == (2, 7)
    pages = spark.createDataFrame([("https://k/view.do?seq=1", KINTEX), ("https://k/view.do?seq=2", None)], "url string, html string")
    good, bad = split(normalized(venues.parse(pages, "kintex"), "2026-01-01T00:00:00Z"))
    e = good.first()
    assert good.count() == 1 and (e.event_id, e.start_date, e.venue.venue_id, list(e.categories)) == ("kintex-1", "2026-05-01", "kintex", ["humanoid-robotics"]) and e.content_key == "robotworld|2026-05-01|kintex"
    assert bad.first().message == "rule1: name required" and tree("<p>a<p>b").all("p")[1].text() == "b"


def test_listing_connector(spark, tmp_path):
    from marlstone.sources import connector

    for n in range(1, 5):
        (tmp_path / f"page-{n}.html").write_text("".join(f"fnView('./view.do', {n}{i})" for i in range(3)))
    connector.register(spark)
    df = spark.read.format("listing").option("path", str(tmp_path)).option("pages", 4).option("pagesPerPartition", 2).load()
    assert df.count() == 12 and {r.ref for r in df.where("page >= 3 AND page <= 3").collect()} == {"30", "31", "32"}
    with pytest.raises(Exception):
        spark.read.format("listing").option("path", str(tmp_path)).option("pages", 9).load().count()


def test_records(spark):
    assert one(spark, records.appended(F.array(F.lit("a")), "b"), records.appended(F.array(F.lit("b")), "b"), records.appended(F.lit(None).cast("array<string>"), "b")) == (["a", "b"], ["b"], ["b"])
    assert list(one(spark, *[records.without_template_summary(F.lit(s), F.lit("Fair")) for s in ("fair", "Fair — x", "Fair @ y", "Fairly good")])) == [None, None, None, "Fairly good"]


def test_a_suggested_date_is_read_once(spark):
    """However many pages may bear it out, the optimized plan reads its three parts once."""
    from marlstone.operators import enrich

    rows = [(None, "2026.9.1", "until 2026년 9월 1일"), (None, "2026.9.1", "9월 1일까지"), (None, "2026.9.1", "19.10"), ("2030-01-01", "2026.9.1", "2026-09-01"), (None, "soon", "2026-09-01"), (None, None, None)]
    df = spark.createDataFrame(rows, "known string, said string, page string")
    got = df.select(enrich.suggested_deadline(F.col("known"), F.col("said"), F.array(F.lit("x"), F.col("page"), F.lit("y"))).alias("d"))
    assert [r.d for r in got.collect()] == ["2026-09-01", "2026-09-01", None, "2030-01-01", None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 3
