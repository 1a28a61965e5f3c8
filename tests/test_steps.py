"""Addresses of candidates and session steps: literal cases."""

from marlstone.functions.urls import candidate_url
from marlstone.operators import steps


def test_candidate_url():
    cases = {
        " https://A.org:443 ": "https://a.org", "http://a.org/": "http://a.org/", "http://a.org//x//../y/": "http://a.org/y/", "https://a.org/a%20b/%E2%82%AC?q=%20#f": "https://a.org/a%20b/%E2%82%AC?q=%20",
        "https://a.org/p?": "https://a.org/p?", "https://a.org/x!(1)": "https://a.org/x%21%281%29", "https://[2001:4860::8]:8443/": "https://[2001:4860::8]:8443/", "https://[::1]/": None, "https://192.168.1.1/": None,
        "https://sub.localhost/": None, "https://169.254.169.254/": None, "mailto:a@b.org": None, "https://u:p@a.org/": None, "https://a.org/%zz": None, "https://a.org:x/": None, "": None, None: None,
    }
    assert {k: candidate_url(k) for k in cases} == cases


def test_actions_and_provenance(spark):
    rows = [(1, None), (2, '{"action":"search","query":"' + "a" * 600 + '"}'), (3, '{"action":"accept","selections":null}'), (4, '{"action":"Open","url":"x"}'), (5, '{"action":"search","query":"q"} then {"action":"done"}')]
    got = {r.id: r for r in steps.actions(spark.createDataFrame(rows, "id int, answer string"), "answer").collect()}
    assert {i: r.kind for i, r in got.items()} == {1: None, 2: "search", 3: None, 4: None, 5: "done"} and len(got[2]["query"]) == 500
    empty = spark.createDataFrame([("u", None), ("u", ("", "", None, "", None))], "url string, p struct<provider:string,relation:string,seed_url:string,parent_url:string,raw_url:string>")
    assert [r.p for r in steps.provenance(empty, "url", "p").collect()] == [None, None]
    assert steps.actions(spark.createDataFrame([], "id int, answer string"), "answer").count() == 0
    long = spark.createDataFrame([(1, i) for i in range(12)], "s int, at int")
    out = {r["at"]: (r.reserved, r.refused) for r in steps.reservations(long, "s", "at", 900).collect()}
    assert out[0] == (900, None) and out[4] == (400, None) and out[5] == (None, "completion_token_budget") and out[8] == (None, "model_call_budget")


def test_pacing(spark):
    import random

    from pyspark.sql import functions as F

    from marlstone.operators import crawl

    r = random.Random(2)
    rows = [(h, i, float(r.randint(0, 90))) for h in ("a", "b", None) for i in range(40)]
    got = {(x.host, x.n): x.starts for x in crawl.paced(spark.createDataFrame(rows, "host string, n int, at double"), "host", "at", "n", F.when(F.col("host") == "a", 2.0).when(F.col("host") == "b", 5.0)).collect()}
    for h, gap in (("a", 2), ("b", 5), (None, 0)):
        before = None
        for _, n, at in sorted((x for x in rows if x[0] == h), key=lambda x: (x[2], x[1])):
            before = at if before is None else max(at, before + gap)
            assert got[h, n] == before
