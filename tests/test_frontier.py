"""Crawls by joins and running sums against queues in plain Python."""

import random
from collections import deque

import pytest

from marlstone.functions import web
from marlstone.operators import frontier
from marlstone.operators.crawl import LIMITS
from marlstone.plans import crawling

DOCS = "url string, attempts int, bytes long, ok boolean, links array<struct<href:string,protocol:boolean>>"
SEEDS = "crawl long, ord long, url string, protocol boolean"


def queue(docs, seeds, limits):
    """Rows of one crawl and its usage, by two queues."""
    docs = {d[0]: d[1:] for d in docs}
    seen, rows, queues = set(), {}, {True: deque(), False: deque()}
    used = {"attempts": 0, "bytes": 0, True: 0, False: 0}
    stopped, reasons, visit = False, set(), 0
    room = {True: ("protocol_documents", "protocol_document_limit"), False: ("pages", "html_page_limit")}

    def put(url, parent, protocol, depth):
        if url is not None and url not in seen:
            seen.add(url)
            queues[protocol].append(url)
            rows[url] = [url, parent, protocol, depth, None, "not attempted", 0, 0, False]

    def read(protocol):
        nonlocal stopped, visit
        row = rows[queues[protocol].popleft()]
        used[protocol] += 1
        visit += 1
        attempts, size, ok, links = docs.get(row[0], (1, 0, False, None))
        attempts, size, links = 1 if attempts is None else attempts, size or 0, links or []
        row[4] = visit
        if used["attempts"] + attempts > limits["attempts"]:
            row[5:8] = "stopped: attempts", limits["attempts"] - used["attempts"], 0
            reasons.add("http_attempt_limit")
            stopped = True
        elif used["bytes"] + size > limits["bytes"]:
            row[5:8] = "stopped: bytes", attempts, limits["bytes"] - used["bytes"]
            reasons.add("response_body_limit")
            stopped = True
        else:
            row[5:8] = "read" if ok else "failed", attempts, size
        used["attempts"] += row[6]
        used["bytes"] += row[7]
        if row[5] == "read":
            if row[3] >= limits["depth"] and links:
                row[8] = True
                reasons.add("depth_limit")
            elif row[3] < limits["depth"]:
                for href, p in links:
                    put(href, row[0], bool(p), row[3] + 1)

    def full(protocol):
        name, reason = room[protocol]
        if used[protocol] >= limits[name]:
            reasons.add(reason)
            return True
        return False

    def protocols():
        while queues[True] and not stopped:
            if full(True):
                return
            read(True)

    for _, url, protocol in sorted(seeds):
        put(url, None, protocol, 0)
    protocols()
    while queues[False] and not stopped and not full(False):
        read(False)
        protocols()
    return sorted(map(tuple, rows.values())), (used["attempts"], used["bytes"], used[True], used[False], reasons)


def check(spark, docs, seeds, limits):
    out = frontier.crawled(spark.createDataFrame(docs, DOCS), spark.createDataFrame(seeds, SEEDS), limits).cache()
    rows, usage = {}, {r.crawl: r for r in frontier.usage(out, limits).collect()}
    for r in out.collect():
        rows.setdefault(r.crawl, []).append(tuple(r[1:]))
    want = {}
    for c in {s[0] for s in seeds if s[2] is not None}:
        want[c] = queue(docs, [s[1:] for s in seeds if s[0] == c], {**LIMITS, **limits})
    assert set(rows) == set(want)
    for c, (w, u) in want.items():
        assert sorted(rows[c], key=lambda r: r[0]) == w, c
        assert (*usage[c][1:5], set(usage[c].reasons)) == u, c


@pytest.mark.parametrize("limits", [{}, {"bytes": 900, "protocol_documents": 3, "pages": 6}, {"attempts": 9, "depth": 3}, {"depth": 0}])
def test_equals_two_queues(spark, limits):
    rng = random.Random(len(limits))
    name = lambda: f"u{rng.randrange(150)}"
    docs = [(f"u{i}", rng.choice([1, 1, 2, 5]), rng.randrange(200), rng.random() < 0.85, [(rng.choice([name(), name(), "u0", None]), rng.random() < 0.2) for _ in range(rng.choice([0, 1, 3, 8, 40]))]) for i in range(120)]
    docs += [("u130", None, None, True, None)]
    seeds = [(c, i, name(), rng.random() < 0.3) for c in range(15) for i in range(rng.choice([1, 4, 8]))] + [(99, 0, "u130", False), (99, 1, "u130", False), (98, 0, "nowhere", True), (97, 0, None, False)]
    seeds = [(c, i, u, p) for c, i, u, p in seeds]
    check(spark, docs, seeds, limits)


def test_query_equals_two_queues_on_pages(spark):
    d = "/root/testdata/sf0.001"
    docs, seeds = crawling.page_graph(spark, d)
    docs = [(r.url, r.attempts, r.bytes, r.ok, [tuple(x) for x in r.links]) for r in docs.collect()]
    seeds = list(map(tuple, seeds.collect()))
    got = {}
    for r in crawling.crawl_budgets(spark, d).collect():
        got.setdefault(r.crawl, []).append(tuple(r[1:]))
    for c in {s[0] for s in seeds}:
        assert sorted(got[c], key=lambda r: r[0]) == queue(docs, [s[1:] for s in seeds if s[0] == c], {**LIMITS, **crawling.CRAWL_LIMITS})[0]


def test_no_seeds(spark):
    out = frontier.crawled(spark.createDataFrame([], DOCS), spark.createDataFrame([], SEEDS))
    assert out.count() == 0 and frontier.usage(out).count() == 0


def test_links_of_a_page(spark):
    html = "<a href='/a'>x</a><link rel='stylesheet' href='/s'><link rel='alternate' type='application/rss+xml; q' href='/f'>" + "".join(f"<a href='/{i}'></a>" for i in range(200)) + "<link rel='x SITEMAP' href='/m'>"
    df = web.pages(spark.createDataFrame([(html,), ("",), (None,)], "html string"))
    got = [r[0] for r in df.select(frontier.page_links(df.links)).collect()]
    assert [tuple(x) for x in got[0][:4]] == [("/f", True), ("/m", True), ("/a", False), ("/0", False)] and len(got[0]) == 96 and got[1:] == [[], []]
