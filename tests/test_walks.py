"""Walks, edges and reserved places against brute force."""

import random

from pyspark.sql import functions as F

from marlstone.operators import walks


def queue(pages, starts, most):
    seen, todo = [], list(starts)
    while todo and len(seen) < most:
        p = todo.pop(0)
        if p in seen:
            continue
        seen.append(p)
        status, links = pages.get(p, (404, []))
        todo += [x for x in (links or []) if x is not None] if status == 200 else []
    return [(p, i) for i, p in enumerate(seen) if p in pages]


def test_first_in_first_out(spark):
    r = random.Random(3)
    for most in (1, 5, 12, 80):
        pages = {f"p{i}": (200 if r.random() < 0.8 else 500, r.choice([None, [], [r.choice([None, *(f"p{j}" for j in range(40))]) for _ in range(3)]]) if i else [f"p{j}" for j in (3, 1, 4, 1, 5, 99)]) for i in range(30)}
        df = spark.createDataFrame([(p, s, x) for p, (s, x) in pages.items()], "path string, status int, links array<string>")
        got = sorted((x.path, x.visit) for x in walks.first_in_first_out(df, ["p0", "p7", "p0"], most).collect())
        assert got == sorted(queue(pages, ["p0", "p7"], most))
    none = df.where("false")
    assert walks.first_in_first_out(none, ["p0"]).count() == walks.first_in_first_out(df, []).count() == 0


def months(rows, n, pages):
    seen, out = set(), []
    for m in range(n):
        for p in range(1, pages + 1):
            new = []
            for _, _, o, i in sorted(x for x in rows if x[:2] == (m, p) and x[3] is not None):
                if i not in seen:
                    seen.add(i)
                    new.append((m, p, o, i))
            out += new
            if not new:
                break
    return out


def test_month_views(spark):
    r = random.Random(5)
    for wide in (6, 20, 60):
        rows = [(m, p, o, r.choice([None, *range(wide)])) for m in range(4) for p in range(1, 9) for o in range(3)]
        df = spark.createDataFrame(rows, "month int, page int, ord int, id int").withColumn("extra", F.lit(1))
        assert sorted(tuple(x) for x in walks.month_views(df).select("month", "page", "ord", "id").collect()) == sorted(months(rows, 3, 6))
    assert walks.month_views(df.where("false")).count() == 0


def places(steps, seeds, most):
    n = done = 0
    out = []
    for at, seed, candidate, outcome in sorted(steps):
        done += bool(outcome)
        limit = most if seed else max(most - max(seeds - done, 0), 0)
        stored = n < limit if candidate else None
        n += bool(stored)
        out.append((at, stored))
    return out


def test_slots(spark):
    r = random.Random(7)
    steps = {c: [(i, r.random() < 0.2, r.choice([True, True, None]), r.random() < 0.15) for i in range(r.randint(1, 60))] for c in range(12)}
    df = spark.createDataFrame([(c, *s) for c, x in steps.items() for s in x], "crawl int, at2 int, seed boolean, candidate boolean, outcome boolean")
    got = sorted(tuple(x) for x in walks.slots(df, "crawl", "at2", 4, 10).select("crawl", "at2", "stored").collect())
    want = sorted((c, at, s) for c, x in steps.items() for at, s in places([(a, b, bool(k), o) for a, b, k, o in x], 4, 10))
    assert got == want
    assert walks.slots(df.where("false"), "crawl", "at2", 4).count() == 0


def listing(rows, foot, today, run):
    past, out = 0, []
    for page in range(1, 26):
        for start, i in rows.get(page, []):
            if start is None:
                continue
            if start < today:
                past += 1
                if past >= run:
                    return out
                continue
            past = 0
            out.append(i)
        nxt, total = foot.get(page, (0, 0))
        if page >= 2 and (not rows.get(page) or total > 0 and page >= total or 0 < nxt <= page):
            return out
    return out


def test_listing_rows(spark):
    r = random.Random(11)
    for _ in range(6):
        rows = {p: [(r.choice([None, 1, 9, 9, 9]), 10 * p + j) for j in range(r.choice([0, 3, 4, 5]))] for p in range(1, 28)}
        foot = {p: (r.choice([0, p + 1, p + 1, p + 1, p]), r.choice([0, 20])) for p in rows}
        df = spark.createDataFrame([("a", p, i, s) for p, x in rows.items() for s, i in x], "listing string, page int, ord int, start int")
        ends = spark.createDataFrame([("a", p, len(rows[p]), *foot[p]) for p in rows], "listing string, page int, rows int, next int, total int")
        got = walks.listing_rows(df, ends, "listing", ["ord"], F.col("start") < 5, 3).where("start >= 5")
        assert sorted(x.ord for x in got.collect()) == sorted(listing(rows, foot, 5, 3))


def test_columns(spark):
    got = spark.range(1).select(
        walks.link_headers_within(F.array(*[F.lit("a")] * 17)).alias("many"), F.size(walks.link_headers_within(F.lit(None).cast("array<string>"))).alias("none"), walks.link_headers_within(F.array(F.lit("é" * 4097))).alias("large"),
        walks.waits(F.array(F.lit(503))).alias("one"), walks.waits(F.array(F.lit(429), F.lit(500), F.lit(503))).alias("all"), walks.waits(F.array(F.lit(404), F.lit(500))).alias("stop"),
    ).first()
    assert (got.many, got.none, got.large) == (None, 0, None)
    assert (list(got.one), list(got["all"]), list(got.stop)) == ([], [500, 1000], [])


def test_edges(spark):
    docs = spark.createDataFrame([("i", "sitemap_index", 0, [("c", None)]), ("h", "html", 1, [("f", "feed"), (None, "html"), ("x", None)]), ("n", "html", 0, None)], "url string, route string, depth int, links array<struct<url:string,kind:string>>")
    got = sorted(tuple(x) for x in walks.edges(docs).collect())
    assert got == [("h", "f", "feed", 2, False), ("h", "x", "auto", 2, True), ("i", "c", "sitemap", 1, False)]
