"""Connectors: gaps, circles, pushed filters, streams that go on after a restart."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions.web import unpacked
from marlstone.sources import connector, venues
from marlstone.sources.files import write_bodies
from marlstone.streaming import ingest


def page(folder, n, refs, to=()):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / f"page-{n}.html").write_text("".join(f"fnView('./view.do', {r})" for r in refs) + "".join(f"fnPaging( '{t}' )" for t in to))


def test_walk_follows_what_pages_name(spark, tmp_path):
    connector.register(spark)
    page(tmp_path / "a", 1, [1, 2, 2], [3, 60, 0])
    page(tmp_path / "a", 3, [2, 3], [1, 2])
    page(tmp_path / "a", 2, [4, 1])
    page(tmp_path / "a", 9, [99])
    page(tmp_path / "b", 1, [7])
    read = lambda: spark.read.format("listing_walk").option("path", str(tmp_path)).load()
    got = sorted((r.listing, r.page, r.ref) for r in read().collect())
    assert got == [("a", 1, "1"), ("a", 1, "2"), ("a", 2, "4"), ("a", 3, "3"), ("b", 1, "7")]
    page(tmp_path / "c", 1, [8], [2])
    assert [r.ref for r in read().where("listing = 'b'").collect()] == ["7"]  # c is never opened
    assert read().where("listing IN ('a', 'b')").count() == 5
    with pytest.raises(Exception, match="page-2"):
        read().count()
    assert spark.read.format("listing_walk").option("path", str(tmp_path / "nowhere")).load().count() == 0


def test_feed_follows_cursors(spark, tmp_path):
    connector.register(spark)

    def write(feed, name, data, cursor):
        (tmp_path / feed).mkdir(exist_ok=True)
        (tmp_path / feed / f"{name}.json").write_text(json.dumps({"data": data, "page": {"next_cursor": cursor}}))

    write("a", "first", [{"id": 1}, {"id": 2}], "x")
    write("a", "x", None, "y")
    write("a", "y", [{"id": 3}], "")
    read = lambda **o: spark.read.format("feed").options(path=str(tmp_path), **o).load()
    ids = lambda df: sorted(json.loads(r.event)["id"] for r in df.collect())
    assert ids(read()) == [1, 2, 3] and ids(read(max="2")) == [1, 2] and ids(read(max="0")) == []
    write("b", "first", [{"id": 4}], "gone")
    assert ids(read().where("feed = 'a'")) == [1, 2, 3]
    with pytest.raises(Exception, match="gone"):
        read().count()
    write("b", "gone", [], "first")
    with pytest.raises(Exception, match="twice"):
        read().count()


def test_stream_goes_on_where_it_was(spark, tmp_path):
    connector.register(spark)
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    drain = lambda: ingest.append_once(spark.readStream.format("listing").option("path", str(source)).load(), sink, checkpoint)
    rows = lambda: sorted((r.page, r.ref) for r in spark.read.schema("page int, ord int, ref string").parquet(sink).collect())
    page(source, 1, [1, 2])
    page(source, 2, [3])
    drain()
    assert rows() == [(1, "1"), (1, "2"), (2, "3")]
    page(source, 3, [4])
    drain()
    drain()
    assert rows() == [(1, "1"), (1, "2"), (2, "3"), (3, "4")]
    page(source, 5, [5])
    with pytest.raises(Exception, match="page 4 of 5"):
        drain()


def test_written_bodies(spark, tmp_path):
    df = spark.createDataFrame([("a/x.html", "é"), ("a/y.html", None)], "f string, b string")
    assert write_bodies(df, str(tmp_path), "f", "b") == 2 and write_bodies(df.limit(0), str(tmp_path), "f", "b") == 0
    assert (tmp_path / "a/x.html").read_text() == "é" and sorted(p.name for p in (tmp_path / "a").iterdir()) == ["x.html", "y.html"]


def test_listing_rows_and_boards(spark):
    html = '<li class="ex_item"><a class="ex_tit_a" href="?idx=5">x</a><div class="ex_date"><span>d</span>2026-01-01 ~ 2026-01-02</div><div class="ex_place">Kintex 2</div></li><li class="ex_item"></li>:::2:::3'
    df = spark.createDataFrame([(1, html), (2, ":::1:::1"), (3, None)], "k int, h string")
    got = [tuple(r) for r in venues.listing(df, "k", "h").withColumn("here", venues.at_kintex(F.col("venue"))).collect()]
    assert got == [(1, 0, "5", "Kintex 2", "2026-01-01", 2, 3, True), (1, 1, "", "", None, 2, 3, False)]
    board = '<a href="?mode=VIEW&num=1">채용 모집</a><a href="?mode=VIEW&num=1">AI 포럼</a><a href="?mode=VIEW&num=1">AI 포럼 2</a><a href="?mode=VIEW">meetup</a>'
    assert [(r.event_id, r.title) for r in venues.board_refs(spark.createDataFrame([(1, board), (2, None)], "k int, h string"), "k", "h").collect()] == [("aiia-1", "AI 포럼")]


def test_unpacked_bodies(spark):
    import gzip

    rows = [(b"abc", None), (gzip.compress(b"x" * 100), "utf-8"), (gzip.compress(b"x" * 101), "utf-8"), ("é".encode("latin-1"), "latin-1"), (b"a", "none"), (b"\x1f\x8bbroken", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary, c string").select(unpacked(F.col("b"), F.col("c"), 100)).collect()]
    assert got == ["abc", "x" * 100, None, "é", None, None, ""]


def test_unpacked_empty_bodies_and_signatures(spark):
    """An unknown charset is null for an empty body too; U+1F8B in UTF-16 is no gzip where the caller says so."""
    import gzip

    zipped, greek = gzip.compress(b"a"), "\u1f8bx".encode("utf-16-be")
    rows = [(None, "x-none", None), (b"", "x-none", None), (gzip.compress(b""), "x-none", None), (b"", "hex", False), (None, None, None), (b"", "utf-16-be", False), (gzip.compress(b""), None, True)]
    rows += [(greek, "utf-16-be", False), (greek, "utf-16-be", None), (zipped, None, None), (zipped, None, True), (zipped, "latin-1", False), (b"abc", None, True)]
    df = spark.createDataFrame(rows, "b binary, c string, p boolean")
    got = [r[0] for r in df.select(unpacked(F.col("b"), F.col("c"), 100, F.col("p"))).collect()]
    assert got == [None, None, None, None, "", "", "", "\u1f8bx", None, "a", "a", zipped.decode("latin-1"), None]


def test_response_bodies_of_odd_texts(spark, tmp_path):
    """Null, empty, of a gzip signature in UTF-16 and about the 3,000 bytes: what the SQL gives."""
    import duckdb

    from marlstone import catalog

    texts = [None, "", "\u1f8b", "\u1f8b\u0800 x", "\0", "\ufeffx", *(c * (3000 // n + more) for c, n in (("a", 1), ("é", 2), ("한", 3), ("한", 2), ("\U0001f600", 4)) for more in (0, 1))]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)] + [(-1, ""), (None, "\u1f8b"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["response_bodies"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(catalog.oracle_sql()["response_bodies"]).fetchall(), key=repr)


def test_steps_on_few_texts_at_a_time(spark, monkeypatch, tmp_path):
    """Listings, records and files are made piece by piece, with the same rows as in one."""
    from marlstone.functions import batches
    from marlstone.sources import files

    before = batches.pieces
    for module in (venues, files):
        monkeypatch.setattr(module, "pieces", lambda frames, column: before(frames, column, 40, 2))
    one = '<li class="ex_item"><a class="ex_tit_a" href="?idx={}">x</a></li>'
    df = spark.createDataFrame([(k, "".join(one.format(10 * k + i) for i in range(k))) for k in range(6)], "k long, h string").coalesce(1)
    got = [(r.k, r.ord, r.idx) for r in venues.listing(df, "k", "h").collect()]
    assert sorted(got) == [(k, i, str(10 * k + i)) for k in range(6) for i in range(k)]
    assert write_bodies(df.selectExpr("concat('p', k) AS f", "h"), str(tmp_path), "f", "h") == 6 and len(list(tmp_path.iterdir())) == 6


def test_partitions_of_a_long_listing_are_bounded():
    for pages in (1, 8, 9, 2048, 2049, 540_000):
        parts = connector.ListingReader({"path": "x", "pages": str(pages)}).partitions()
        stream = connector.ListingStream({"path": "x"}).partitions({"page": 0}, {"page": pages})
        assert parts == stream and len(parts) <= 256 and [n for p in parts for n in (p.first, p.last)][0] == 1
        assert sum(p.last - p.first + 1 for p in parts) == pages and all(a.last + 1 == b.first for a, b in zip(parts, parts[1:]))
    assert len(connector.ListingReader({"path": "x", "pages": "20", "pagesPerPartition": "2"}).partitions()) == 10


def test_written_texts_reach_the_tasks_in_small_batches(spark, monkeypatch, tmp_path):
    """30 MB of texts in one partition, of which no task is handed more than a little at once; the session's setting stays."""
    from marlstone.sources import files

    def small(frames, column):
        for b in frames:
            assert b.nbytes <= 2 << 20, f"a batch of {b.nbytes} bytes"
            yield b

    monkeypatch.setattr(files, "pieces", small)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    df = spark.range(0, 300, 1, 1).selectExpr("concat('p', id) AS f", "repeat('é', 50000 + id) AS b")
    assert write_bodies(df, str(tmp_path), "f", "b") == 300 and spark.conf.get(key) == before
    assert [(tmp_path / f"p{i}").stat().st_size for i in range(300)] == [2 * (50000 + i) for i in range(300)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        write_bodies(df.selectExpr("f", "concat(b, 1 / (length(b) - length(b))) AS b"), str(tmp_path), "f", "b")
    assert spark.conf.get(key) == before
