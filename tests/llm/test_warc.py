import hashlib
import io
import zipfile

import pytest

from marlstone.llm import warc


def test_package_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(warc._Forward(raw), "w", zipfile.ZIP_STORED) as z:
        with z.open(warc.DATA, "w", force_zip64=True) as f:
            f.write(b"some bytes")
        with z.open("other", "w") as f:
            f.write(b"PK\x05\x06 not the end")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = raw.getvalue()
    p = warc.Package(lambda a, n: data[a : a + n], len(data))
    at, n = p.stored(warc.DATA)
    assert data[at : at + n] == b"some bytes" and set(p.members) == {warc.DATA, "other", "packed"}
    with pytest.raises(ValueError):
        p.stored("packed")
    with pytest.raises(ValueError):
        warc.Package(lambda a, n: b"", 0)


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(5):
            z.writestr(f"m{i}", f"content {i}")
    data = raw.getvalue()
    assert b"PK\x06\x06" in data
    p = warc.Package(lambda a, n: data[a : a + n], len(data))
    assert [data[a : a + n] for a, n in (p.stored(f"m{i}") for i in range(5))] == [f"content {i}".encode() for i in range(5)]


def test_round_trip(spark, tmp_path):
    big, odd = "é<p>" * 40, "short"
    rows = [(7, "u7", big, "x"), (3, "u 3\n", big, "x"), (3, "again", big, "x"), (None, None, big, "x"), (4, "u4", odd, "x"), (5, "u5", odd, "x"), (6, None, None, "x"), (8, "u8", "", "x"), (9, "u9", "a\r\n\r\nb" * 200000, "x"), (None, "n", "only null " * 20, "x"), (None, "n", "only null " * 20, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    done = warc.archive(df, str(tmp_path / "a"))
    assert sum(r.records for r in done.collect()) == len(rows) and not [p for p in (tmp_path / "a").iterdir() if not p.name.endswith(".wacz")]
    got = warc.read(warc.entries(done), payloads=True).collect()
    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None) for i, _, h, _ in rows)
    assert sorted((str(r.page_id), r["size"], r.digest, r.type, r.refers_to) for r in got) == want
    assert all((r.payload is None) == (r.type == "revisit") for r in got)
    assert {r.url for r in got} >= {"u%203%0A", "u7"}
    assert warc.read(warc.entries(warc.archive(df.limit(0), str(tmp_path / "b")))).count() == 0


def test_table(spark):
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    first = {}
    for p in pages:
        first[p.html] = min(p.page_id, first.get(p.html, p.page_id))
    for r in warc.op6_warc(spark, d).collect():
        html = next(p.html for p in pages if p.page_id == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        same = first[html] == r.page_id or r.payload_bytes < 100
        assert (r.record_type, r.refers_to) == (("response", None) if same else ("revisit", first[html]))
