"""Page parsers of the sources: one page in, one raw record out, and a dead letter where that fails.

A parser is a table of rules over the element tree. Absent fields stay null, texts stay as they stand; dates, vocabulary
and validity are the normaliser's business.
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import web
from marlstone.functions.batches import pieces
from marlstone.operators.sequence import first_seen
from marlstone.sources.dom import Node, tree

FIELDS = ("source_id", "event_id", "name", "name_ko", "name_en", "start_raw", "end_raw", "venue_name", "hall", "city", "organizer", "host", "publisher", "source_type", "homepage_url", "summary_text", "classify_text")
SCHEMA = "url string, " + ", ".join(f"{f} string" for f in FIELDS) + ", error string"

#: Patterns of dates and schedule labels in free text, and of event nouns in titles.
BODY_DATE = re.compile(r"20\d{2}년\s?\d{1,2}월\s?\d{1,2}일|20\d{2}-\d{2}-\d{2}|20\d{2}\.\d{1,2}\.\d{1,2}")
DATE_LABEL = re.compile("일시|일정|기간|개최일")
ORGANIZER = re.compile(r"^\[([^\[\]]{1,40})\]")
RANGE = re.compile(r"(20\d{2}-\d{2}-\d{2})\s*~\s*(20\d{2}-\d{2}-\d{2})")


def period(text: str, *marks: str) -> tuple[str | None, str | None]:
    """Start and end of a period; a single date is both."""
    text = text.strip()
    for m in marks:
        if m in text:
            a, b = text.split(m, 1)
            return a.strip() or None, b.strip() or None
    return text or None, text or None


def event_dates(body: str) -> tuple[str | None, str | None]:
    """The dates of a labelled line, or of the only line that has any; dates on several lines say nothing."""
    dated = [(bool(DATE_LABEL.search(x)), found[:2]) for x in body.split("\n") if (found := BODY_DATE.findall(x))]
    labelled = [d for said, d in dated if said]
    pick = labelled[0] if labelled else dated[0][1] if len(dated) == 1 else []
    return (pick[0] if pick else None), (pick[1] if len(pick) > 1 else None)


def _line(doc: Node, selector: str) -> str:
    n = doc.first(selector)
    return n.line() if n else ""


def _href(doc: Node, selector: str) -> str | None:
    n = doc.first(selector)
    return (n.attrs.get("href", "").strip() or None) if n else None


def _query(url: str, key: str) -> str | None:
    return (urllib.parse.parse_qs(urllib.parse.urlsplit(url).query).get(key) or [None])[0]


def _pick(rows: dict[str, str], *labels: str) -> str:
    return next((rows[x] for x in labels if rows.get(x)), "")


def _join(*parts: str | None) -> str:
    return " ".join(p.strip() for p in parts if p and p.strip())


def coex(url: str, doc: Node) -> dict:
    og = doc.first('meta[property="og:title"]')
    name = _line(doc, "h2.SingleTitle") or (og.attrs.get("content", "").strip() if og else "")
    if not name:
        raise ValueError("no event name")
    rows = {}
    for item in doc.all(".EventDetailBoxBody-item"):
        value = _join(*[v.line() for v in item.all(".EventDetailBoxBodyText-txt")])
        if (label := _line(item, ".EventDetailBoxBodyTitle")) and value:
            rows[label] = value
    halls = [_join(*[p.line() for p in item.walk() if p.matches(".EventPlaceItemTitle-txt") or p.matches(".EventPlaceItemTitle-tit")]) for item in doc.all(".EventPlaceItem .EventPlaceItemTitle-item")]
    start, end = period(_line(doc, "p.EventDetailBoxHeader-date"), " - ", "-")
    slug = urllib.parse.urlsplit(url).path.strip("/").rpartition("/")[2]
    return {
        "event_id": f"coex-{slug}" if slug else None, "name": name, "venue_name": "COEX", "city": "Seoul", "start_raw": start, "end_raw": end, "hall": ", ".join(h for h in halls if h),
        "organizer": rows.get("주최"), "host": rows.get("주관"), "summary_text": _pick(rows, "행사소개", "전시소개", "전시품목"), "homepage_url": _href(doc, "a.EventDetailThumbLink-link.url"),
        "classify_text": _join(name, rows.get("주최"), rows.get("주관"), rows.get("전시품목")),
    }


def kintex(url: str, doc: Node) -> dict:
    got: dict = {"event_id": f"kintex-{_query(url, 'seq') or url}", "name": _line(doc, "h3"), "venue_name": "KINTEX", "city": "Goyang"}
    for li in doc.all("ul.view-info-list > li"):
        label, info = _line(li, ".title").replace(" ", ""), li.first(".info")
        if info is None:
            continue
        if label == "기간":
            got["start_raw"], got["end_raw"] = period(info.line(), "~")
        elif label == "주최":
            got["organizer"] = info.line()
        elif label == "장소":
            got["hall"] = info.line((".btn-table-info",))
    rows = {}
    for th in doc.all('div.read-table th[scope="row"]'):
        td = th.next()
        if td is not None:
            rows[th.line()] = td.line()
            if th.line() == "홈페이지":
                got["homepage_url"] = _href(td, "a[href]")
    summary = _pick(rows, "행사내용", "행사목적", "행사품목")
    return got | {"host": rows.get("주관사"), "summary_text": summary, "classify_text": _join(got["name"], got.get("organizer"), summary)}


def showala(url: str, doc: Node) -> dict:
    start, end = period(_line(doc, "li.date p.des"), "~")
    where = {_line(li, "p.tit"): _line(li, "p.des") for li in doc.all("li.where")}
    name, field = _line(doc, "li.kor_tit"), _line(doc, "li.ex_cate p.des")
    m = re.search(r"idx=(\d+)", url)
    organizer = _line(doc, "li.opener p.des")
    return {
        "event_id": f"showala-{m.group(1) if m else url}", "name": name, "name_ko": name, "name_en": _line(doc, "li.eng_tit"), "start_raw": start, "end_raw": end, "venue_name": where.get("개최장소"), "hall": where.get("세부장소"),
        "organizer": organizer, "host": _line(doc, "li.opener2 p.des"), "homepage_url": _href(doc, "li.homp a[href]"), "summary_text": field, "publisher": "SHOWALA", "source_type": "aggregator",
        "classify_text": _join(name, organizer, _line(doc, "li.work_cate p.des"), field),
    }


def aiia(url: str, doc: Node) -> dict:
    m, title = re.search(r"num=(\d+)", url), _line(doc, ".bbs_view .tit .left em")
    if not m or not title:
        raise ValueError("no post number" if not m else "empty title")
    body = doc.first("#DivContents")
    start, end = event_dates(body.text() if body else "")
    by = ORGANIZER.match(title)
    organizer = by.group(1).strip() if by else None
    return {"event_id": f"aiia-{m.group(1)}", "name": title, "organizer": organizer, "start_raw": start, "end_raw": end, "classify_text": _join(title, organizer)}


def akei(url: str, doc: Node) -> dict:
    """Telephone and mail rows are never read."""
    m = re.search(r"wr_id=(\d+)", url)
    rows = {}
    for tr in doc.all(".bbs_schedule_view table tr"):
        th, td = tr.first("th"), tr.first("td")
        if th is not None and td is not None and td.text().strip():
            rows["".join(th.text().split())] = td.text().strip()
    name = rows.get("전시회명(한글)")
    if not m or not name:
        raise ValueError("no record number" if not m else "empty name")
    raw = rows.get("기간", "")
    dates = RANGE.search(raw)
    return {
        "event_id": f"akei-{m.group(1)}", "name": name, "name_en": rows.get("전시회명(영문)"), "organizer": rows.get("주최"), "venue_name": rows.get("장소"), "start_raw": dates.group(1) if dates else raw, "end_raw": dates.group(2) if dates else None,
        "homepage_url": rows.get("홈페이지"), "source_type": "aggregator", "classify_text": _join(name, rows.get("전시회명(영문)"), rows.get("전시분야"), rows.get("세부품목"), rows.get("주최")),
    }


PARSERS: dict[str, Callable[[str, Node], dict]] = {"coex": coex, "kintex": kintex, "showala": showala, "aiia": aiia, "akei": akei}


def parse_one(source: str, url: str, html: str | None) -> dict:
    """A raw record, or the error that stands for it; a broken page never stops the others."""
    try:
        got = PARSERS[source](url or "", tree(html))
        return {"url": url, **{f: got.get(f) or None for f in FIELDS}, "source_id": source, "error": None}
    except Exception as e:  # every failure becomes a dead letter with its reason
        return {"url": url, **dict.fromkeys(FIELDS), "source_id": source, "error": f"{type(e).__name__}: {e}"}


def parse(pages: DataFrame, source: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of a source's pages; `error` is null for good ones. A few pages are parsed at a time."""

    def run(frames):
        import pyarrow as pa

        for b in pieces(frames, html_col):
            text = b.column(1).type
            got = [parse_one(source, u.as_py(), h.as_py()) for u, h in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(got, pa.schema([(f, text) for f in ("url", *FIELDS, "error")]))

    return pages.select(url_col, html_col).mapInArrow(run, SCHEMA)


def showala_rows(html: str | None) -> tuple[list[dict], int, int]:
    """(idx, venue, start) of each listing row, and the fragment's next and total page (0 without a trailer)."""
    m = re.search(r":::(\d+):::(\d+)\s*$", html or "")
    doc, rows = tree((html or "")[: m.start()] if m else html), []
    for li in doc.all("li.ex_item"):
        date, place = li.first("div.ex_date"), li.first("div.ex_place")
        found = re.search(r"idx=(\d+)", (li.first("a.ex_tit_a") or Node("", {}, None)).attrs.get("href", ""))
        rows.append({"idx": found.group(1) if found else "", "venue": place.line(("span",)) if place else "", "start": period(date.line(("span",)), "~")[0] if date else None})
    return rows, int(m.group(1)) if m else 0, int(m.group(2)) if m else 0


#: What names an event among a board's posts, and the venue that an aggregator's rows are kept for.
EVENT_TITLE = "(?i)행사|세미나|컨퍼런스|콘퍼런스|설명회|교류회|포럼|박람회|전시회|데모데이|성과공유회|tech[- ]?day|밋업|meetup"
KINTEX = "(?i)kintex|킨텍스"


def board_refs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, event_id, title, ord) of the posts of each board page that name an event; of a repeated post the first counts."""
    links = web.pages(pages.select(key, html), html).select(key, F.explode("links").alias("l")).where("l.tag = 'a'")
    posts = links.select(key, F.col("l.ord").alias("ord"), F.regexp_extract("l.href", r"mode=VIEW&(?:amp;)?num=(\d+)", 1).alias("num"), F.col("l.text").alias("title"))
    named = posts.where((F.col("num") != "") & (F.col("title") != "") & F.regexp_like("title", F.lit(EVENT_TITLE)))
    return first_seen(named, [key, "num"], ["ord", "title"]).select(key, F.concat(F.lit("aiia-"), F.col("num")).alias("event_id"), "title", "ord")


def at_kintex(venue: Column) -> Column:
    return F.regexp_like(F.coalesce(venue, F.lit("")), F.lit(KINTEX))


def listing(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, idx, venue, start, next, total) of each row of an aggregator's listing pages; a page without rows gives none.
    A few pages are parsed at a time."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames):
        import pyarrow as pa

        for b in pieces(frames, html):
            rows = [(i, r["idx"], r["venue"], r["start"], following, total, n) for n, h in enumerate(b.column(1)) for got, following, total in [showala_rows(h.as_py())] for i, r in enumerate(got)]
            if rows:
                *cols, at = zip(*rows, strict=True)
                text, whole = b.column(1).type, pa.int32()
                held = [pa.array(c, t) for c, t in zip(cols, (whole, text, text, text, whole, whole), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *held], names=[key, "ord", "idx", "venue", "start", "next", "total"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, ord int, idx string, venue string, start string, next int, total int")
