"""Parsers for what the web serves: HTML links and text, robots rules, Link headers, feeds, sitemaps, model output."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.batches import pieces

LINKS = "array<struct<ord:int,tag:string,href:string,rel:string,type:string,text:string>>"


class _Page(HTMLParser):
    """Title, text without scripts and styles, and links in page order."""

    SKIP = ("script", "style", "noscript", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links = [], [], []
        self.skip, self.in_title, self.open = 0, False, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and a.get("href") is not None:
            self.open = len(self.links)
            self.links.append([tag, a["href"], (a.get("rel") or "").lower(), "", []])
        elif tag == "link" and a.get("href") is not None:
            self.links.append([tag, a["href"], (a.get("rel") or "").lower(), (a.get("type") or "").lower(), []])
        self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self.open = None
        self.text.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.text.append(data)
            if self.open is not None:
                self.links[self.open][4].append(data)


def only(html: str, references: tuple[str, ...]) -> str:
    """The page with every ampersand escaped that doesn't begin one of these named references, semicolon included."""
    return re.sub(f"&(?!(?:{'|'.join(references)});)", "&amp;", html)


def read_page(html: str | None, references: tuple[str, ...] | None = None) -> tuple[str, str, list[dict]]:
    p = _Page()
    p.feed(only(html or "", references) if references else html or "")
    p.close()
    links = [{"ord": i, "tag": g, "href": h, "rel": r, "type": t, "text": " ".join("".join(x).split())} for i, (g, h, r, t, x) in enumerate(p.links)]
    return " ".join("".join(p.title).split()), " ".join("".join(p.text).split()), links


def pages(df: DataFrame, html_col: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with title, body and links in place of the page's source; parsed in Arrow batches, a few pages at a time.

    references: names of the character references that are read, with their semicolon; by default all, as browsers do, which
    read old ones such as `&amp` without it too.
    """
    keep = [f for f in df.schema.fields if f.name != html_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "title string", "body string", f"links {LINKS}"])

    def run(frames):
        for b in pieces(frames, html_col):
            html = b.column(b.schema.get_field_index(html_col))
            text = html.type
            links = pa.list_(pa.struct([("ord", pa.int32()), *((f, text) for f in ("tag", "href", "rel", "type", "text"))]))
            got = [read_page(h.as_py(), references) for h in html]
            parsed = [pa.array([g[i] for g in got], t) for i, t in enumerate((text, text, links))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keep), *parsed], names=[*(f.name for f in keep), "title", "body", "links"])

    return df.mapInArrow(run, schema)


def last_json_object(text: str | None) -> str | None:
    """The last balanced {...} of a text, braces in strings aside."""
    best, depth, start, quoted, escaped = None, 0, 0, False, False
    for i, c in enumerate(text or ""):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                best = text[start : i + 1]
    return best


def last_object(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(last_json_object)

    return run(c)


def strict_object(text: str | None, keys: tuple[str, ...]) -> str | None:
    """The last object if it parses and has no key beyond `keys`."""
    raw = last_json_object(text)
    try:
        got = json.loads(raw) if raw else None
    except ValueError:
        return None
    return raw if isinstance(got, dict) and set(got) <= set(keys) else None


def robots_rules(body: str | None, agent: str = "*") -> list[dict]:
    """(directive, value) of the group that names the agent, else of the common group; Sitemap lines of all."""
    groups, names, fresh, maps = [], [], True, []
    for line in (body or "").splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not fresh:
                names, fresh = [], True
            names.append(value.lower())
            groups.append((value.lower(), []))
        elif key in ("allow", "disallow", "crawl-delay"):
            fresh = False
            for g in groups[-len(names) :] if names else []:
                g[1].append({"directive": key, "value": value})
        elif key == "sitemap" and value:
            maps.append({"directive": "sitemap", "value": value})
    own = [r for n, rs in groups if n != "*" and n and n in agent.lower() for r in rs]
    named = any(n != "*" and n and n in agent.lower() for n, _ in groups)
    return (own if named else [r for n, rs in groups if n == "*" for r in rs]) + maps


def robots(c: Column, agent: str) -> Column:
    @F.pandas_udf("array<struct<directive:string,value:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: robots_rules(b, agent))

    return run(c)


def allows(rules: Column, path: Column) -> Column:
    """Longest matching prefix wins, a tie allows, an empty disallow counts for nothing."""
    p = F.when(path == "", "/").otherwise(path)

    def longest(kind: str) -> Column:
        hits = F.filter(rules, lambda r: (r["directive"] == kind) & ((r["value"] != "") | F.lit(kind == "allow")) & F.startswith(p, r["value"]))
        return F.coalesce(F.array_max(F.transform(hits, lambda r: F.length(r["value"]))), F.lit(-1))

    return (longest("disallow") == -1) | (longest("allow") >= longest("disallow"))


_LINK = re.compile(r'<([^>]*)>((?:\s*;\s*[A-Za-z*]+\s*=\s*(?:"(?:[^"\\]|\\.)*"|[^\s;,"]+))*)')
_PARAM = re.compile(r';\s*([A-Za-z*]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s;,"]+))')


def link_header(value: str | None) -> list[dict]:
    """(href, rel, type) of each link of an HTTP Link header."""
    out = []
    for m in _LINK.finditer(value or ""):
        params = {k.lower(): (q or v) for k, q, v in reversed(_PARAM.findall(m.group(2)))}
        out.append({"href": m.group(1), "rel": params.get("rel", "").lower(), "type": params.get("type", "").lower()})
    return out


def link_headers(c: Column) -> Column:
    @F.pandas_udf("array<struct<href:string,rel:string,type:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(link_header)

    return run(c)


def document_kind(rel: Column, kind: Column) -> Column:
    """What a link leads to, by the first telling word of its rel: sitemap, feed or page."""
    feed = F.trim(F.lower(F.substring_index(kind, ";", 1))).isin("application/rss+xml", "application/atom+xml", "application/feed+json", "application/json")
    words = F.split(F.trim(F.lower(rel)), r"\s+")
    sitemap, alternate = F.array_position(words, F.lit("sitemap")), F.array_position(words, F.lit("alternate"))
    is_feed = F.coalesce((alternate > 0) & feed, F.lit(False))
    return F.when((sitemap > 0) & ~(is_feed & (alternate < sitemap)), "sitemap").when(is_feed, "feed").otherwise("page")


def sitemap(xml: Column) -> Column:
    """struct<kind, locs> of a sitemap index or url set; null for anything else."""
    bare = F.regexp_replace(xml, r'\s+xmlns(:[A-Za-z]+)?="[^"]*"', "")
    index, urls = F.xpath(bare, F.lit("/sitemapindex/sitemap/loc/text()")), F.xpath(bare, F.lit("/urlset/url/loc/text()"))
    trimmed = lambda a: F.transform(a, lambda x: F.trim(x))
    return F.when(F.contains(xml, F.lit("<sitemapindex")), F.struct(F.lit("index").alias("kind"), trimmed(index).alias("locs"))).when(F.contains(xml, F.lit("<urlset")), F.struct(F.lit("urlset").alias("kind"), trimmed(urls).alias("locs")))


def feed(xml: Column) -> Column:
    """array<struct<title, link>> of an RSS or Atom feed; of several Atom links the alternate one, or one without rel."""
    bare = F.regexp_replace(xml, r'\s+xmlns(:[A-Za-z]+)?="[^"]*"', "")
    rss = F.arrays_zip(F.xpath(bare, F.lit("/rss/channel/item/title/text()")).alias("title"), F.xpath(bare, F.lit("/rss/channel/item/link/text()")).alias("link"))
    atom = F.arrays_zip(F.xpath(bare, F.lit("/feed/entry/title/text()")).alias("title"), F.xpath(bare, F.lit("/feed/entry/link[@rel='alternate' or not(@rel)][1]/@href")).alias("link"))
    return F.when(F.contains(xml, F.lit("<rss")), rss).when(F.contains(xml, F.lit("<feed")), atom)


def json_feed(text: Column) -> Column:
    """array<struct<title, link>> of a JSON feed of version 1 or 1.1."""
    f = F.from_json(text, "version STRING, items ARRAY<STRUCT<title:STRING,url:STRING,external_url:STRING>>")
    items = F.transform(f["items"], lambda i: F.struct(i["title"].alias("title"), F.coalesce(F.nullif(i["url"], F.lit("")), i["external_url"]).alias("link")))
    return F.when(F.regexp_like(f["version"], F.lit(r"^https://jsonfeed\.org/version/1(\.1)?$")), items)


def schema_event(block: Column) -> Column:
    """struct of the first Event of a JSON-LD block, alone or in its graph; type and location may be single or lists."""
    v = F.try_parse_json(block)
    own = F.when(F.contains(F.coalesce(F.to_json(F.try_variant_get(v, "$['@type']", "variant")), F.lit("")), F.lit("Event")), v)
    graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
    hit = F.filter(graph, lambda x: F.contains(F.coalesce(F.to_json(F.try_variant_get(x, "$['@type']", "variant")), F.lit("")), F.lit("Event")))
    e = F.coalesce(own, F.get(hit, F.lit(0)))
    get = lambda p: F.try_variant_get(e, p, "string")
    place = F.coalesce(get("$.location.name"), get("$.location[0].name"))
    return F.when(e.isNotNull(), F.struct(get("$.name").alias("name"), get("$.startDate").alias("start"), get("$.endDate").alias("end"), place.alias("venue"), get("$.url").alias("url")))


#: What an action's link says.
ACTIONS = {
    "register": ["사전등록", "등록하기", "관람등록", "참관등록", "registration", "register", "ticket"],
    "exhibit": ["전시참가", "부스", "exhibit", "exhibitor", "booth"],
    "sponsor": ["스폰서", "후원", "sponsor", "sponsorship"],
    "match": ["매치메이킹", "비즈니스 상담", "buyer meeting", "matchmaking"],
    "startup": ["스타트업", "startup", "pitch", "demo day"],
}
REGISTRATION_LABELS = ["참가 신청 마감", "등록 마감", "registration deadline"]
EXHIBITOR_LABELS = ["부스 신청 마감", "전시참가 마감", "exhibitor deadline"]


def action_of(text: Column) -> Column:
    """The first group of words that a link's lowered text or address holds."""
    from marlstone.functions.text import any_of

    out = None
    for k, words in ACTIONS.items():
        out = F.when(any_of(text, words), k) if out is None else out.when(any_of(text, words), k)
    return out



def preferred_format(accept: Column) -> Column:
    """markdown where an Accept header weighs it above JSON, else json."""

    def weight(kind: str) -> Column:
        parts = F.filter(F.split(F.lower(F.coalesce(accept, F.lit(""))), r"\s*,\s*"), lambda p: F.trim(F.substring_index(p, ";", 1)) == kind)
        q = F.transform(parts, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r";\s*q=([0-9.]+)", 1), F.lit("")).try_cast("double"), F.lit(1.0)))
        return F.coalesce(F.array_max(q), F.lit(0.0))

    return F.when(weight("text/markdown") > weight("application/json"), "markdown").otherwise("json")


def unpacked(body: Column, charset: Column, cap: int = 1 << 19, packed: Column | None = None) -> Column:
    """Text of a response body, gzip undone; null beyond `cap` bytes or in an unknown charset, even if empty. Bodies are taken one at a time.

    packed: whether a body is gzip; by default, and where null, its first two bytes tell, which may also be U+1F8B in UTF-16.
    """
    import zlib

    @F.arrow_udf("string")
    def run(b: pa.Array, c: pa.Array, p: pa.Array) -> pa.Array:
        out = []
        for row in zip(b, c, p, strict=True):
            raw, name, gz = (x.as_py() for x in row)
            data = raw or b""
            try:
                if data[:2] == b"\x1f\x8b" if gz is None else gz:
                    z = zlib.decompressobj(31)
                    data = z.decompress(data, cap + 1)
                # Python looks up no charset for no bytes, so that of an empty body is tried on one byte
                text = None if len(data) > cap else (data or b"?").decode(name or "utf-8", "replace")
                out.append(text if data else "")
            except (LookupError, zlib.error):
                out.append(None)
        return pa.array(out, pa.string())

    return run(body, charset, F.lit(None).cast("boolean") if packed is None else packed)
