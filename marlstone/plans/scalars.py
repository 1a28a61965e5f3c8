"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.functions import hashing as H
from marlstone.functions import text as T
from marlstone.plans.registry import Registry
from marlstone.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _docs(spark, d, *cols):
    return table(spark, d, "documents").select("doc_id", *cols)


def sql_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w.lower()}')" for w in words) + ")"


@query("ws_normalize", r"""SELECT doc_id, trim(regexp_replace(replace(text, ' ', ' ' || chr(9)), '\s+', ' ', 'g')) AS clean FROM documents""")
def ws_normalize(spark, d):
    return _docs(spark, d, T.ws(F.replace("text", F.lit(" "), F.lit(" \t"))).alias("clean"))


@query(
    "strip_contacts",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '[email removed]', 'g'),
        '0\d{1,2}[-\s]?\d{3,4}[-\s]?\d{4}', '[phone removed]', 'g') AS clean FROM documents""",
)
def strip_contacts(spark, d):
    return _docs(spark, d, T.strip_contacts(F.col("text")).alias("clean"))


@query("truncate_runes", "SELECT doc_id, text[1:240] AS summary, length(text[1:240]) AS n FROM documents")
def truncate_runes(spark, d):
    s = T.left_runes(F.col("text"), 240)
    return _docs(spark, d, s.alias("summary"), F.length(s).cast("long").alias("n"))


@query("slugify", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query(
    "md_escape",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n|\n|\r', ' ', 'g'), '([\\`|*_\[\]()<>&])', '\\\1', 'g') AS cell FROM documents""",
)
def md_escape(spark, d):
    return _docs(spark, d, T.md_text(F.col("text")).alias("cell"))


@query("md_url", "SELECT page_id, '<' || replace(regexp_replace(trim(url || ' x'), '[<>\\r\\n]', '', 'g'), ' ', '%20') || '>' AS link FROM pages")
def md_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.md_url(F.concat("url", F.lit(" x"))).alias("link"))


@query(
    "prompt_safe_line",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text || '<b>', '[[:cntrl:]]', ' ', 'g'), '[<>]', '', 'g'), '\s+', ' ', 'g')) AS line FROM documents""",
)
def prompt_safe_line(spark, d):
    return _docs(spark, d, T.prompt_safe_line(F.concat("text", F.lit("<b>"))).alias("line"))


_CLASSIFY = (
    "CASE WHEN "
    + sql_any("low", T.NON_INDUSTRY)
    + " THEN []::VARCHAR[] ELSE list_filter(["
    + ", ".join(f"CASE WHEN {sql_any('low', w)} THEN '{k}' END" for k, w in T.CATEGORY_WORDS.items())
    + "], lambda x: x IS NOT NULL) END"
)
CLASSIFIED = f"""c0 AS (SELECT doc_id, source, lower(text) AS low FROM documents),
c1 AS (SELECT doc_id, source, low, {_CLASSIFY} AS hits FROM c0),
c AS (SELECT doc_id, source, CASE WHEN len(hits) = 0 AND regexp_matches(low, 'ai[가-힣]') AND NOT {sql_any("low", T.NON_INDUSTRY)} THEN ['ai'] ELSE hits END AS categories FROM c1)"""


def classified(spark, d):
    c = T.classify(F.col("text"))
    return _docs(spark, d, "source", c.alias("c")).select("doc_id", "source", "c.*")


@query(
    "category_classify",
    f"WITH {CLASSIFIED} SELECT doc_id, array_to_string(categories, ',') AS categories, len(categories) = 0 AS excluded, CASE WHEN len(categories) > 0 THEN 'high' ELSE 'low' END AS confidence FROM c",
)
def category_classify(spark, d):
    return classified(spark, d).select("doc_id", F.array_join("categories", ",").alias("categories"), "excluded", "confidence")


@query(
    "category_facet_zero_fill",
    f"""WITH {CLASSIFIED}, t AS (SELECT unnest({list(T.CATEGORIES)}) AS category, unnest(range(0, {len(T.CATEGORIES)})) AS ord),
    n AS (SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM c) GROUP BY category)
    SELECT ord, t.category, coalesce(n, 0)::BIGINT AS n FROM t LEFT JOIN n ON t.category = n.category""",
)
def category_facet_zero_fill(spark, d):
    from marlstone.operators.facets import zero_filled

    return zero_filled(classified(spark, d).where("NOT excluded"), "categories", T.CATEGORIES)


@query("excluded_scope", f"WITH {CLASSIFIED} SELECT source, count(*) AS n, count(*) FILTER (WHERE len(categories) = 0) AS excluded_n FROM c GROUP BY source")
def excluded_scope(spark, d):
    return classified(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("excluded").alias("excluded_n"))


@query(
    "cost_hint",
    """SELECT doc_id, CASE WHEN f AND p THEN 'mixed' WHEN f THEN 'free' WHEN p THEN 'paid' END AS cost FROM (
       SELECT doc_id, contains(lower(text), 'free') OR contains(text, '무료') AS f,
              contains(lower(text), 'fee') OR contains(lower(text), 'paid') OR contains(text, '유료') AS p FROM documents)""",
)
def cost_hint(spark, d):
    return _docs(spark, d, T.cost_hint(F.lower("text")).alias("cost"))


@query(
    "venue_resolve",
    """SELECT s_suppkey, CASE WHEN src IN ('coex', 'kintex') THEN src WHEN contains(lower(nm), 'kintex') THEN 'kintex' WHEN contains(lower(nm), 'coex') THEN 'coex' ELSE '' END AS venue_id
       FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'coex' ELSE 'other' END AS src,
             s_name || CASE WHEN s_suppkey % 4 = 1 THEN ' KINTEX 1' WHEN s_suppkey % 4 = 2 THEN ' Coex Hall' ELSE '' END AS nm FROM supplier)""",
)
def venue_resolve(spark, d):
    k = F.col("s_suppkey")
    src = F.when(k % 3 == 0, "coex").otherwise("other")
    name = F.concat("s_name", F.when(k % 4 == 1, " KINTEX 1").when(k % 4 == 2, " Coex Hall").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", T.venue_id(src, name).alias("venue_id"))


@query(
    "defaults_enum",
    """SELECT n_nationkey, coalesce(upper(nullif(trim(left(n_name, n_nationkey % 3)), '')), 'KR') AS country,
       CASE WHEN n_nationkey % 5 = 0 THEN 'Asia/Seoul' ELSE 'UTC' END AS timezone,
       CASE WHEN n_nationkey % 4 = 0 THEN 'online' WHEN n_nationkey % 4 = 1 THEN 'hybrid' ELSE 'onsite' END AS format FROM nation""",
)
def defaults_enum(spark, d):
    k = F.col("n_nationkey")
    country = F.coalesce(F.upper(F.nullif(F.trim(F.left("n_name", (k % 3).cast("int"))), F.lit(""))), F.lit("KR"))
    tz = F.coalesce(F.nullif(F.when(k % 5 == 0, "").otherwise("UTC"), F.lit("")), F.lit("Asia/Seoul"))
    raw = F.when(k % 4 == 0, "online").when(k % 4 == 1, "hybrid").otherwise("floating")
    fmt = F.when(raw.isin("onsite", "hybrid", "online"), raw).otherwise("onsite")
    return table(spark, d, "nation").select("n_nationkey", country.alias("country"), tz.alias("timezone"), fmt.alias("format"))


@query(
    "latin_name",
    r"""SELECT doc_id, lt > 0 AND 2 * ac >= lt AND lower(trim(nm)) <> lower(trim(source)) AS latin FROM (
        SELECT doc_id, source, text AS nm, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS lt, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS ac FROM documents)""",
)
def latin_name(spark, d):
    return _docs(spark, d, T.latin_name(F.col("text"), F.col("source")).alias("latin"))


@query("organizer_prefix", r"""SELECT doc_id, nullif(trim(regexp_extract('[' || source || '] ' || text, '^\[([^\[\]]{1,40})\]', 1)), '') AS organizer FROM documents""")
def organizer_prefix(spark, d):
    return _docs(spark, d, T.bracket_prefix(F.concat(F.lit("["), "source", F.lit("] "), F.col("text"))).alias("organizer"))


@query(
    "split_period",
    """SELECT o_orderkey, trim(a) AS start_raw, trim(coalesce(b, a)) AS end_raw FROM (SELECT o_orderkey, string_split(p, '~')[1] AS a, string_split(p, '~')[2] AS b FROM (
       SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' ~ ' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y.%m.%d') ELSE '' END AS p FROM orders))""",
)
def split_period(spark, d):
    o = table(spark, d, "orders")
    p = F.concat(F.date_format("o_orderdate", "yyyy.MM.dd"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" ~ "), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 3), "yyyy.MM.dd"))).otherwise(""))
    s = T.split_period(p)
    return o.select("o_orderkey", s["start"].alias("start_raw"), s["end"].alias("end_raw"))


_RAW = """CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 1 THEN strftime(o_orderdate, '%Y.%-m.%-d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
 WHEN 3 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:30:00+09:00' WHEN 5 THEN strftime(o_orderdate, '%Y-%m') || '-31' WHEN 6 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE ' ' || strftime(o_orderdate, '%Y.%m.%d') || ' ' END"""


def _raw():
    k, o = F.col("o_orderkey") % 8, F.col("o_orderdate")
    f = lambda x: F.date_format(o, x)
    return (
        F.when(k == 0, f("yyyy.MM.dd")).when(k == 1, f("yyyy.M.d")).when(k == 2, f("yyyy-MM-dd")).when(k == 3, f("yyyy-M-d")).when(k == 4, F.concat(f("yyyy-MM-dd"), F.lit("T23:30:00+09:00")))
        .when(k == 5, F.concat(f("yyyy-MM"), F.lit("-31"))).when(k == 6, f("yyyy/MM/dd")).otherwise(F.concat(F.lit(" "), f("yyyy.MM.dd"), F.lit(" ")))
    )


_PARSED = """CASE WHEN k = 6 THEN NULL WHEN k = 5 THEN strftime(try_strptime(raw, '%Y-%m-%d'), '%Y-%m-%d') WHEN k = 4 THEN left(raw, 10) ELSE strftime(coalesce(try_strptime(trim(raw), '%Y.%m.%d'), try_strptime(trim(raw), '%Y-%m-%d')), '%Y-%m-%d') END"""


@query("date_parse_layouts", f"SELECT o_orderkey, raw, {_PARSED} AS iso FROM (SELECT o_orderkey, o_orderkey % 8 AS k, {_RAW} AS raw FROM orders)")
def date_parse_layouts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", _raw().alias("raw")).withColumn("iso", D.parse_date(F.col("raw")))


@query(
    "date_range_normalize",
    f"""SELECT o_orderkey, CASE WHEN NOT w THEN s END AS start_date, CASE WHEN NOT w THEN e END AS end_date, CASE WHEN w OR s IS NULL OR e IS NULL THEN 'low' ELSE 'high' END AS confidence,
    CASE WHEN w THEN 'end_date ' || e || ' precedes start_date ' || s || '; both dropped' ELSE '' END AS note FROM (
    SELECT *, coalesce(e < s, false) AS w FROM (SELECT o_orderkey, {_PARSED} AS s, strftime(o_orderdate + to_days(CAST(o_orderkey % 7 - 2 AS INTEGER)), '%Y-%m-%d') AS e
    FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 8 AS k, {_RAW} AS raw FROM orders)))""",
)
def date_range_normalize(spark, d):
    end = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 7 - 2).cast("int")), "yyyy-MM-dd")
    r = D.date_range(_raw(), end)
    return table(spark, d, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.start").alias("start_date"), F.col("r.end").alias("end_date"), "r.confidence", "r.note")


_DEAD = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y년 %-m월 %-d일') WHEN 1 THEN strftime(o_orderdate, '마감 %Y.%-m.%-d') WHEN 2 THEN '선착순 마감' ELSE strftime(o_orderdate, '%Y/%m/39') END"


@query(
    "deadline_normalize",
    rf"""SELECT o_orderkey, CASE WHEN y BETWEEN 2000 AND 2100 AND m BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', y, m, dd) END AS iso FROM (
    SELECT o_orderkey, try_cast(regexp_extract(raw, '(\d{{4}})\s*[년./-]\s*(\d{{1,2}})\s*[월./-]\s*(\d{{1,2}})', 1) AS INTEGER) AS y, try_cast(regexp_extract(raw, '(\d{{4}})\s*[년./-]\s*(\d{{1,2}})\s*[월./-]\s*(\d{{1,2}})', 2) AS INTEGER) AS m,
    try_cast(regexp_extract(raw, '(\d{{4}})\s*[년./-]\s*(\d{{1,2}})\s*[월./-]\s*(\d{{1,2}})', 3) AS INTEGER) AS dd FROM (SELECT o_orderkey, {_DEAD} AS raw FROM (SELECT o_orderkey, o_orderdate + INTERVAL 3000 DAY AS o_orderdate FROM orders)))""",
)
def deadline_normalize(spark, d):
    k, o = F.col("o_orderkey") % 4, F.date_add(F.col("o_orderdate").cast("date"), 3000)
    f = lambda x: F.date_format(o, x)
    raw = F.when(k == 0, f("yyyy년 M월 d일")).when(k == 1, f("마감 yyyy.M.d")).when(k == 2, F.lit("선착순 마감")).otherwise(f("yyyy/MM/'39'"))
    return table(spark, d, "orders").select("o_orderkey", D.normalize_deadline(raw).alias("iso"))


@query(
    "date_evidence",
    r"""SELECT o_orderkey, regexp_matches(t, strftime(o_orderdate, '%Y') || '\s*[-./년]\s*0?' || strftime(o_orderdate, '%-m') || '\s*[-./월]\s*0?' || strftime(o_orderdate, '%-d'))
        OR regexp_matches(t, '(^|[^0-9])0?' || strftime(o_orderdate, '%-m') || '\s*[./월]\s*0?' || strftime(o_orderdate, '%-d') || '($|[^0-9])') AS seen
        FROM (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, 'until %Y년 %-m월 %-d일') WHEN 1 THEN strftime(o_orderdate, 'on %-m.%-d or so') WHEN 2 THEN 'on 1.1' ELSE strftime(o_orderdate, '%Y%m%d') END AS t FROM orders)""",
)
def date_evidence(spark, d):
    k, o = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(o, "'until' yyyy년 M월 d일")).when(k == 1, F.date_format(o, "'on' M.d 'or so'")).when(k == 2, "on 1.1").otherwise(F.date_format(o, "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", D.date_evidence(t, F.date_format(o, "yyyy-MM-dd")).alias("seen"))


@query(
    "contact_context",
    r"""SELECT doc_id, trim(regexp_replace(text[greatest(1, a - 90):a + n + 90 - 1], '\s+', ' ', 'g')) AS context FROM (
        SELECT doc_id, text, length(regexp_extract(text, '^((?s:.*?))[0-9]{6,}', 1)) + 1 AS a, length(regexp_extract(text, '[0-9]{6,}')) AS n FROM documents) WHERE n > 0""",
)
def contact_context(spark, d):
    return _docs(spark, d, D.find_in_context(F.col("text"), "[0-9]{6,}").alias("context")).where("context IS NOT NULL")


@query(
    "deadline_near",
    r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y.%-m.%-d') END AS deadline
        FROM (SELECT o_orderkey, o_orderdate + INTERVAL 3000 DAY AS o_orderdate FROM orders)""",
)
def deadline_near(spark, d):
    k, o = F.col("o_orderkey") % 3, F.date_add(F.col("o_orderdate").cast("date"), 3000)
    t = F.when(k == 0, F.concat(F.lit("x 접수마감: "), F.date_format(o, "yyyy-MM-dd"))).when(k == 1, F.concat(F.lit("deadline by "), F.date_format(o, "yyyy.M.d"))).otherwise(F.concat(F.lit("deadline "), F.repeat(F.lit("가"), 40), F.date_format(o, "yyyy-MM-dd")))
    return table(spark, d, "orders").select("o_orderkey", D.deadline_near(F.lower(t), ["접수마감", "Deadline"]).alias("deadline"))


@query("kst_day", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM events")
def kst_day(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(D.kst_date(F.col("ts")), "yyyy-MM-dd").alias("day"))


_LP = lambda v: f"unhex(lpad(hex(octet_length(encode({v}))), 16, '0')) || encode({v})"
_PART = {"p_brand": "p_brand", "p_name": "p_name", "p_size": "p_size::VARCHAR", "p_type": "p_type"}


@query(
    "content_hash",
    "SELECT p_partkey, sha256(" + " || ".join(_LP(f"'{k}'") + " || " + _LP(f"trim(regexp_replace({v}, '\\s+', ' ', 'g'))") for k, v in _PART.items()) + ") AS content_hash FROM part",
)
def content_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", H.content_hash({k: F.col(k) for k in _PART}).alias("content_hash"))


_NAME = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(nm)), '20\d{2}년?', '', 'g'), '제\s*\d+\s*회', '', 'g'), '\b\d+(?:st|nd|rd|th)\b', '', 'g'), '[^\p{L}\p{N}]+', '', 'g')"""
_NM = "CASE p_partkey % 4 WHEN 0 THEN '2026 ' || p_name WHEN 1 THEN '제 5회 ' || p_name WHEN 2 THEN upper(p_name) || ' (7th)' ELSE p_name || ' 5th한글' END"


@query("content_key", f"SELECT p_partkey, CASE WHEN k <> '' THEN k || '|2026-01-0' || (p_size % 3 + 1) || '|' || p_brand END AS content_key FROM (SELECT p_partkey, p_size, p_brand, {_NAME} AS k FROM (SELECT *, {_NM} AS nm FROM part))")
def content_key(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("2026 "), "p_name")).when(k == 1, F.concat(F.lit("제 5회 "), "p_name")).when(k == 2, F.concat(F.upper("p_name"), F.lit(" (7th)"))).otherwise(F.concat("p_name", F.lit(" 5th한글")))
    day = F.concat(F.lit("2026-01-0"), (F.col("p_size") % 3 + 1).cast("string"))
    return table(spark, d, "part").select("p_partkey", H.content_key(name, day, F.col("p_brand")).alias("content_key"))


@query("canonical_arrays", """SELECT user_id, to_json(list_sort(list(event_type)))::VARCHAR AS categories FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def canonical_arrays(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct().groupBy("user_id").agg(H.canonical_array(F.collect_list("event_type")).alias("categories"))


@query("source_authority", "SELECT p_partkey, src, CASE WHEN src = 'showala' THEN 10 ELSE 100 END AS authority FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'showala' WHEN 1 THEN 'coex' ELSE '' END AS src FROM part)")
def source_authority(spark, d):
    eid = F.concat(F.when(F.col("p_partkey") % 3 == 0, "showala-").when(F.col("p_partkey") % 3 == 1, "coex-").otherwise("-"), F.col("p_partkey").cast("string"))
    src = H.source_of(eid)
    return table(spark, d, "part").select("p_partkey", src.alias("src"), H.authority(src).alias("authority"))


@query("json_props", "SELECT event_id, try_cast(props->>'$.k' AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))
