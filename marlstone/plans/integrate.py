"""Write-side queries: merge, differences, election, breaker, validation, migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import breaker, election, merge
from marlstone.plans.registry import Registry
from marlstone.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

FIELDS = ["c_name", "c_nationkey", "c_mktsegment"]
_LP = lambda v: f"unhex(lpad(hex(octet_length(encode({v}))), 16, '0')) || encode({v})"


def _hash_sql(alias: str) -> str:
    return "sha256(" + " || ".join(_LP(f"'{f}'") + " || " + _LP(f"coalesce(trim(regexp_replace({alias}{f}::VARCHAR, '\\s+', ' ', 'g')), chr(0) || 'null')") for f in sorted(FIELDS)) + ")"


_V = f"""prev0 AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0),
prev AS (SELECT *, {_hash_sql('')} AS content_hash FROM prev0),
inc0 AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || '  x' WHEN c_custkey % 7 = 0 THEN ' ' || c_name ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 13 <> 0),
inc AS (SELECT *, {_hash_sql('')} AS content_hash FROM inc0),
j AS (SELECT coalesce(p.c_custkey, i.c_custkey) AS c_custkey, p, i, CASE WHEN i.c_custkey IS NULL THEN 'new' WHEN p.c_custkey IS NULL THEN 'new' WHEN i.content_hash = p.content_hash THEN 'unchanged' ELSE 'updated' END AS state
  FROM prev p FULL OUTER JOIN inc i ON p.c_custkey = i.c_custkey)"""


def _both(spark, d):
    c = table(spark, d, "customer").select("c_custkey", *FIELDS)
    k = F.col("c_custkey")
    prev = merge.hashed(c.where(k % 11 != 0), FIELDS).withColumns({"created_at": F.lit("2026-01-01T00:00:00Z"), "updated_at": F.lit("2026-01-01T00:00:00Z"), "last_checked_at": F.lit("2026-01-01"), "update_state": F.lit("new")})
    name = F.when(k % 5 == 0, F.concat("c_name", F.lit("  x"))).when(k % 7 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name"))
    inc = c.where(k % 13 != 0).select("c_custkey", name.alias("c_name"), F.when(k % 6 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment")
    return merge.joined(prev, merge.hashed(inc, FIELDS), "c_custkey")


@query("upsert_state", f"WITH {_V} SELECT state, count(*) AS n FROM j GROUP BY state")
def upsert_state(spark, d):
    return _both(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "merge_snapshot",
    f"""WITH {_V} SELECT c_custkey, CASE WHEN fresh THEN i.c_name ELSE p.c_name END AS c_name, CASE WHEN fresh THEN i.c_nationkey ELSE p.c_nationkey END AS c_nationkey,
    CASE WHEN fresh THEN i.c_mktsegment ELSE p.c_mktsegment END AS c_mktsegment, CASE WHEN fresh THEN i.content_hash ELSE p.content_hash END AS content_hash,
    CASE WHEN p.c_custkey IS NULL THEN '2026-02-02T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS created_at, CASE WHEN fresh THEN '2026-02-02T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS updated_at,
    CASE WHEN i.c_custkey IS NULL THEN '2026-01-01' ELSE '2026-02-02' END AS last_checked_at, state AS update_state
    FROM (SELECT *, i.c_custkey IS NOT NULL AND state <> 'unchanged' AS fresh FROM j)""",
)
def merge_snapshot(spark, d):
    return merge.snapshot(_both(spark, d), "c_custkey", FIELDS, F.lit("2026-02-02"), F.lit("2026-02-02T00:00:00Z"))


_D = f"""{_V}, dd AS (SELECT c_custkey, f AS field_path, trim(regexp_replace(o, '\\s+', ' ', 'g')) AS old_value, trim(regexp_replace(n, '\\s+', ' ', 'g')) AS new_value FROM (
  SELECT c_custkey, 'c_mktsegment' AS f, p.c_mktsegment AS o, i.c_mktsegment AS n FROM j WHERE state = 'updated' UNION ALL
  SELECT c_custkey, 'c_name', p.c_name, i.c_name FROM j WHERE state = 'updated' UNION ALL
  SELECT c_custkey, 'c_nationkey', p.c_nationkey::VARCHAR, i.c_nationkey::VARCHAR FROM j WHERE state = 'updated')),
diff AS (SELECT * FROM dd WHERE old_value IS DISTINCT FROM new_value)"""


@query("diff_fields", f"WITH {_D} SELECT * FROM diff")
def diff_fields(spark, d):
    return merge.differences(_both(spark, d), "c_custkey", FIELDS)


@query("change_log_append", f"WITH {_D} SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys, 1001 AS first_id, 1000 + count(*) AS last_id, count(*) AS ids FROM diff")
def change_log_append(spark, d):
    log = merge.change_log(merge.differences(_both(spark, d), "c_custkey", FIELDS), "c_custkey", F.lit("2026-02-02"), 1000)
    return log.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("keys"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids"))


@query("merge_idempotent", "SELECT 'unchanged' AS state, count(*) AS n FROM customer WHERE c_custkey % 13 <> 0 OR c_custkey % 11 <> 0")
def merge_idempotent(spark, d):
    """A merge followed by the same batch again leaves every row unchanged or absent; absent ones keep their state."""
    after = merge.snapshot(_both(spark, d), "c_custkey", FIELDS, F.lit("2026-02-02"), F.lit("2026-02-02T00:00:00Z"))
    again = merge.joined(after, after.select("c_custkey", *FIELDS, "content_hash"), "c_custkey")
    return again.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("migration_repair_hash", f"SELECT c_custkey, {_hash_sql('')} AS content_hash FROM customer")
def migration_repair_hash(spark, d):
    return merge.hashed(table(spark, d, "customer").select("c_custkey", *FIELDS), FIELDS).select("c_custkey", "content_hash")


_E = """e AS (SELECT p_partkey, (['coex','showala','kintex','akei'])[p_partkey % 4 + 1] || '-' || p_partkey AS event_id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand || '|' || p_size END AS content_key FROM part),
w AS (SELECT *, content_key IS NOT NULL AND row_number() OVER (PARTITION BY content_key ORDER BY CASE WHEN event_id LIKE 'showala-%' THEN 10 ELSE 100 END DESC, event_id) > 1 AS superseded FROM e)"""


def _elected(spark, d):
    src = F.element_at(F.array(*[F.lit(x) for x in ("coex", "showala", "kintex", "akei")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    key = F.when(F.col("p_size") % 10 != 0, F.concat_ws("|", "p_brand", "p_size"))
    return election.elect(table(spark, d, "part").select("p_partkey", F.concat_ws("-", src, "p_partkey").alias("event_id"), key.alias("content_key")))


@query("canonical_election", f"WITH {_E} SELECT event_id, content_key, superseded FROM w")
def canonical_election(spark, d):
    return _elected(spark, d).select("event_id", "content_key", "superseded")


@query("visible_only", f"WITH {_E} SELECT split_part(event_id, '-', 1) AS source, count(*) AS n FROM w WHERE NOT superseded GROUP BY 1")
def visible_only(spark, d):
    return _elected(spark, d).where("NOT superseded").groupBy(F.substring_index("event_id", "-", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "batch_stats",
    "SELECT source, count(*) AS discovered, count(*) FILTER (WHERE lang <> 'es') AS parsed, count(*) FILTER (WHERE lang <> 'es' AND n_chars >= 500) AS stored, count(*) FILTER (WHERE lang <> 'es' AND n_chars < 500) AS skipped FROM documents GROUP BY source",
)
def batch_stats(spark, d):
    parsed = F.col("lang") != "es"
    return breaker.report(table(spark, d, "documents").select("source", "lang", "n_chars"), "source", F.lit(True), parsed, parsed & (F.col("n_chars") >= 500))


@query("changed_fraction", "SELECT source, count(*) FILTER (WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0) AS changed, count(*) AS total, count(*) FILTER (WHERE doc_id % 4 <> 0) AS known FROM documents GROUP BY source")
def changed_fraction(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    h = F.col("doc_id").cast("string")
    stored = docs.where("doc_id % 4 <> 0").select("doc_id", h.alias("content_hash"))
    batch = docs.withColumn("content_hash", F.when(F.col("doc_id") % 3 == 0, F.concat(h, F.lit("x"))).otherwise(h))
    return breaker.changed_fraction(batch, stored, "doc_id", "source")


@query(
    "breaker_decision",
    """SELECT source, CASE WHEN n = 0 THEN 'zero_refs' WHEN n < 2 THEN 'below_floor' WHEN last > 0 AND n < 0.5 * last THEN 'discovery_drop' WHEN known > 0 AND changed > 0.4 * known THEN 'change_spike' END AS reason
    FROM (SELECT source, count(*) FILTER (WHERE length(source) > 4 OR lang = 'en') AS n, count(*) * 8 // 10 AS last, count(*) FILTER (WHERE doc_id % 3 = 0) AS changed, count(*) AS known FROM documents GROUP BY source)""",
)
def breaker_decision(spark, d):
    per = table(spark, d, "documents").groupBy("source").agg(F.count_if((F.length("source") > 4) | (F.col("lang") == "en")).alias("n"), F.floor(F.count(F.lit(1)) * 8 / 10).alias("last"), F.count_if(F.col("doc_id") % 3 == 0).alias("changed"), F.count(F.lit(1)).alias("known"))
    return per.select("source", breaker.decision(F.col("n"), F.col("last"), F.col("changed"), F.col("known"), floor=2, most_changed=0.4).alias("reason"))


@query(
    "missing_fields",
    """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'start_date' END, CASE WHEN o_orderkey % 3 = 0 THEN 'end_date' END, CASE WHEN o_orderkey % 5 = 0 THEN 'venue.city' END, CASE WHEN o_orderkey % 6 = 0 THEN 'end_date' END], lambda x: x IS NOT NULL))), ',') AS missing FROM orders""",
)
def missing_fields(spark, d):
    from marlstone.functions.records import missing

    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(missing({"start_date": k % 2 == 0, "end_date": (k % 3 == 0) | (k % 6 == 0), "venue.city": k % 5 == 0}), ",").alias("missing"))


@query(
    "validate_rules",
    """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'rule1: name required' WHEN c_custkey % 8 = 0 THEN 'rule1: country required' WHEN c_custkey % 7 = 0 THEN 'rule1: categories required (>=1) for non-excluded event'
       WHEN c_custkey % 5 = 0 THEN 'rule4: category not in taxonomy' WHEN c_custkey % 11 = 0 THEN 'rule3: end_date before start_date' WHEN c_custkey % 4 = 0 THEN 'rule5: source url not http(s)' END AS error FROM customer""",
)
def validate_rules(spark, d):
    from marlstone.functions.records import validate

    k = F.col("c_custkey")
    none = F.expr("CAST(array() AS array<string>)")
    rec = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("x-"), k.cast("string")).alias("event_id"), F.lit("0.1").alias("schema_version"), F.when(k % 9 != 0, F.col("c_name")).otherwise(" ").alias("name"), F.when(k % 8 != 0, "KR").otherwise("").alias("country"),
        F.lit("high").alias("confidence"), none.alias("missing_fields"), F.lit("2026-01-01").alias("last_checked_at"), F.lit(False).alias("excluded"), F.when(k % 7 == 0, none).when(k % 5 == 0, F.array(F.lit("games"))).otherwise(F.array(F.lit("ai"))).alias("categories"),
        F.lit("2026-02-02").alias("start_date"), F.when(k % 11 == 0, "2026-02-01").otherwise("2026-02-03").alias("end_date"),
        F.array(F.struct(F.when(k % 4 == 0, "ftp://x").otherwise("https://x.org/").alias("url"), F.lit("venue").alias("type"), F.lit("p").alias("publisher"), F.lit("2026-01-01").alias("retrieved_at"))).alias("sources"),
    )
    return rec.select("c_custkey", validate().alias("error"))


@query(
    "action_signals_normalize",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 = 0 END, false) AS can_register, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'https://r.org/' || c_custkey END AS register_url,
       array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'actions.can_register' END, CASE WHEN c_custkey % 4 = 0 THEN 'register_url' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer""",
)
def action_signals_normalize(spark, d):
    from marlstone.functions.records import http_url, missing

    k = F.col("c_custkey")
    sig = F.when(k % 3 != 0, k % 2 == 0)
    url = http_url(F.when(k % 4 == 0, "javascript:x").otherwise(F.concat(F.lit(" https://r.org/"), k.cast("string"))))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(sig, F.lit(False)).alias("can_register"), url.alias("register_url"), F.array_join(missing({"actions.can_register": sig.isNull(), "register_url": url.isNull()}), ",").alias("missing"))


@query(
    "build_venue",
    """SELECT s_suppkey, CASE WHEN nm IS NULL AND ct IS NULL THEN NULL ELSE coalesce(nm, '') || '/' || coalesce(ct, '') END AS venue,
       CASE WHEN nm IS NULL AND ct IS NULL THEN 'venue.city,venue.hall,venue.name,venue.venue_id' ELSE array_to_string(list_filter([CASE WHEN ct IS NULL THEN 'venue.city' END, 'venue.hall', CASE WHEN nm IS NULL THEN 'venue.name' END, 'venue.venue_id'], lambda x: x IS NOT NULL), ',') END AS missing
       FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS nm, CASE WHEN s_suppkey % 3 = 0 THEN 'Seoul' END AS ct FROM supplier)""",
)
def build_venue(spark, d):
    from marlstone.functions.records import venue

    k = F.col("s_suppkey")
    v, miss = venue(F.lit(""), F.when(k % 2 == 0, F.col("s_name")), F.lit(None).cast("string"), F.when(k % 3 == 0, F.lit(" Seoul ")))
    return table(spark, d, "supplier").select("s_suppkey", F.when(v.isNotNull(), F.concat_ws("/", F.coalesce(v["name"], F.lit("")), F.coalesce(v["city"], F.lit("")))).alias("venue"), F.array_join(miss, ",").alias("missing"))


@query(
    "build_sources",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 + (page_id % 2) END AS n, CASE WHEN page_id % 5 = 0 THEN NULL ELSE coalesce(CASE WHEN page_id % 3 = 0 THEN 'Pub' END, 'src') END AS publisher FROM pages""",
)
def build_sources(spark, d):
    from marlstone.functions.records import sources

    k = F.col("page_id")
    extra = F.when(k % 2 == 1, F.array(F.struct(F.lit("http://e.org").alias("url"), F.lit("press").alias("type"), F.lit("E").alias("publisher"), F.lit("2026-01-01").alias("retrieved_at")))).otherwise(F.array(F.struct(F.lit("mailto:x").alias("url"), F.lit("press").alias("type"), F.lit("E").alias("publisher"), F.lit("2026-01-01").alias("retrieved_at"))))
    s = sources(F.when(k % 5 == 0, "data:x").otherwise(F.col("url")), F.lit(None).cast("string"), F.when(k % 3 == 0, "Pub"), F.lit(None).cast("string"), F.lit("src"), F.lit("2026-01-01"), extra)
    return table(spark, d, "pages").select("page_id", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0))["publisher"].alias("publisher"))


@query("merge_signals", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'base' END, CASE WHEN c_custkey % 3 = 0 THEN 'extra' END) AS register_url, coalesce(CASE WHEN c_custkey % 5 = 0 THEN true END, c_custkey % 7 = 0) AS can_register FROM customer")
def merge_signals(spark, d):
    k = F.col("c_custkey")
    base = F.struct(F.when(k % 2 == 0, "base").alias("register_url"), F.when(k % 5 == 0, True).alias("can_register"))
    extra = F.struct(F.when(k % 3 == 0, "extra").alias("register_url"), (k % 7 == 0).alias("can_register"))
    return table(spark, d, "customer").select("c_custkey", base.alias("base"), extra.alias("extra")).select("c_custkey", *merge.coalesced("base", "extra", ["register_url", "can_register"]))


@query("migration_template_summary", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'own words' END AS summary FROM part")
def migration_template_summary(spark, d):
    from marlstone.functions.records import without_template_summary

    k = F.col("p_partkey")
    s = F.when(k % 3 == 0, F.concat("p_name", F.lit(" — 2026"))).when(k % 3 == 1, F.upper("p_name")).otherwise("own words")
    return table(spark, d, "part").select("p_partkey", without_template_summary(s, F.col("p_name")).alias("summary"))


@query("migration_missing_append", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'summary' WHEN p_partkey % 3 = 1 THEN 'edition,summary' ELSE 'summary,edition' END AS missing FROM part")
def migration_missing_append(spark, d):
    from marlstone.functions.records import appended

    k = F.col("p_partkey") % 3
    a = F.when(k == 1, F.array(F.lit("edition"))).when(k == 2, F.array(F.lit("summary"), F.lit("edition")))
    return table(spark, d, "part").select("p_partkey", F.array_join(appended(a, "summary"), ",").alias("missing"))


@query("migration_revoke", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN '2026-01-01' END AS deadline, CASE WHEN p_partkey % 4 = 0 THEN 'edition,registration_deadline' ELSE 'edition' END AS missing FROM part")
def migration_revoke(spark, d):
    from marlstone.functions.records import appended

    src = F.array(F.struct(F.lit("https://x").alias("url"), F.when(F.col("p_partkey") % 4 == 0, "ungated").otherwise("page").alias("publisher")))
    bad = F.exists(src, lambda s: s["publisher"] == "ungated")
    miss = F.array(F.lit("edition"))
    return table(spark, d, "part").select("p_partkey", F.when(~bad, "2026-01-01").alias("deadline"), F.array_join(F.when(bad, appended(miss, "registration_deadline")).otherwise(miss), ",").alias("missing"))


@query("dead_letters", "SELECT source, 'normalize' AS stage, count(*) AS n, CASE WHEN lang = 'es' THEN 'rule1: name required' ELSE 'rule5: source url not http(s)' END AS message FROM documents WHERE lang IN ('es', 'fr') GROUP BY source, lang")
def dead_letters(spark, d):
    err = F.when(F.col("lang") == "es", "rule1: name required").when(F.col("lang") == "fr", "rule5: source url not http(s)")
    return table(spark, d, "documents").select("source", err.alias("message")).where("message IS NOT NULL").groupBy("source", "message").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("normalize"))


@query("fallback_rows", "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'catalog ' || page_id ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS name FROM pages")
def fallback_rows(spark, d):
    parsed = F.when(F.col("page_id") % 6 != 0, F.regexp_extract("html", "<title>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", F.coalesce(parsed, F.concat(F.lit("catalog "), F.col("page_id").cast("string"))).alias("name"))


@query(
    "normalize_events",
    """SELECT 'kintex-' || o_orderkey AS event_id, CASE WHEN k <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start_date, CASE WHEN k = 1 THEN NULL ELSE strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') END AS end_date,
       CASE WHEN k = 1 THEN 'low' ELSE 'high' END AS date_confidence, o_orderkey % 5 <> 0 AS industry, CASE WHEN o_orderkey % 7 = 0 THEN 'rule1: name required' WHEN o_orderkey % 6 = 0 THEN 'rule5: at least one source required' END AS error,
       CASE WHEN k = 1 THEN 'edition,end_date,homepage_url,name_en,name_ko,start_date,summary,venue.city' ELSE 'edition,homepage_url,name_en,name_ko,summary,venue.city' END AS missing
       FROM (SELECT *, o_orderkey % 3 AS k FROM orders)""",
)
def normalize_events(spark, d):
    from marlstone.operators.normalize import normalized

    k, o = F.col("o_orderkey"), F.col("o_orderdate")
    raw = table(spark, d, "orders").select(
        F.lit("kintex").alias("source_id"), F.concat(F.lit("kintex-"), k.cast("string")).alias("event_id"), F.when(k % 6 == 0, "javascript:1").otherwise("https://k.org/").alias("url"),
        F.when(k % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("name"), F.when(k % 3 == 1, "soon").otherwise(F.date_format(o, "yyyy.MM.dd")).alias("start_raw"), F.when(k % 3 == 1, F.lit(None)).otherwise(F.date_format(F.date_add(o.cast("date"), 2), "yyyy-M-d")).alias("end_raw"),
        F.lit("KINTEX").alias("venue_name"), F.lit("Hall 1").alias("hall"), F.when(k % 5 == 0, "garden").otherwise("robot fair").alias("classify_text"),
    )
    e = normalized(raw, "2026-01-01T00:00:00Z")
    return e.select("event_id", "start_date", "end_date", "date_confidence", (~F.col("excluded")).alias("industry"), "error", F.array_join("missing_fields", ",").alias("missing"))
