"""Evidence classes and extraction scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import evidence
from marlstone.plans.registry import Registry
from marlstone.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(
    "extraction_score",
    """SELECT o_orderkey, field, CASE field WHEN 'start_raw' THEN regexp_replace(want, '[^0-9]', '', 'g') = regexp_replace(got, '[^0-9]', '', 'g') WHEN 'venue_name' THEN contains(lower(got), lower(want)) ELSE trim(lower(want)) = trim(lower(got)) END AS hit FROM (
       SELECT o_orderkey, 'start_raw' AS field, strftime(o_orderdate, '%Y.%m.%d') AS want, CASE WHEN o_orderkey % 4 = 0 THEN '2000-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS got FROM orders UNION ALL
       SELECT o_orderkey, 'venue_name', o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN left(o_orderpriority, 4) WHEN o_orderkey % 3 = 1 THEN upper(o_orderpriority) || ' hall' ELSE o_orderpriority END FROM orders UNION ALL
       SELECT o_orderkey, 'city', o_orderstatus, ' ' || lower(o_orderstatus) FROM orders)""",
)
def extraction_score(spark, d):
    o, k, p = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderpriority")
    gold = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy.MM.dd").alias("start_raw"), p.alias("venue_name"), F.col("o_orderstatus").alias("city"))
    venue = F.when(k % 3 == 0, F.left(p, F.lit(4))).when(k % 3 == 1, F.concat(F.upper(p), F.lit(" hall"))).otherwise(p)
    got = o.select("o_orderkey", F.when(k % 4 == 0, "2000-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start_raw"), venue.alias("venue_name"), F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("city"))
    return evidence.scored(gold, got, "o_orderkey", ["start_raw", "venue_name", "city"])


@query(
    "score_summary",
    "SELECT lang AS backend, count(*) AS total, count(*) FILTER (WHERE n_chars > 1000) AS hits, (100 * count(*) FILTER (WHERE n_chars > 1000)) // count(*) AS percent, sum(n_chars)::BIGINT // count(*) AS avg_tokens FROM documents GROUP BY lang",
)
def score_summary(spark, d):
    return evidence.summary(table(spark, d, "documents").select(F.col("lang").alias("backend"), (F.col("n_chars") > 1000).alias("hit"), F.col("n_chars").alias("tokens")), "backend")


_EV = """WITH r AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS needle FROM benchmark),
p AS (SELECT lower(regexp_replace(text, '\\s+', ' ', 'g')) AS hay FROM documents),
w AS (SELECT item_id, needle, list_filter(regexp_split_to_array(needle, '[^a-z0-9]+'), lambda x: length(x) > 2) AS words FROM r),
s AS (SELECT item_id, max(CASE WHEN needle <> '' AND contains(hay, needle) THEN 2 WHEN len(words) > 0 AND len(list_filter(words, lambda x: NOT contains(hay, x))) = 0 THEN 1 ELSE 0 END) AS rank FROM w, p GROUP BY item_id),
c AS (SELECT r.item_id, CASE s.rank WHEN 2 THEN 'verified' WHEN 1 THEN 'partial' WHEN 0 THEN 'unverified' ELSE 'unreachable' END AS class FROM r LEFT JOIN s USING (item_id))"""


@query("evidence_audit", f"{_EV} SELECT item_id, class FROM c")
def evidence_audit(spark, d):
    """The benchmark's items, a set of queries, against all documents, on whole texts."""
    return evidence.name_classes_anywhere(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "text")


@query("audit_summary", f"{_EV} SELECT count(*) FILTER (WHERE class = 'verified') AS verified, count(*) FILTER (WHERE class = 'partial') AS partial, count(*) FILTER (WHERE class = 'unverified') AS unverified, count(*) FILTER (WHERE class = 'wrong_type') AS wrong_type, count(*) FILTER (WHERE class = 'unreachable') AS unreachable, count(*) FILTER (WHERE class = 'broken') AS broken, count(*) AS total FROM c")
def audit_summary(spark, d):
    from marlstone.operators.discovery import histogram

    return histogram(evidence_audit(spark, d), [], "class", evidence.CLASSES)


def _sql_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


#: Two source pages of an order: what they say, how far from the date, and in which shape the date stands.
_SAID = ("사전등록 마감", "부스 신청 마감", "Booth close", "Registration due", "held on", "참관 접수", "until")


@query(
    "deadline_classes",
    f"""WITH p AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, unnest([
      ({list(_SAID)})[length(o_orderpriority) % 7 + 1] || ' ' || repeat('x ', o_orderkey % 60) || strftime(o_orderdate, '%Y-%m-%d') || ' end',
      CASE WHEN o_orderstatus = 'O' THEN 'no date, 마감 등록' WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') || repeat(' y', o_custkey % 60) || ({list(_SAID)})[o_custkey % 7 + 1] END]) AS page FROM orders),
    x AS (SELECT o_orderkey, page IS NOT NULL AS reached, strpos(page, iso) > 0 AS found, lower(substr(page, greatest(1, strpos(page, iso) - 90), strpos(page, iso) + 100 - greatest(1, strpos(page, iso) - 90))) AS ctx FROM p),
    y AS (SELECT *, {_sql_any("ctx", evidence.DEADLINE_WORDS)} AS due, {_sql_any("ctx", evidence.REGISTER_WORDS)} AS reg, {_sql_any("ctx", evidence.EXHIBIT_WORDS)} AS exh FROM x),
    z AS (SELECT o_orderkey, min(CASE WHEN NOT reached THEN 9 WHEN NOT found THEN 4 WHEN due AND reg THEN 1 WHEN due AND exh THEN 2 ELSE 3 END) AS r FROM y GROUP BY 1)
    SELECT o_orderkey, (['verified', 'wrong_type', 'partial', 'unverified'])[r] AS class FROM z""",
)
def deadline_classes(spark, d):
    iso, said = F.date_format("o_orderdate", "yyyy-MM-dd"), F.array(*[F.lit(x) for x in _SAID])
    near = F.concat(F.get(said, F.length("o_orderpriority") % 7), F.lit(" "), F.expr("repeat('x ', cast(o_orderkey % 60 as int))"), iso, F.lit(" end"))
    far = F.when(F.col("o_orderstatus") == "O", "no date, 마감 등록").when(F.col("o_orderstatus") == "F", F.concat(iso, F.expr("repeat(' y', cast(o_custkey % 60 as int))"), F.get(said, (F.col("o_custkey") % 7).cast("int"))))
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", F.col("o_orderkey").alias("page"), F.lit("registration_deadline").alias("field"), iso.alias("value"))
    return evidence.deadline_classes(rows, o.select(F.col("o_orderkey").alias("page"), F.explode(F.array(near, far)).alias("text")), "o_orderkey", "page")


@query(
    "link_evidence",
    """SELECT page_id, CASE WHEN status IS NULL OR status NOT BETWEEN 200 AND 299 THEN 'broken' WHEN contains(text, rtrim(url, '/')) THEN 'verified' ELSE 'partial' END AS class FROM (
    SELECT page_id, url, CASE WHEN contains(html, '$$$') THEN 404 WHEN contains(html, '###') THEN NULL ELSE 204 END AS status, CASE WHEN contains(html, ' la ') THEN html || url || '?x' ELSE html END AS text FROM pages)""",
)
def link_evidence(spark, d):
    has = lambda x: F.contains("html", F.lit(x))
    p = table(spark, d, "pages").withColumn("page", F.col("page_id"))
    rows = p.select("page_id", "page", F.concat("url", F.lit("/")).alias("value"), F.when(has("$$$"), 404).when(~has("###"), 204).alias("status"))
    return evidence.link_classes(rows, p.select("page", F.when(has(" la "), F.concat("html", "url", F.lit("?x"))).otherwise(F.col("html")).alias("text")), "page_id", "page")


@query("labels_quality", "SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY source")
def labels_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"))


