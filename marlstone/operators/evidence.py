"""Whether sources bear out what was added to a record, and how extractions score."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.dates import date_context, date_evidence, find_in_context
from marlstone.functions.text import any_of, field_match
from marlstone.session import cut

CLASSES = ("verified", "partial", "unverified", "wrong_type", "unreachable", "broken")
#: Words around a date that say what it is for.
REGISTER_WORDS = ["등록", "참가 신청", "참가신청", "참관", "사전등록", "registration", "register"]
EXHIBIT_WORDS = ["부스", "출품", "전시 신청", "전시신청", "참가업체", "exhibitor", "booth", "exhibit"]
DEADLINE_WORDS = ["마감", "까지", "접수", "신청", "deadline", "due", "close"]


def name_classes(rows: DataFrame, pages: DataFrame, key: str, page: str, value: str, text: str) -> DataFrame:
    """(key, class): the best class over a row's pages; verified if the value stands there, partial if all its words do."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    r = rows.select(key, page, F.trim(flat(F.col(value))).alias("_v"))
    j = r.join(pages.select(page, flat(F.col(text)).alias("_t")), page)
    words = F.filter(F.split("_v", "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    rank = F.when((F.col("_v") != "") & F.contains("_t", F.col("_v")), 2).when((F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.col("_t"), w)), 1).otherwise(0)
    best = j.groupBy(key).agg(F.max(rank).alias("_r"))
    name = F.when(F.col("_r") == 2, "verified").when(F.col("_r") == 1, "partial").when(F.col("_r") == 0, "unverified").otherwise("unreachable")
    return rows.select(key).join(best, key, "left").select(key, name.alias("class"))


def _mentions(pages: DataFrame, items: list[tuple[str, list[str]]]) -> DataFrame:
    """(_v, _r) of the items (value, its words) that the pages (_t) hold: 2 the value, 1 all its words.

    One automaton of all values and words goes over each text once; an item is looked at only where its longest word
    stands. A task keeps the best rank of each item, so it hands on at most one row for an item.
    """

    def run(frames):
        import ahocorasick

        patterns: dict[str, int] = {}
        of = lambda p: patterns.setdefault(p, len(patterns))
        coded = [(of(v), [of(w) for w in words]) for v, words in items]
        by_anchor: dict[int, list[int]] = {}
        for i, (v, words) in enumerate(items):
            by_anchor.setdefault(of(max(words, key=len)) if words else coded[i][0], []).append(i)
        automaton = ahocorasick.Automaton()
        for p, n in patterns.items():
            automaton.add_word(p, n)
        automaton.make_automaton()
        best = [0] * len(items)
        for b in frames:
            for t in b.column(0).to_pylist():
                there = {n for _, n in automaton.iter(t)} if t and patterns else ()
                for n in there:
                    for i in by_anchor.get(n, ()):
                        v, words = coded[i]
                        if best[i] < 2:
                            best[i] = 2 if v in there else max(best[i], int(bool(words) and all(w in there for w in words)))
        hit = [i for i, r in enumerate(best) if r]
        yield pa.RecordBatch.from_arrays([pa.array([items[i][0] for i in hit], pa.string()), pa.array([best[i] for i in hit], pa.int32())], names=["_v", "_r"])

    return pages.mapInArrow(run, "_v string, _r int").groupBy("_v").agg(F.max("_r").alias("_r"))


#: Items that are looked for in one pass over the pages.
ITEMS = 50_000


def name_classes_anywhere(rows: DataFrame, pages: DataFrame, key: str, value: str, text: str, block: int = ITEMS) -> DataFrame:
    """(key, class) as `name_classes`, but over all pages; without any page a row is unreachable. A blank value is never found.

    The values are a set of queries: each pass over the pages looks for up to `block` distinct ones, all at once.
    """
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    v = cut(rows.select(key, F.trim(flat(F.col(value))).alias("_v")))
    asked = v.where("_v <> ''").select("_v").distinct().select("_v", F.filter(F.split("_v", "[^a-z0-9]+"), lambda w: F.length(w) > 2).alias("_w"))
    passes = max(1, -(-asked.count() // block))
    found = None
    for k in range(passes):
        items = [(r["_v"], list(r["_w"])) for r in asked.where(F.pmod(F.xxhash64("_v"), F.lit(passes)) == k).collect()]
        got = _mentions(pages.select(flat(F.col(text)).alias("_t")), items)
        found = got if found is None else found.unionByName(got)
    some = pages.limit(1).count() > 0
    name = F.when(F.col("_r") == 2, "verified").when(F.col("_r") == 1, "partial").otherwise("unverified" if some else "unreachable")
    return v.join(found, "_v", "left").select(key, name.alias("class"))


def deadline_class(page: Column, iso: Column, field: Column | str) -> Column:
    """What the words within 90 characters of a date's first mention on a page say of it: verified with deadline words and
    the field's own ones, of the wrong type with the other field's only, else partial; null where there is no page."""
    registers = (F.lit(field) if isinstance(field, str) else field) == "registration_deadline"

    def judge(low: Column) -> Column:
        due, reg, exh = any_of(low, DEADLINE_WORDS), any_of(low, REGISTER_WORDS), any_of(low, EXHIBIT_WORDS)
        own, other = (registers & reg) | (~registers & exh), (registers & exh) | (~registers & reg)
        return F.when(low.isNull(), "unverified").when(due & own, "verified").when(due & other, "wrong_type").otherwise("partial")

    return F.when(page.isNotNull(), F.transform(F.array(F.lower(date_context(page, iso))), judge)[0])


#: Of the classes of several pages the first of these counts.
BETTER = ("verified", "wrong_type", "partial", "unverified")


def best_class(classes: Column) -> Column:
    """Aggregate: the class of a row over its pages; null classes are pages that were not reached."""
    rank = F.min(F.array_position(F.array(*[F.lit(c) for c in BETTER]), classes))
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in BETTER]), (rank - 1).cast("int")), F.lit("unreachable"))


def deadline_classes(rows: DataFrame, pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, class) of rows (key, page, field, value) over all pages (page, text) of theirs; text is null where a page was not reached."""
    both = rows.join(pages.select(page, F.col("text").alias("_text")), page, "left")
    return both.groupBy(key).agg(best_class(deadline_class(F.col("_text"), F.col("value"), F.col("field"))).alias("class"))


def link_classes(rows: DataFrame, pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, class) of rows (key, page, value, status): an address that doesn't answer with 200 to 299 is broken, one that a
    page of the row names is verified, any other is partial."""
    both = rows.join(pages.select(page, F.col("text").alias("_text")), page, "left")
    # The bare address is a part of the whole one.
    named = F.coalesce(F.contains("_text", F.regexp_replace("value", "/+$", "")), F.lit(False))
    answers = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    return both.groupBy(key).agg(F.when(~F.bool_or(answers), "broken").when(F.bool_or(named), "verified").otherwise("partial").alias("class"))


def scored(gold: DataFrame, got: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, hit) for each field of each case; a case without output scores on empty values."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x")).select(key, "x.field", F.col("x.v").alias(name))
    both = long(gold, "want").join(long(got, "got"), [key, "field"], "left")
    return both.select(key, "field", field_match(F.col("field"), F.col("want"), F.col("got")).alias("hit"))


def summary(rows: DataFrame, by: str) -> DataFrame:
    """(by, total, hits, percent, avg_tokens), with whole-number division."""
    n = F.count(F.lit(1))
    agg = rows.groupBy(by).agg(n.alias("total"), F.count_if("hit").alias("hits"), F.sum("tokens").alias("_t"))
    return agg.select(by, "total", "hits", F.expr("(100 * hits) div total").alias("percent"), F.expr("_t div total").alias("avg_tokens"))


def context(text: Column, iso: Column) -> Column:
    return F.when(date_evidence(text, iso), find_in_context(text, "[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}"))
