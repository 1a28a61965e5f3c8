"""Steps of a discovery session as rows: what a model's answer asks for, what a call may spend, and why a session ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import variant
from marlstone.functions.urls import candidate
from marlstone.functions.web import last_object

#: Code points of a reason or query and of a candidate's metadata, calls and tokens of a session.
REASON, METADATA, CALLS, TOKENS = 500, 300, 8, 4000
ACTIONS = ("search", "open", "accept", "done")
ANSWER = {"action": "string", "query": "string", "url": "string", "selections": [{"url": "string", "reason": "string"}]}


def redacted(c: Column, most: int) -> Column:
    """Without contacts and outer blanks, at most so many code points."""
    return T.left_runes(F.trim(T.strip_contacts(c)), most)


def actions(answers: DataFrame, answer: str) -> DataFrame:
    """The rows with `kind`, `query`, `url`, `selections` and `dropped` of the last object of each answer.

    `kind` is null for an answer that asks for nothing that can be done: no object, an object with an unknown field or a
    value of another type than `ANSWER` has, an unknown action, a search without a query, an opening without an
    address, an acceptance without one address. Selections without an address are dropped and counted."""

    def read(v: Column) -> Column:
        """An answer's fields, each read once; null where the answer is refused."""
        chosen = F.transform(variant.items(v, "selections"), lambda s: F.struct(F.trim(variant.text(s, "url")).alias("url"), redacted(variant.text(s, "reason"), REASON).alias("reason")))
        return F.when(v.isNotNull(), F.struct(variant.text(v, "action").alias("action"), redacted(variant.text(v, "query"), REASON).alias("query"), F.trim(variant.text(v, "url")).alias("url"), chosen.alias("given")))

    a = answers.withColumn("_o", last_object(F.col(answer)))
    a = a.withColumn("_a", variant.once(variant.strict(F.col("_o"), ANSWER), read))
    a = a.withColumn("_k", F.filter("_a.given", lambda s: s["url"] != ""))
    kind, query, url, given, kept = (F.col(c) for c in ("_a.action", "_a.query", "_a.url", "_a.given", "_k"))
    good = F.when(kind == "search", query != "").when(kind == "open", url != "").when(kind == "accept", F.size(kept) > 0).otherwise(kind == "done")
    of = lambda name, c: F.when(good & (kind == name), c).alias({"search": "query", "open": "url"}.get(name, name))
    return a.select(*answers.columns, F.when(good, kind).alias("kind"), of("search", query), of("open", url), F.when(good & (kind == "accept"), kept).alias("selections"), F.when(good & (kind == "accept"), F.size(given) - F.size(kept)).alias("dropped"))


def provenance(df: DataFrame, url: str, record: str) -> DataFrame:
    """The rows with `record` (provider, relation, seed_url, parent_url, raw_url) as it can be shown: related addresses in
    canonical form, texts without contacts; null if a related address is none, if the raw one isn't the candidate's, or
    if nothing is left."""
    of = lambda f: F.coalesce(F.col(f"{record}.{f}"), F.lit(""))
    seed, parent, raw = (F.when(of(f) != "", candidate(of(f))) for f in ("seed_url", "parent_url", "raw_url"))
    good = ((of("seed_url") == "") | seed.isNotNull()) & ((of("parent_url") == "") | parent.isNotNull()) & ((of("raw_url") == "") | F.coalesce(raw == F.col(url), F.lit(False)))
    provider, relation = redacted(of("provider"), METADATA), redacted(of("relation"), METADATA)
    some = F.concat(provider, relation, of("seed_url"), of("parent_url"), of("raw_url")) != ""
    shown = F.struct(provider.alias("provider"), relation.alias("relation"), F.coalesce(seed, F.lit("")).alias("seed_url"), F.coalesce(parent, F.lit("")).alias("parent_url"), F.trim(of("raw_url")).alias("raw_url"))
    return df.withColumn(record, F.when(F.col(record).isNotNull() & good & some, shown))


def reservations(calls: DataFrame, session: str, order: str, per_call: int, most: int = CALLS, tokens: int = TOKENS) -> DataFrame:
    """The rows with `reserved`, the tokens set aside before a call, null where it isn't made, and `refused`, why not:
    calls of a session are made in order, `most` of them at most, each with what is left of `tokens`."""
    before = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    left = F.lit(tokens) - before * per_call
    refused = F.when(before >= most, "model_call_budget").when(left <= 0, "completion_token_budget")
    return calls.withColumns({"refused": refused, "reserved": F.when(refused.isNull(), F.least(left, F.lit(per_call)))})


def terminal_reason(error: Column, truncated: Column, done: Column) -> Column:
    """Why a session ended: what went wrong before what ran out, and tokens before calls."""
    return (
        F.when(error.isin("context_canceled", "deadline_exceeded", "invalid_usage"), error)
        .when(done, "proposal_done")
        .when(F.array_contains(truncated, "completion_token_budget"), "token_budget")
        .otherwise("model_call_budget")
    )
