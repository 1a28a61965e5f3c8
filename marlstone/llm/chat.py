r"""Chat formatting by event sourcing, in DataFrame operations only.

A log holds a conversation's events in sequence: `message` opens one, `delta` adds to the text of the one opened last,
`regenerate` starts it anew, and `edit` sets the text of the one whose number it names. `numbered` finds each event's
message by counting what was opened before it in its conversation's sequence; the count is taken in stretches of the
sequence, so a long conversation is many tasks, or, where a conversation has to come together anyway, in one go. `fold` then folds each message's events in sequence: only what follows
the last event that sets the text counts. Messages become segments of a template, `<turn>role\ntext</turn>\n`, with a
loss mask of the byte ranges of assistants' texts in the formatted conversation. In texts and roles `\` becomes `\\` and
the `<` of a control string `\l`; a newline in a role becomes `\n`. Every escape begins with a backslash that no other
character can be mistaken for, so reading back is exact.

A conversation's own output is one row, in message order, as its digest needs. Null texts and roles are empty. Messages
with equal turns, and repeated rows, are all kept, by turn, role, then text; a null turn comes first; null conversations
are one. Other columns are not read. An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import spread_rank, table

OPEN, CLOSE, LOSS_ROLE = "<turn>", "</turn>\n", "assistant"
SETS = ("message", "edit", "regenerate")
#: Events of a conversation that are counted in one stretch.
STRETCH = 1 << 12


def numbered(events: DataFrame, conv: str = "conv_id", order: str = "seq", target: str = "target", together: bool = False) -> DataFrame:
    """Adds `number`: which of the conversation's messages an event is about, from 1 on; 0 before the first is opened.

    together: a conversation is counted in one go, where what follows needs it in one task in any case."""
    opens = (F.col("kind") == "message").cast("long")
    if together:
        so_far = F.sum(opens).over(Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return events.withColumn("number", F.coalesce(F.col(target).cast("long"), so_far))
    stretch = F.coalesce(F.floor(F.col(order) / STRETCH), F.lit(-1))
    counted = spread_rank(events, [conv], [order], stretch, weight=opens, into="number")
    return counted.withColumn("number", F.coalesce(F.col(target).cast("long"), F.col("number") + opens))


def fold(events: DataFrame, message: list[str], order: str = "seq") -> DataFrame:
    """(message columns, role, text) of every message of a log with `kind`, `role`, `text` and the order column.

    role: that of the last event that sets the text, or the first event's if none does.
    """
    key = Window.partitionBy(*message)
    past = key.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("kind").isin(*SETS)
    e = events.withColumn("_age", F.sum(sets.cast("int")).over(past))
    e = e.withColumn("_last", F.max("_age").over(key)).where("_age = _last")
    part = F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "")
    return e.groupBy(*message).agg(F.coalesce(F.min_by("role", order), F.lit("")).alias("role"), text.alias("text"))


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), "<(?=/?turn>)", r"\\l")


def unescaped(c: Column) -> Column:
    plain = F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def segments(messages: DataFrame) -> DataFrame:
    """Adds `head`, `body`, `tail` and `loss` to messages with role and text; still one row per message."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    return messages.select("*", F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"), F.lit(CLOSE).alias("tail"), (F.col("role") == LOSS_ROLE).alias("loss"))


def conversations(messages: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("number",)) -> DataFrame:
    """(conv, formatted, mask): each conversation's text and the byte ranges in it, from start to end, that count for the loss."""
    rows = segments(messages)
    size = F.octet_length("head") + F.octet_length("body") + F.octet_length("tail")
    before = Window.partitionBy(conv).orderBy(*order, "head", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.octet_length("head"))
    turn = F.struct("start", (F.col("start") + F.octet_length("body")).alias("end"), "loss", F.concat("head", "body", "tail").alias("segment"))
    turns = rows.groupBy(conv).agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    mask = F.transform(F.filter("_t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return turns.select(conv, F.array_join(F.transform("_t", lambda t: t["segment"]), "").alias("formatted"), mask.alias("mask"))


def parsed(text: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    turns = F.split(text, CLOSE, -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    inner = F.transform(turns, lambda t: F.substring(t, len(OPEN) + 1, 2147483647))

    def read(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(t, F.length(role) + 2)).alias("text"))

    return F.transform(inner, read)


def loss_texts(raw: Column, mask: Column) -> Column:
    """The texts under the loss mask of a formatted conversation's bytes, in order."""
    return F.transform(mask, lambda m: unescaped(F.substring(raw, m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int")).cast("string")))


def streamed(rows: DataFrame, together: bool = False) -> DataFrame:
    """A log in which the messages of (conv_id, turn, role, text) come about by every kind of event.

    An assistant's is opened, gets half of its text, is edited, begun anew, and streamed in three deltas; any other's is
    opened with half of its text, begun anew, streamed, and edited into its own words after the next messages. together: as
    in `numbered`.
    """
    turn = F.coalesce(F.floor(F.col("turn") / 256), F.lit(-(1 << 31)))
    if together:
        i = rows.withColumn("_i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1)
    else:
        i = spread_rank(rows, ["conv_id"], ["turn", "role", "text"], turn, into="_i")
    half, third = F.ceil(F.length("text") / 2), F.ceil(F.length("text") / 3)
    part = lambda k: F.substr("text", (third * k + 1).cast("int"), third.cast("int"))
    said, first = F.col("role") == LOSS_ROLE, F.left("text", half.cast("int"))

    def event(step: int, kind: str, text: Column, target: Column | None = None) -> Column:
        to = F.lit(None).cast("long") if target is None else target
        return F.struct((16 * F.col("_i") + step).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"), to.alias("target"))

    own, empty = F.col("_i") + 1, F.lit("")
    stream = F.array(event(0, "message", empty), event(1, "delta", first), event(2, "edit", first, own), event(3, "regenerate", empty), *[event(4 + k, "delta", part(k)) for k in range(3)])
    other = F.array(event(0, "message", first), event(3, "regenerate", empty), event(4, "delta", part(0)), event(2 * 16 + 9, "edit", F.col("text"), own))
    return i.select("conv_id", "role", F.explode(F.when(said, stream).otherwise(other)).alias("e")).select("conv_id", "role", "e.*")


def _log(spark, sf_dir) -> DataFrame:
    """The log of the table's conversations and the one of control strings."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return streamed(table(spark, sf_dir, "conversations").select(*cols).union(control), together=True)


def op2_chat(spark, sf_dir):
    """A row for each conversation, so its log comes together in one task: the texts are shuffled once, by conversation, and what
    follows (counting, folding, formatting) finds them where they are."""
    chats = conversations(fold(numbered(_log(spark, sf_dir), together=True), ["conv_id", "number"]))
    raw = F.col("formatted").cast("binary")
    read = chats.select("conv_id", parsed(F.col("formatted")).alias("turns"), F.array_join(loss_texts(raw, F.col("mask")), "").alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn>', '\lturn>'), '</turn>', '\l/turn>') AS t,
         replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'), chr(10), '\n') AS r
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(6 + length(r) + 1 + length(t) + 8)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
