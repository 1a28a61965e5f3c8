import hashlib

from pyspark.sql import functions as F

from marlstone.llm import chat

NASTY = [None, "", "\\", "\\\\", "\\l", "\\n", "<turn>", "</turn>\n", "a</turn>", "<</turn>", "\\</turn>\\", "x\ny\n", "é🙂 <turn", "<turn>user\nhi</turn>\n<turn>assistant\n", "\\### Assistant: </turn> ok", "z" * 50000]


def test_round_trip(spark):
    rows = [(c, t, r, x, "extra") for c in (1, 2, None) for t, (r, x) in enumerate(((["user", "assistant", None, "sys\ntem\\n"])[i % 4], x) for i, x in enumerate(NASTY))]
    rows += [(3, 0, "assistant", "same", "e")] * 3 + [(4, None, "user", "q", "e"), (4, 1, "assistant", "a", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    from pyspark.sql import Window

    log = df.select("conv_id", "turn", *blank, F.lit("message").alias("kind"), F.lit(0).alias("seq")).withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    out = chat.conversations(chat.fold(log, ["conv_id", "turn", "nth"]), order=("turn", "nth"))
    raw = F.col("formatted").cast("binary")
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.loss_texts(raw, F.col("mask")).alias("lost")).collect()}
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        assert got[c].lost == [x for _, r, x in turns if r == "assistant"]
    assert chat.conversations(chat.fold(log.limit(0), ["conv_id", "turn", "nth"]), order=("turn", "nth")).count() == 0
    streamed = chat.streamed(df.select("conv_id", "turn", *blank))
    kinds = {(r.conv_id, r.kind) for r in streamed.select("conv_id", "kind").distinct().collect()}
    assert kinds == {(c, k) for c in by for k in ("message", "delta", "edit", "regenerate")}
    again = chat.conversations(chat.fold(chat.numbered(streamed), ["conv_id", "number"]))
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in again.select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert turns == {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()}
    once = chat.streamed(df.select("conv_id", "turn", *blank), together=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, streamed.collect()))
    assert sorted(map(str, chat.numbered(once, together=True).select(*once.columns, "number").collect())) == sorted(map(str, chat.numbered(streamed).select(*once.columns, "number").collect()))
    plan = chat.conversations(chat.fold(chat.numbered(once, together=True), ["conv_id", "number"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert chat.numbered(streamed.limit(0)).count() == 0 == chat.numbered(once.limit(0), together=True).count()


def test_fold(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "regenerate", "assistant", None), (1, 1, 3, "delta", "assistant", "He"), (1, 1, 4, "delta", "assistant", "llo"),
        (1, 1, 5, "regenerate", "assistant", ""), (1, 1, 7, "delta", "assistant", "there"), (1, 1, 6, "delta", "assistant", "Hi "), (1, 0, 8, "edit", "user", "hi!"), (1, 2, 9, "delta", "user", "no start"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = {r.turn: (r.role, r.text) for r in chat.fold(df, ["conv_id", "turn"]).collect()}
    assert got == {0: ("user", "hi!"), 1: ("assistant", "Hi there"), 2: ("user", "no start")}


def test_query(spark):
    rows = {r.conv_id: r for r in chat.op2_chat(spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    said = f"user\n{text}\nassistant\n{text}\n"
    assert rows[-7].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and rows[-7].loss_chars == len(text)
    assert rows[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for r in sorted(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append(r)
    assert set(want) | {-7} == set(rows)
    for c, turns in want.items():
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in turns).encode()).hexdigest()
        assert rows[c].loss_sha256 == hashlib.sha256("".join(t.text for t in turns if t.role == "assistant").encode()).hexdigest()


def test_numbered_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 3)
    log = [(1, 0, "delta", "a", None), (1, 2, "message", "b", None), (1, 4, "delta", "c", None), (1, 9, "message", "d", None), (1, 11, "edit", "B", 1), (1, 12, "delta", "e", None), (1, 13, "regenerate", None, None), (1, 14, "delta", "f", None), (2, 5, "message", "g", None), (None, 1, "message", "h", None), (None, 2, "delta", "i", None)]
    df = spark.createDataFrame([(c, s, k, "user", t, n) for c, s, k, t, n in log], "conv_id long, seq long, kind string, role string, text string, target long")
    got = {(r.conv_id, r.number): r.text for r in chat.fold(chat.numbered(df), ["conv_id", "number"]).collect()}
    assert got == {(1, 0): "a", (1, 1): "B", (1, 2): "f", (2, 1): "g", (None, 1): "hi"}
