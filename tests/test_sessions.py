"""Sessions: the stream, with restarts, against a replay in batch, and both against a plain loop."""

import random
from datetime import datetime, timedelta, timezone

from marlstone.plans.stream import rocksdb
from marlstone.streaming import ingest, sessions

SCHEMA = "session long, at timestamp, n long, kind string, url string, title string, place string, day string"
START = datetime(2026, 1, 1, tzinfo=timezone.utc)
IDLE = 600.0


def steps(rng, n):
    rows = []
    for i in range(n):
        some = lambda x, p=0.6: x if rng.random() < p else rng.choice([None, " "])
        at = START + timedelta(seconds=i * 7)
        rows.append((rng.choice([1, 1, 1, 2, 3]) if i % 300 < 200 else 2, at, i, rng.choice(["found", "found", "found", "opened"]), rng.choice([f"u{rng.randrange(40)}", f"u{rng.randrange(40)}", None]), some("t"), some("p"), some("d", 0.8)))
    return rows


def loop(rows, until=None):
    """One dictionary a session, no buffer class."""
    out, state = [], {}

    def end(s):
        st = state.pop(s)
        out.extend((s, v["n"], u, "expired", *v["said"]) for u, v in st["c"].items() if not v["in"])

    for s, at, n, kind, url, *said in sorted(rows, key=lambda r: (r[1], r[2])):
        if s in state and (at - state[s]["at"]).total_seconds() >= IDLE:
            end(s)
        st = state.setdefault(s, {"c": {}})
        st["at"] = at
        c = st["c"]
        said = [x if x and x.strip() else None for x in said]
        n_in, n_out = sum(v["in"] for v in c.values()), sum(not v["in"] for v in c.values())
        if kind == "opened":
            if url in c and not c[url]["in"]:
                said = c[url]["said"] = [a or b for a, b in zip(c[url]["said"], said, strict=True)]
                what = "waiting" if None in said else "promoted" if n_in < 30 else "full"
                c[url]["in"] = what == "promoted"
            else:
                what = "opened" if url in c else "unknown"
        elif url is None:
            what = "dropped"
        elif url in c:
            what = "duplicate"
        elif None not in said:
            what = "offered" if n_in < 30 else "full"
            if what == "offered":
                c[url] = {"n": n, "said": said, "in": True}
        else:
            what = "waiting" if n_out < 10 else "dropped"
            if what == "waiting":
                c[url] = {"n": n, "said": said, "in": False}
        out.append((s, n, url, what, *said))
    for s in list(state):
        if until is not None and until >= state[s]["at"].timestamp() + IDLE:
            end(s)
    return sorted(out, key=str)


def test_stream_replay_and_loop_agree_also_after_a_restart(spark, tmp_path):
    rows = steps(random.Random(3), 1500)
    source, sink, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")

    def drain(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        with rocksdb(spark):  # each drain is a query of its own that goes on from the checkpoint
            ingest.append_once(sessions.streamed(spark.readStream.schema(SCHEMA).parquet(source), IDLE), sink, at)

    last = (9, START + timedelta(days=2), 9999, "opened", "u", None, None, None)  # so late that all else ends
    for part in (rows[:700], rows[700:], [last]):
        drain(part)
    got = sorted((tuple(r) for r in spark.read.schema(sessions.OUT).parquet(sink).select(*sessions.COLUMNS).collect()), key=str)
    until = last[1].timestamp()
    replay = sorted((tuple(r) for r in sessions.replayed(spark.createDataFrame([*rows, last], SCHEMA), IDLE, until).collect()), key=str)
    want = loop([*rows, last], until)
    assert replay == want and got == want
    kinds = {r[3] for r in want}
    assert kinds >= {"offered", "waiting", "promoted", "dropped", "duplicate", "unknown", "opened", "expired"}


def test_full_and_empty(spark):
    rows = [(1, START, i, "found", f"u{i}", "t", "p", "d") for i in range(32)] + [(1, START, 40, "found", "w", None, "p", "d"), (1, START, 41, "opened", "w", "t", None, None), (None, START, 1, "found", "x", "t", "p", "d")]
    got = {r.n: r.outcome for r in sessions.replayed(spark.createDataFrame(rows, SCHEMA), IDLE).collect()}
    assert [got[i] for i in (29, 30, 31, 40, 41)] == ["offered", "full", "full", "waiting", "full"]
    assert sessions.replayed(spark.createDataFrame([], SCHEMA), IDLE).count() == 0
