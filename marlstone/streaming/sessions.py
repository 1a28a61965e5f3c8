"""Discovery sessions over a stream of steps: a bounded buffer of candidates that lack something, rescue by opening, expiry.

A found candidate with title, place and day is offered; one that lacks some of them waits, at most `PENDING` at a time.
Opening a waiting one fills its gaps and promotes it once it is complete. A session without a step for `idle` seconds ends: what
still waits expires, and a later step begins anew. Each step gives one row with its outcome, each expiry one row.

The same buffer serves the stream (state in maps by address, a timer for the end) and a replay in batch (a session's
steps in order, one task holding one session's buffer at a time), so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Candidates that wait, and candidates that are offered.
PENDING, OFFERED = 10, 30
FIELDS = ("title", "place", "day")
OUT = "session long, n long, url string, outcome string, title string, place string, day string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _blank(x) -> bool:
    return x is None or x != x or not str(x).strip()


@dataclass
class Buffer:
    """One session's candidates by address: the waiting ones as (n, title, place, day), the offered ones as their n."""

    idle: float
    waiting: dict[str, tuple] = field(default_factory=dict)
    offered: dict[str, int] = field(default_factory=dict)
    last: float | None = None

    def expired(self) -> list[tuple]:
        """Ends the session; (n, url, outcome, title, place, day) of what still waits, by n."""
        out = [(v[0], u, "expired", *v[1:]) for u, v in sorted(self.waiting.items(), key=lambda x: (x[1][0], x[0]))]
        self.waiting, self.offered, self.last = {}, {}, None
        return out

    def step(self, at: float, n: int, kind: str, url: str | None, said: tuple) -> list[tuple]:
        out = self.expired() if self.last is not None and at - self.last >= self.idle else []
        self.last = at if self.last is None else max(at, self.last)
        said = tuple(None if _blank(x) else str(x) for x in said)
        known = self.waiting.get(url) if url is not None else None
        if kind == "opened":
            if known is None:
                outcome = "opened" if url in self.offered else "unknown"
            else:
                said = tuple(a if a is not None else b for a, b in zip(known[1:], said, strict=True))
                self.waiting[url] = (known[0], *said)
                outcome = "waiting"
                if all(x is not None for x in said):
                    outcome = self._offer(url, known[0], "promoted")
        elif _blank(url):
            outcome = "dropped"
        elif known is not None or url in self.offered:
            outcome = "duplicate"
        elif all(x is not None for x in said):
            outcome = self._offer(url, n, "offered")
        elif len(self.waiting) >= PENDING:
            outcome = "dropped"
        else:
            self.waiting[url] = (n, *said)
            outcome = "waiting"
        return [*out, (n, url, outcome, *said)]

    def _offer(self, url: str, n: int, outcome: str) -> str:
        if len(self.offered) >= OFFERED:
            return "full"
        self.waiting.pop(url, None)
        self.offered[url] = n
        return outcome


def _frame(session, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session, *r) for r in rows], columns=COLUMNS).astype({"session": "int64", "n": "int64"})


class Sessions(StatefulProcessor):
    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "url string", "n long, title string, place string, day string")
        self.offered = handle.getMapState("offered", "url string", "n long")
        self.last = handle.getValueState("last", "at double")

    def _load(self) -> Buffer:
        b = Buffer(self.idle)
        if self.last.exists():
            b.last = self.last.get()[0]
            b.waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
            b.offered = {k[0]: v[0] for k, v in self.offered.iterator()}
        return b

    def _save(self, b: Buffer) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.waiting.clear()
        self.offered.clear()
        for u, v in b.waiting.items():
            self.waiting.updateValue((u,), v)
        for u, n in b.offered.items():
            self.offered.updateValue((u,), (n,))
        if b.last is None:
            self.last.clear()
        else:
            self.last.update((b.last,))
            self.handle.registerTimer(int((b.last + self.idle) * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["t", "n"])
        b, out = self._load(), []
        for r in got.itertuples(index=False):
            out += b.step(r.t, r.n, r.kind, r.url, (r.title, r.place, r.day))
        self._save(b)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = self._load()
        due = b.last is not None and int((b.last + self.idle) * 1000) <= expiredTimerInfo.getExpiryTimeInMs()
        out = b.expired() if due else []
        self._save(b)
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


STEP = ("session", "t", "n", "kind", "url", *FIELDS)


def streamed(steps: DataFrame, idle: float, late: str = "0 seconds") -> DataFrame:
    """Outcomes of a stream of steps (session, at timestamp, n, kind, url, title, place, day); needs the RocksDB state store.

    A session's steps within a micro-batch are taken in order of time, then n; steps that come later than `late` allows are dropped by
    the watermark. What waits at the end of the input expires once the watermark has passed it."""
    rows = steps.withWatermark("at", late).withColumn("t", F.unix_micros(F.col("at").cast("timestamp")) / 1e6)
    return rows.groupBy("session").transformWithStateInPandas(Sessions(idle), OUT, "Append", "EventTime")


def replayed(steps: DataFrame, idle: float, until: float | None = None) -> DataFrame:
    """The same rows for a table of steps; sessions that `until` (seconds) leaves idle long enough end there."""

    def run(frames):
        b, whose = None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if b is None or r.session != whose:
                    if b is not None:
                        out += [(whose, *x) for x in _end(b)]
                    b, whose = Buffer(idle), r.session
                out += [(whose, *x) for x in b.step(r.t, r.n, r.kind, r.url, (r.title, r.place, r.day))]
            yield pd.DataFrame(out, columns=COLUMNS)
        if b is not None:
            yield pd.DataFrame([(whose, *x) for x in _end(b)], columns=COLUMNS)

    def _end(b: Buffer) -> list[tuple]:
        return b.expired() if until is not None and b.last is not None and until >= b.last + idle else []

    rows = steps.where("session IS NOT NULL").withColumn("t", F.unix_micros(F.col("at").cast("timestamp")) / 1e6).select(*STEP)
    return rows.repartition("session").sortWithinPartitions("session", "t", "n").mapInPandas(run, OUT)
