"""Anchored request quotas as a stateful stream operator; the batch form is in operators.sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, event_id long, allowed boolean"


class WindowQuota(StatefulProcessor):
    """At most `limit` requests per client in a window that opens at its first request and lasts `seconds`."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "open double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        opened, n = self.state.get() if self.state.exists() else (None, 0)
        got = pd.concat(list(rows)).sort_values(["t", "event_id"])
        allowed = []
        for t in got["t"]:
            if opened is None or t - opened >= self.seconds:
                opened, n = float(t), 0
            n += 1
            allowed.append(n <= self.limit)
        self.state.update((opened, n))
        yield pd.DataFrame({"user_id": key[0], "event_id": got["event_id"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


def window_quota(stream: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Requests (user_id, event_id, t) with `allowed`; needs the RocksDB state store."""
    return stream.groupBy("user_id").transformWithStateInPandas(WindowQuota(limit, seconds), OUT, "Append", "None")
