"""Stateful operators over a stream: rate limits with back-off and circuit breakers, one small state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Breaker(StatefulProcessor):
    """`allowed` for each call; a failure that was allowed starts the cool-down, a success ends it."""

    def __init__(self, cooldown: float):
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tripped", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        tripped = self.state.get()[0] if self.state.exists() else None
        out = []
        for r in sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: (r.at, r.event_id)):
            ok = tripped is None or r.at - tripped >= self.cooldown
            if ok:
                tripped = r.at if r.trip else None
            out.append((key[0], r.at, r.event_id, ok))
        if tripped is None:
            self.state.clear()
        else:
            self.state.update((tripped,))
        yield pd.DataFrame(out, columns=["key", "at", "event_id", "allowed"])

    def close(self) -> None:
        pass


class Limiter(StatefulProcessor):
    """`granted` for each call; a 429 moves the next grant."""

    def __init__(self, gap: float, most: float = 300.0):
        self.gap, self.most = gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("free", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        free = self.state.get()[0] if self.state.exists() else float("-inf")
        out = []
        for r in sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: (r.at, r.event_id)):
            t = max(r.at, free)
            free = t + self.gap
            if r.status == 429:
                wait = 0.0 if pd.isna(r.retry_after) else r.retry_after
                free = max(free, t + min(max(wait, 2 * self.gap), self.most))
            out.append((key[0], r.at, r.event_id, t))
        self.state.update((free,))
        yield pd.DataFrame(out, columns=["key", "at", "event_id", "granted"])

    def close(self) -> None:
        pass


def break_circuits(calls: DataFrame, cooldown: float) -> DataFrame:
    """calls: key, at, event_id, trip. Needs the RocksDB state store."""
    return calls.groupBy("key").transformWithStateInPandas(Breaker(cooldown), "key string, at double, event_id long, allowed boolean", "Append", "None")


def limit_rates(calls: DataFrame, gap: float) -> DataFrame:
    """calls: key, at, event_id, status, retry_after. Needs the RocksDB state store."""
    return calls.groupBy("key").transformWithStateInPandas(Limiter(gap), "key string, at double, event_id long, granted double", "Append", "None")
