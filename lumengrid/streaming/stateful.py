"""Streams with state of their own: sessions that are kept per key, closed by event-time timers, late rows left out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting and value that operators with state variables need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "starts array<long>, ends array<long>, counts array<long>, sums array<double>"


def merge_sessions(sessions: list[tuple], gap: int) -> list[tuple]:
    """Sessions (start, end, rows, sum) with those nearer than the gap put together."""
    out: list[tuple] = []
    for start, end, n, v in sorted(sessions):
        if out and start - out[-1][1] < gap:
            a, b, m, w = out[-1]
            out[-1] = (a, max(b, end), m + n, w + v)
        else:
            out.append((start, end, n, v))
    return out


class Sessions(StatefulProcessor):
    """Open sessions of one key; a timer at the end of the earliest one's gap emits what the watermark has passed."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _read(self) -> list[tuple]:
        return list(zip(*self.open.get())) if self.open.exists() else []

    def _write(self, sessions: list[tuple]) -> None:
        if not sessions:
            self.open.clear()
            return
        self.open.update(tuple(list(c) for c in zip(*sessions)))
        self.handle.registerTimer(min(end for _, end, _, _ in sessions) + self.gap)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        passed, found = timerValues.getCurrentWatermarkInMs(), self._read()
        for part in rows:
            for at, v in zip(part["at"].tolist(), part["value"].tolist()):
                if at >= passed:
                    found.append((at, at, 1, v))
        self._write(merge_sessions(found, self.gap))
        yield pd.DataFrame({"user_id": [], "start": [], "end": [], "n": [], "v": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs()
        done = [s for s in self._read() if s[1] + self.gap <= passed]
        self._write([s for s in self._read() if s[1] + self.gap > passed])
        columns = list(zip(*done)) if done else [[]] * 4
        yield pd.DataFrame({"user_id": [key[0]] * len(done), "start": columns[0], "end": columns[1], "n": columns[2], "v": columns[3]})

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap_ms: int, late: str = "2 hours") -> DataFrame:
    """Sessions (user_id, start, end in milliseconds, n, v) of a stream of events (user_id, ts, value), each emitted once, when it can't grow any more.

    Rows behind the watermark (``late`` behind the latest row of earlier
    batches) are left out; state holds open sessions only.  Null users, times
    and values are left out.
    """
    clean = events.where("user_id is not null and ts is not null and value is not null").withWatermark("ts", late)
    picked = clean.select("user_id", "ts", F.unix_millis("ts").alias("at"), F.col("value").cast("double").alias("value"))
    return picked.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Sessions(gap_ms), outputStructType="user_id long, start long, end long, n long, v double", outputMode="append", timeMode="EventTime")
