"""Per-node memory over a stream: a decayed sum that late rows can't change and idleness ends."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SHAPE = "id long, t timestamp, state double, n long, ended boolean"


class DecayedMemory(StatefulProcessor):
    """State of a node: the sum of its values, halved for every ``half_life`` seconds since, the
    time of the latest and their number.  A timer ends it ``idle`` seconds after the latest."""

    def __init__(self, half_life: float, idle: float):
        self.half_life, self.idle = half_life, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "state double, micros long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, at, n = self.memory.get() if self.memory.exists() else (0.0, None, 0)
        floor = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            frame = frame[frame["at"].dt.as_unit("us").astype("int64") >= floor].sort_values(["at", "value"])
            for t, value in zip(frame["at"], frame["value"], strict=True):
                now = pd.Timestamp(t).value // 1000
                if at is None or now >= at:
                    state = (state * 0.5 ** ((now - at) / 1e6 / self.half_life) if at is not None else 0.0) + value
                    at = now
                else:  # within the watermark, but after a later one
                    state += value * 0.5 ** ((at - now) / 1e6 / self.half_life)
                n += 1
        if at is None:
            return
        self.memory.update((float(state), int(at), int(n)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(at // 1000 + self.idle * 1000))
        yield pd.DataFrame({"id": [key[0]], "t": [pd.Timestamp(at, unit="us")], "state": [float(state)], "n": [int(n)], "ended": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, at, n = self.memory.get()
        self.memory.clear()
        yield pd.DataFrame({"id": [key[0]], "t": [pd.Timestamp(at, unit="us")], "state": [float(state)], "n": [int(n)], "ended": [True]})

    def close(self) -> None:
        pass


def node_memory(events: DataFrame, late: str = "2 days", half_life: float = 86_400.0, idle: float = 7 * 86_400.0) -> DataFrame:
    """``(id, t, state, n, ended)``: a row for each batch of a node's events and one when its memory ends.

    ``events(id, at, value)`` is a stream.  Rows older than the watermark are dropped, here by the
    watermark of the batch they come in (the engine's own filter is a batch behind); a node's
    state is three numbers, and it is freed once the watermark is ``idle`` seconds past its
    latest event, so what the stream holds is bounded by the nodes of that span.  A node's events
    of one batch meet in its task, in slices.
    """
    marked = events.select(F.col("id").cast("long").alias("id"), "at", F.col("value").cast("double").alias("value")).withWatermark("at", late)
    return marked.groupBy("id").transformWithStateInPandas(DecayedMemory(half_life, idle), SHAPE, "Append", "EventTime")
