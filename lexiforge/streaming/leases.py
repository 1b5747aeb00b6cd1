"""Leases as keyed state of a stream, with timers: a lease runs out without an event.

Each key's state is its status, epoch and the end of its lease. Events move it under the fence of
epoch and expiry; a timer of event time is set to the end of each lease. When the watermark passes
it, or an event behind it comes first, the lease ends and a row says so, once. State is kept by
key in RocksDB, three values a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: State of this kind is kept there; Spark's other store has no timers and no time to live.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTCOMES = "user_id long, event_id long, outcome string, epoch long, at long"


class Leases(StatefulProcessor):
    """``step(state, row)`` as in a batch fold: state (status, epoch, expires in microseconds), row with ``t`` in microseconds."""

    def __init__(self, key: str, step: Callable[[tuple, dict], tuple[tuple, dict]]):
        self.key, self.step = key, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "status string, epoch long, expires long")

    def current(self) -> tuple[str, int, int]:
        found = self.lease.get() if self.lease.exists() else None
        return (found[0], found[1], found[2]) if found is not None else ("pending", 0, 0)

    @staticmethod
    def due(state: tuple[str, int, int]) -> int | None:
        """The milliseconds at which a running lease has run out."""
        return -(-state[2] // 1000) if state[0] == "running" else None

    def ran_out(self, key: int, state: tuple[str, int, int]) -> tuple[tuple[str, int, int], dict]:
        return ("pending", *state[1:]), {self.key: key, "event_id": None, "outcome": "expired", "epoch": state[1], "at": state[2]}

    def frame(self, rows: list[dict]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=[self.key, "event_id", "outcome", "epoch", "at"])
        return found.astype({self.key: "Int64", "event_id": "Int64", "epoch": "Int64", "at": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self.current(), []
        before = self.due(state)
        # a batch's files bound what is put in order at a time
        for row in pd.concat(list(rows)).sort_values("event_id").to_dict("records"):
            if state[0] == "running" and state[2] <= row["t"]:
                state, said = self.ran_out(key[0], state)
                out.append(said)
            state, made = self.step(state, row)
            out.append({self.key: key[0], "at": row["t"]} | made)
        after = self.due(state)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        self.lease.update(state)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.current()
        if self.due(state) != expiredTimerInfo.getExpiryTimeInMs():
            return  # renewed since
        state, said = self.ran_out(key[0], state)
        self.lease.update(state)
        yield self.frame([said])

    def close(self) -> None: ...


def lease_outcomes(events: DataFrame, key: str, step: Callable[[tuple, dict], tuple[tuple, dict]], schema: str | StructType = OUTCOMES, late: str = "0 seconds") -> DataFrame:
    """What each event of ``events`` (key, event_id, ts, t, ...) does, and each lease that runs out; use with mode ``append``.

    ``late``: how far events may be behind the latest one; leases end that much later.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=Leases(key, step), outputStructType=schema, outputMode="append", timeMode="EventTime")
