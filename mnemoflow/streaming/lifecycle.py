"""Sessions with a life: started and touched by events, ended explicitly, by inactivity or by age, kept as state with timers.

A conversation has one session at a time. Its state is four numbers; a timer in event time ends it at the earlier of last activity
plus timeout and start plus time to live, and the state goes with it, so that what is held grows with the open sessions alone.
An event that comes after such a deadline but before the timer ends the old session as the timer would have, and starts a new one. Rows
of a micro-batch are taken in order of time; rows older than the watermark (`delay` behind the newest event) are dropped by
Spark, which is what lets state end. Rows without key or time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDED = "key long, started_us long, last_us long, n long, reason string, ended_us long"
STATE = "started_us long, last_us long, n long, timer_ms long"
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deadline(started: int, last: int, timeout: int, ttl: int | None) -> tuple[int, str]:
    """When an open session ends by itself, and why; inactivity goes before age."""
    by_age = started + ttl if ttl is not None else None
    return (last + timeout, "timeout") if by_age is None or last + timeout <= by_age else (by_age, "ttl_expired")


def step(state: tuple[int, int, int] | None, us: int, kind: str, timeout: int, ttl: int | None) -> tuple[tuple[int, int, int] | None, list[tuple]]:
    """The session (started, last, n) after an event, and the sessions that it ends: (started, last, n, reason, ended)."""
    ended = []
    if state is not None:
        end, reason = deadline(state[0], state[1], timeout, ttl)
        if us >= end:
            ended.append((*state, reason, end))
            state = None
    if kind == "end":
        if state is not None:
            ended.append((state[0], us, state[2] + 1, "explicit", us))
        return None, ended
    return ((us, us, 1) if state is None else (state[0], max(state[1], us), state[2] + 1)), ended


class Sessions(StatefulProcessor):
    """Rows (key, us, kind) to ended sessions; kind `end` ends, anything else starts or touches."""

    def __init__(self, timeout: int, ttl: int | None):
        self.timeout, self.ttl = timeout, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", STATE)

    def _rows(self, key: int, ended: list[tuple]) -> Iterator[pd.DataFrame]:
        if ended:
            yield pd.DataFrame([(key, *e) for e in ended], columns=["key", "started_us", "last_us", "n", "reason", "ended_us"])

    def _put(self, session: tuple[int, int, int] | None, old_timer: int | None) -> None:
        if old_timer is not None:
            self.handle.deleteTimer(old_timer)
        if session is None:
            self.state.clear()
            return
        # Timers know milliseconds: the first one that is not before the deadline.
        timer = -(-deadline(session[0], session[1], self.timeout, self.ttl)[0] // 1000)
        self.handle.registerTimer(timer)
        self.state.update((*session, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        session, timer, ended = (tuple(held[:3]), held[3], []) if held else (None, None, [])
        every = pd.concat(list(rows)).sort_values(["us", "kind"], kind="stable")
        for us, kind in zip(every["us"].tolist(), every["kind"].tolist(), strict=True):
            session, more = step(session, us, kind, self.timeout, self.ttl)
            ended += more
        self._put(session, timer)
        yield from self._rows(key[0], ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get()
        if held is None:
            return
        end, reason = deadline(held[0], held[1], self.timeout, self.ttl)
        self.state.clear()
        yield from self._rows(key[0], [(held[0], held[1], held[2], reason, end)])

    def close(self) -> None:
        pass


def ended_sessions(events: DataFrame, timeout_s: int = 1800, ttl_s: int | None = None, delay_s: int = 600) -> DataFrame:
    """The sessions of a stream of events(key, ts, kind) that have ended, as ENDED rows, to be written in append mode."""
    spark = events.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    keyed = events.where("key is not null and ts is not null").select(F.col("key").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("kind", F.lit("touch")).alias("kind")).withWatermark("ts", f"{delay_s} seconds")
    own = keyed.select("key", "ts", F.unix_micros("ts").alias("us"), "kind")
    return own.groupBy("key").transformWithStateInPandas(Sessions(timeout_s * 1_000_000, None if ttl_s is None else ttl_s * 1_000_000), ENDED, "Append", "EventTime")
