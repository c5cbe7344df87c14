"""Event-driven capture with hysteresis, in batches and as a stream (an extension: the reference polls sensors in loops).

A sample above ``trigger`` opens a window of ``length`` milliseconds; the first sample at or after its end still counts, and then its peak is given out;
nothing opens until a later sample at or below ``reset`` has been seen. With ``idle``, a window that gets no sample until so many milliseconds after its end is given out without one; with ``forget``,
a key without samples for longer than that begins anew. Both are in the samples' own time, so tables and streams agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

IDLE, CAPTURE, WAIT = 0, 1, 2
OUT = "key long, opened long, peak double, samples long"
STATE = "mode int, opened long, peak double, samples long, last long"


class Rules(NamedTuple):
    trigger: float = 50
    reset: float = 25
    length: int = 60
    idle: int | None = None
    forget: int | None = None


class State(NamedTuple):
    """What a key is known by: its mode, its open window, and the time of its last sample."""

    mode: int = IDLE
    opened: int = 0
    peak: float = 0.0
    samples: int = 0
    last: int = 0


def overdue(state: State, now: int, rules: Rules) -> tuple[State, tuple | None]:
    """The state once no sample before ``now`` can come any more: a window may be over without another sample, and a key may be forgotten."""
    done = None
    if state.mode == CAPTURE and rules.idle is not None and now > state.opened + rules.length + rules.idle:
        state, done = State(WAIT, last=state.last), (state.opened, state.peak, state.samples)
    if state.mode == WAIT and rules.forget is not None and now > state.last + rules.forget:
        state = State()
    return state, done


def advance(state: State, ms: int, value: float, rules: Rules) -> tuple[State, list[tuple]]:
    """The state after one more sample, and the captures (opened, peak, samples) that are over."""
    state, done = overdue(state, ms, rules)
    out = [done] if done else []
    if state.mode == CAPTURE:
        peak, n = max(state.peak, value), state.samples + 1
        if ms >= state.opened + rules.length:
            return State(WAIT, last=ms), [*out, (state.opened, peak, n)]
        return State(CAPTURE, state.opened, peak, n, ms), out
    if state.mode == WAIT:
        return State(IDLE if value <= rules.reset else WAIT, last=ms), out
    return State(CAPTURE, ms, value, 1, ms) if value > rules.trigger else State(last=ms), out


def next_due(state: State, rules: Rules) -> int | None:
    """The first moment at which ``overdue`` may change the state."""
    if state.mode == CAPTURE and rules.idle is not None:
        return state.opened + rules.length + rules.idle + 1
    if state.mode == WAIT and rules.forget is not None:
        return state.last + rules.forget + 1
    return None


def captures(df: DataFrame, key: str, ms: str, value: str, trigger: float = 50, reset: float = 25, length: int = 60, idle: int | None = None, forget: int | None = None) -> DataFrame:
    """(key, opened, peak, samples) of a table of samples, each key in the order of time. Samples come to a task sorted by Spark, in Arrow batches, so a
    task holds a batch and one small state, however many samples a key has. Windows that are open at the end are given out if ``idle`` is set.
    """
    rules = Rules(trigger, reset, length, idle, forget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()

        def closed():
            done = overdue(state, 1 << 62, rules)[1]
            return [(key, *done)] if done else []

        for pdf in batches:
            out = []
            for k, m, v in zip(pdf["key"].tolist(), pdf["ms"].tolist(), pdf["value"].tolist(), strict=True):
                if k != key:
                    out += closed()
                    key, state = k, State()
                state, done = advance(state, m, v, rules)
                out += [(k, *d) for d in done]
            yield pd.DataFrame(out, columns=["key", "opened", "peak", "samples"])
        yield pd.DataFrame(closed(), columns=["key", "opened", "peak", "samples"])

    s = df.select(F.col(key).cast("long").alias("key"), F.col(ms).cast("long").alias("ms"), F.col(value).cast("double").alias("value"))
    return s.repartition("key").sortWithinPartitions("key", "ms", "value").mapInPandas(run, OUT)


class Capturing(StatefulProcessor):
    """Samples wait in a buffer of the key until the watermark has passed them, and are then taken in the order of time, so they may come in any order within the watermark's delay. A timer in event time goes off for the
    first that waits, for a window that is over without a sample, and for a key that is to be forgotten. A key that is idle and has nothing waiting has no state.
    """

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.early = handle.getListState("early", "ms long, value double")

    def _settle(self, key: tuple, new: list[tuple[int, float]], watermark: int) -> Iterator[pd.DataFrame]:
        state = State(*self.state.get()) if self.state.exists() else State()
        waiting = sorted([*((r[0], r[1]) for r in self.early.get()), *new] if self.early.exists() else new)
        ready = [x for x in waiting if x[0] <= watermark]
        out = []
        for m, v in ready:
            state, done = advance(state, m, v, self.rules)
            out += done
        state, done = overdue(state, watermark + 1, self.rules)
        out += [done] if done else []
        left = waiting[len(ready) :]
        if left:
            self.early.put(left)
        elif self.early.exists():
            self.early.clear()
        if state.mode == IDLE:
            if self.state.exists():
                self.state.clear()
        else:
            self.state.update(tuple(state))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [t for t in (left[0][0] if left else None, next_due(state, self.rules)) if t is not None]
        if due:
            self.handle.registerTimer(max(min(due), watermark + 1))
        yield pd.DataFrame([(key[0], *d) for d in out], columns=["key", "opened", "peak", "samples"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        new = [x for pdf in rows for x in zip(pdf["ms"].tolist(), pdf["value"].tolist(), strict=True)]
        return self._settle(key, [x for x in new if x[0] > now], now)  # what the watermark has passed is late

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return self._settle(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_captures(df: DataFrame, trigger: float = 50, reset: float = 25, length: int = 60, delay: str = "1 minute", idle: int | None = None, forget: int | None = None) -> DataFrame:
    """The same over a stream of (key, ms, value) whose samples are at most ``delay`` out of order; later ones are dropped. What a key holds is its state and the samples of one delay.

    Needs the RocksDB state store. Without ``idle`` and ``forget``, windows without a later sample stay open and waiting keys stay known, as in a table.
    """
    at = df.select(F.col("key").cast("long").alias("key"), F.col("ms").cast("long").alias("ms"), F.col("value").cast("double").alias("value"), F.timestamp_millis("ms").alias("at"))
    return at.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(Capturing(Rules(trigger, reset, length, idle, forget)), OUT, "append", "eventTime")
