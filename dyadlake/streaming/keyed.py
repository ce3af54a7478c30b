"""State by key on streams: events are put in order of time first, then folded into what the key remembers.

An event waits in its key's list state until the watermark has passed it, when a timer folds it in, so events that come out of order by less than ``events.LATE`` are still folded in order.
Later ones are dropped, as by every other operator with a watermark. A key's state is its events of that time and what it remembers, and the latter goes, by another timer, once the key has had no event for ``keep``: a key that comes back later starts anew.
State lies in RocksDB, so a key's waiting events are appended to and not rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from dyadlake.streaming import events as E

Fold = Callable[[list, list], tuple[list, list]]
#: How long a silent key is remembered, in milliseconds.
KEEP = 400 * 24 * 3600 * 1000
_WAITING = StructType([StructField("at", LongType()), StructField("id", LongType()), StructField("value", LongType())])
_PAST = StructType([StructField("past", ArrayType(LongType())), StructField("last", LongType())])
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rolling_sum(rows: int) -> Fold:
    """The sum over a key's last ``rows`` events, its own included; nulls count as 0."""

    def fold(past: list, values: list) -> tuple[list, list]:
        line = pd.Series([*past, *values], dtype="Int64").fillna(0)
        return line.rolling(rows, min_periods=1).sum().astype("int64").tolist()[len(past) :], line.tolist()[max(len(line) - (rows - 1), 0) :]

    return fold


def last_before(past: list, values: list) -> tuple[list, list]:
    """The key's last value that is not null before each event."""
    out = []
    for v in values:
        out.append(past[0] if past else None)
        past = past if v is None else [v]
    return out, past


class InOrder(StatefulProcessor):
    """One key's waiting events, what it remembers and its two timers."""

    def __init__(self, fold: Fold, key: str, name: str, keep: int):
        self.fold, self.key, self.name, self.keep = fold, key, name, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.past = handle.getValueState("past", _PAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Events wait; the first of them to come due sets a timer."""
        least = None
        for f in rows:
            new = [(int(a), int(i), None if pd.isna(v) else int(v)) for a, i, v in zip(f["us"], f["event_id"], f["value"], strict=True)]
            if new:
                self.waiting.appendList(new)
                least = min([least, *(a for a, _, _ in new)], key=lambda a: float("inf") if a is None else a)
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Folds in what the watermark has passed, or forgets a key that was silent for long."""
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] // 1000 < now]
        past, last = ([], None)
        if self.past.exists():
            past, last = self.past.get()
        if not ready:
            if not waiting and last is not None and last + self.keep < now:
                self.past.clear()
            return
        found, past, start = [], list(past), 0
        for i, (at, _, _) in enumerate(ready):
            if last is not None and at // 1000 > last + self.keep:  # silent for too long: forgotten, whether or not its timer has come
                more, past = self.fold(past, [v for _, _, v in ready[start:i]])
                found, past, start = found + more, [], i
            last = at // 1000
        more, past = self.fold(past, [v for _, _, v in ready[start:]])
        found += more
        left = waiting[len(ready) :]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        self.past.update((past, last))
        self.handle.registerTimer(last + self.keep + 1)
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(ready), dtype="Int64"), "event_id": [i for _, i, _ in ready], self.name: pd.Series(found, dtype="Int64")})

    def close(self) -> None:
        """Nothing is held outside the state."""


def in_order(events: DataFrame, key: str, value: str, fold: Fold, name: str, keep: int = KEEP) -> DataFrame:
    """(key, event_id, ``name``) of the events that the watermark has passed. ``events``: at, event_id and the bigint columns named; a null key is a key. ``keep``: milliseconds that a silent key is remembered."""
    events.sparkSession.conf.set(_PROVIDER, _ROCKS)  # the only store with lists and timers
    own = E.timed(events).withWatermark("at", E.LATE).select(F.col(key).cast("long").alias("key"), "event_id", "at", F.unix_micros("at").alias("us"), F.col(value).cast("long").alias("value"))
    return own.groupBy("key").transformWithStateInPandas(InOrder(fold, key, name, keep), f"{key} bigint, event_id bigint, {name} bigint", "append", "eventTime")
