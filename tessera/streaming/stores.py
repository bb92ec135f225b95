"""Stores with a time to live as streams: sessions, caches and breakers whose state goes by timers once it can matter no more.

Each has a batch operator with the same rule in ``operators.stateful``. They need the state store that holds several states of a key
(``use_rocksdb``). Times are those of the events: a timer fires when the watermark passes it.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Generator, Iterator
from itertools import islice
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.shipping import ship

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Set the state store for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


#: Rows of a key that are sorted at once, and rows that are read back or given out at once.
SORTED, READ = 100_000, 5_000


def _spilled(rows: list[tuple]) -> Iterator[tuple]:
    """Sorted rows, put into a file of this task and read back a few at a time."""
    f = tempfile.TemporaryFile()
    for i in range(0, len(rows), READ):
        pickle.dump(rows[i : i + READ], f)
    f.seek(0)

    def read() -> Iterator[tuple]:
        with f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    return read()


def _ordered(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The rows of a key in a batch, by time and tie: sorted runs that are merged, so a task holds a run and no key."""
    place = itemgetter(1, 2)
    runs: list[Iterator[tuple]] = []
    held: list[tuple] = []
    for part in rows:
        held += part.itertuples(index=False, name=None)
        if len(held) >= SORTED:
            runs.append(_spilled(sorted(held, key=place)))
            held = []
    return heapq.merge(*runs, sorted(held, key=place), key=place)


class _Processor(StatefulProcessor):
    """What the processors share: the columns of their answers, and a timer for each key at the time from which its state is of no use."""

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def answers(self, rows: Iterator[tuple]) -> Generator[tuple, None, int | None]:
        """Gives the answers, and returns the time in microseconds at which the state may go."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end: int | None = None

        def given() -> Iterator[tuple]:
            nonlocal end
            end = yield from self.answers(_ordered(rows))

        answers = given()
        while out := list(islice(answers, READ)):
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.columns])
        if end is not None:
            at = end // 1000 + 1
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forget()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Cache(_Processor):
    columns = ("tie", "hit", "age_seconds")

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def open(self) -> None:
        self.made = self.handle.getValueState("made", "at long")

    def answers(self, rows: Iterator[tuple]) -> Generator[tuple, None, int | None]:
        at = self.made.get()[0] if self.made.exists() else None
        for _, t, tie, _ in rows:
            age = None if at is None else t - at
            hit = age is not None and age <= self.ttl
            at = at if hit else t
            yield tie, hit, age / 1e6 if hit else None
        self.made.update((at,))
        return at + self.ttl

    def forget(self) -> None:
        self.made.clear()


class _Breaker(_Processor):
    columns = ("tie", "made")

    def __init__(self, span: int) -> None:
        self.span = span

    def open(self) -> None:
        self.until = self.handle.getValueState("until", "at long")

    def answers(self, rows: Iterator[tuple]) -> Generator[tuple, None, int | None]:
        until = self.until.get()[0] if self.until.exists() else None
        for _, t, tie, bad, _ in rows:
            made = until is None or t >= until
            if made and bad:
                until = t + self.span
            yield tie, made
        if until is not None:
            self.until.update((until,))
        return until

    def forget(self) -> None:
        self.until.clear()


class _Sessions(_Processor):
    columns = ("tie", "found", "evicted")

    def __init__(self, most: int, ttl: int) -> None:
        self.most, self.ttl = most, ttl

    def open(self) -> None:
        self.live = self.handle.getMapState("live", "session string", "at long, place long")
        self.order = self.handle.getValueState("order", "place long")

    def answers(self, rows: Iterator[tuple]) -> Generator[tuple, None, int | None]:
        live = {k[0]: v for k, v in self.live.iterator()}
        before = dict(live)
        place = self.order.get()[0] if self.order.exists() else 0
        for _, t, tie, session, _ in rows:
            at = live.pop(session, None)
            found = "new" if at is None else "expired" if t - at[0] > self.ttl else "hit"
            evicted = None
            if found != "hit" and len(live) >= self.most:
                evicted = min(live, key=lambda s: live[s][1])  # the one used longest ago
                del live[evicted]
            place += 1
            live[session] = (t, place)
            yield tie, found, evicted
        for k in before.keys() - live.keys():
            self.live.removeKey((k,))
        for k in live:
            if live[k] != before.get(k):
                self.live.updateValue((k,), live[k])
        self.order.update((place,))
        return max(t for t, _ in live.values()) + self.ttl

    def forget(self) -> None:
        self.live.clear()
        self.order.clear()


def _stream(events: DataFrame, processor: StatefulProcessor, schema: str, key: str, ts: str, tie: str, delay: str, more: list[Column]) -> DataFrame:
    ship(events.sparkSession)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    # The watermark's own column must reach the operator; it comes last, after what the processor reads.
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(F.col(key).alias("key"), micros.alias("t"), F.col(tie).alias("tie"), *more, F.col(ts).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def cache_hits(events: DataFrame, ttl_seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """``stateful.cache_hits`` as a stream: key, tie, hit, age_seconds. An entry's state goes when the watermark passes its time to live, when no request that still may come can hit it. Events without a time are left out, as in batch."""
    kinds = dict(events.dtypes)
    return _stream(events, _Cache(int(ttl_seconds * 1_000_000)), f"key {kinds[key]}, tie {kinds[tie]}, hit boolean, age_seconds double", key, ts, tie, delay, [])


def circuit_breaker(calls: DataFrame, open_seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id", failed: str = "failed", delay: str = "10 minutes") -> DataFrame:
    """``stateful.circuit_breaker`` as a stream: key, tie, made. The state is the time until which calls are not made, and goes when the watermark passes it."""
    kinds = dict(calls.dtypes)
    return _stream(calls, _Breaker(int(open_seconds * 1_000_000)), f"key {kinds[key]}, tie {kinds[tie]}, made boolean", key, ts, tie, delay, [F.col(failed).alias("bad")])


def bounded_sessions(events: DataFrame, most: int, ttl_seconds: float, group: str = "service", key: str = "user_id", ts: str = "ts", tie: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """``stateful.bounded_sessions`` as a stream: key (the group), tie, found, evicted (as text). The state is a map of ``most`` sessions at most; it goes when the watermark passes the last one's time to live."""
    kinds = dict(events.dtypes)
    rows = events.where(F.col(key).isNotNull())
    return _stream(rows, _Sessions(most, int(ttl_seconds * 1_000_000)), f"key {kinds[group]}, tie {kinds[tie]}, found string, evicted string", group, ts, tie, delay, [F.col(key).cast("string").alias("session")])
