"""Rules that depend on what came before: idle sessions, caches, throttles, failover. Each is a window or a fold over one key's events.

The folds have no place for an event without a time (or, in ``bounded_sessions``, without a key): such events are left out of their results.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.streamed import folded


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def idle_sessions(events: DataFrame, gap_seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Sessions of each key, which end when it is idle for longer than the gap: key, session (from 1), started, ended, events."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    idle = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(order)
    marked = events.withColumn("_new", F.coalesce((idle > int(gap_seconds * 1_000_000)).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("_new").over(order))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events"))


def _fold(events: DataFrame, interval: int, boundary: bool, key: str, ts: str, tie: str) -> DataFrame:
    """For each event whether it opens an interval: it does when the one that did so last is further back than the interval (or as far, with the boundary). Others do not move the interval.

    Each opening depends on the one before, so a key's events are streamed in order past the time of the last opening, which is all that is held.
    """

    def opened(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for t, i in rows:
            age = None if last is None else t - last
            opens = age is None or age > interval or (boundary and age == interval)
            last = t if opens else last
            yield i, opens, None if opens else age / 1e6

    slim = events.select(key, micros(F.col(ts)).alias("t"), F.col(tie).alias("tie")).where("t is not null")
    return folded(slim, f"`{tie}` {dict(events.dtypes)[tie]}, opens boolean, age_seconds double", opened)


def cache_hits(events: DataFrame, ttl_seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """For each request whether the cache answers it: an entry lives for the time to live from the miss that made it, and hits do not renew it. key, tie, hit, age_seconds."""
    return _fold(events, int(ttl_seconds * 1_000_000), False, key, ts, tie).select(key, tie, (~F.col("opens")).alias("hit"), "age_seconds")


def throttle(events: DataFrame, interval_seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """For each request whether it is let through: the last one that was is at least the interval back. key, tie, accepted."""
    return _fold(events, int(interval_seconds * 1_000_000), True, key, ts, tie).select(key, tie, F.col("opens").alias("accepted"))


def chain_throttle(requests: DataFrame, interval_seconds: float, group: str = "service", chain: str = "providers", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """For each request with a chain of providers whether it is let through: none of them was charged within the interval. One that is let through charges them all; one that is refused charges none. group, tie, accepted.

    Chains tie providers together, so the requests of a group (a service, a tenant) are one ordered stream; what is held is a time for each provider.
    """
    interval = int(interval_seconds * 1_000_000)

    def judged(rows: Iterator[tuple]) -> Iterator[tuple]:
        charged: dict[str, int] = {}
        for t, i, providers in rows:
            free = all(p not in charged or t - charged[p] >= interval for p in providers or ())
            if free:
                charged.update(dict.fromkeys(providers or (), t))
            yield i, free

    slim = requests.select(group, micros(F.col(ts)).alias("t"), F.col(tie).alias("tie"), chain).where("t is not null")
    return folded(slim, f"`{tie}` {dict(requests.dtypes)[tie]}, accepted boolean", judged)


def bounded_sessions(events: DataFrame, most: int, ttl_seconds: float, group: str = "service", key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """What each access finds in a store of at most ``most`` sessions a group: group, tie, found (hit, new, expired), evicted (the session that had to go for a new one, else null).

    A session that has been idle for longer than the time to live has expired when it is asked for, and is opened anew; a full store gives up the one
    least recently used. The store is what is held.
    """
    ttl = int(ttl_seconds * 1_000_000)

    def stored(rows: Iterator[tuple]) -> Iterator[tuple]:
        live: OrderedDict = OrderedDict()
        for t, i, k in rows:
            at = live.pop(k, None)
            state = "new" if at is None else "expired" if t - at > ttl else "hit"
            evicted = live.popitem(last=False)[0] if state != "hit" and len(live) >= most else None
            live[k] = t
            yield i, state, evicted

    kinds = dict(events.dtypes)
    slim = events.select(group, micros(F.col(ts)).alias("t"), F.col(tie).alias("tie"), F.col(key).alias("key")).where("t is not null and key is not null")
    return folded(slim, f"`{tie}` {kinds[tie]}, found string, evicted {kinds[key]}", stored)


def circuit_breaker(calls: DataFrame, open_seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id", failed: str = "failed") -> DataFrame:
    """For each call of a key whether it is made: one that fails keeps all calls within the time after it from being made. key, tie, made. A call that is not made cannot fail, so each one depends on those before it."""
    span = int(open_seconds * 1_000_000)

    def judged(rows: Iterator[tuple]) -> Iterator[tuple]:
        until = None
        for t, i, bad in rows:
            made = until is None or t >= until
            if made and bad:
                until = t + span
            yield i, made

    slim = calls.select(key, micros(F.col(ts)).alias("t"), F.col(tie).alias("tie"), F.col(failed).alias("bad")).where("t is not null")
    return folded(slim, f"`{tie}` {dict(calls.dtypes)[tie]}, made boolean", judged)


def nth_occurrence(rows: DataFrame, same: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Adds the place of each row, from 0, among those that are the same."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*same).orderBy(*order)) - 1)


def first_answer(attempts: DataFrame, key: str, priority: str = "priority", status: str = "status", result: str = "result") -> DataFrame:
    """The answer of each request's chain of providers: the first that is ok, unless one before it was rejected or empty, which ends the chain.

    ``status``: ok, empty, rejected, or what may be tried again elsewhere (unavailable, rate_limited). One aggregation: the first final
    attempt decides.
    """
    final = F.col(status).isin("ok", "empty", "rejected")
    out = attempts.groupBy(key).agg(F.min_by(F.struct(status, result, priority), F.when(final, F.col(priority))).alias("_end"), F.max(priority).alias("_last"))
    return out.select(key, F.coalesce(F.col(f"_end.{status}"), F.lit("unavailable")).alias("outcome"), F.when(F.col(f"_end.{status}") == "ok", F.col(f"_end.{result}")).alias("answer"), F.coalesce(F.col(f"_end.{priority}"), F.col("_last")).alias("tried"))


def error_class(status: Column) -> Column:
    """What an HTTP status means for a chain of providers."""
    return F.when(status.between(200, 299), "ok").when(status == 429, "rate_limited").when(status.isin(408, 425) | (status >= 500) | status.isNull(), "unavailable").otherwise("rejected")
