"""Streams of captures and requests. Each has a batch operator with the same rule, which tests compare it with.

``throttle``, ``cache_hits`` and ``snapshot_diffs`` keep a key's state for as long as the stream runs, as their rules ask for no end of time; ``streaming.stores`` has forms whose state goes once it
can matter no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import text
from tessera.shipping import ship


def new_contents(captures: DataFrame, body: str = "text", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Captures whose content has not come within the watermark's delay; the state keeps hashes only. Empty texts all pass."""
    hashed = captures.withColumn("content_hash", text.text_hash(F.col(body)))
    keyed = hashed.withColumn("_key", F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.col("content_hash")).otherwise(F.uuid()))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def idle_sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap, once the watermark has passed them."""
    session = F.session_window(ts, gap)
    return events.withWatermark(ts, delay).groupBy(key, session.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended")).drop("w")


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, by: str = "event_type", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding windows; a plain use of Spark's own windows."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), by).agg(F.count(F.lit(1)).alias("n"))


def throttle(events: DataFrame, interval_seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Requests with whether they are let through: the last one of the key that was is at least the interval back. The state is that one's time."""
    return _openings(events, int(interval_seconds * 1_000_000), True, key, ts, tie).withColumnRenamed("opens", "accepted").drop("age_seconds")


def cache_hits(events: DataFrame, ttl_seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Requests with whether the cache answers them: an entry lives from the miss that made it. The state is that miss's time."""
    out = _openings(events, int(ttl_seconds * 1_000_000), False, key, ts, tie)
    return out.select("key", "tie", (~F.col("opens")).alias("hit"), "age_seconds")


def _openings(events: DataFrame, interval: int, boundary: bool, key: str, ts: str, tie: str) -> DataFrame:
    ship(events.sparkSession)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", "tie"])
        last = state.get[0] if state.exists else None
        out = []
        for t, i in zip(rows["t"].tolist(), rows["tie"].tolist(), strict=True):
            age = None if last is None else t - last
            opens = age is None or age > interval or (boundary and age == interval)
            out.append((k[0], i, opens, None if opens else age / 1e6))
            last = t if opens else last
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "tie", "opens", "age_seconds"]).astype({"age_seconds": "float64"})

    kinds = dict(events.dtypes)
    slim = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("tie"))
    return slim.groupBy("key").applyInPandasWithState(step, f"key {kinds[key]}, tie {kinds[tie]}, opens boolean, age_seconds double", "last long", "append", GroupStateTimeout.NoTimeout)


def snapshot_diffs(sections: DataFrame, key: str = "page_id", version: str = "version") -> DataFrame:
    """What each visit changed against the one before: key, version, sid, change (first, added, removed, changed).

    ``sections``: key, version, sid, t. A visit's sections come in one batch of the stream; the state is the last visit's ids and hashes.
    """
    ship(sections.sparkSession)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("version")
        old = dict(zip(*state.get, strict=True)) if state.exists else None
        out = []
        for v, visit in rows.groupby("version"):
            new = dict(zip(visit["sid"], visit["hash"], strict=True))
            if old is None:
                out.append((k[0], v, None, "first"))
            else:
                out += [(k[0], v, s, "added") for s in sorted(new.keys() - old.keys())] + [(k[0], v, s, "removed") for s in sorted(old.keys() - new.keys())]
                out += [(k[0], v, s, "changed") for s in sorted(new.keys() & old.keys()) if new[s] != old[s]]
            old = new
        state.update((list(old), list(old.values())))
        yield pd.DataFrame(out, columns=["key", "version", "sid", "change"])

    kind = dict(sections.dtypes)
    slim = sections.select(F.col(key).alias("key"), F.col(version).alias("version"), "sid", text.text_hash(F.col("t")).alias("hash"))
    return slim.groupBy("key").applyInPandasWithState(step, f"key {kind[key]}, version {kind[version]}, sid string, change string", "sids array<string>, hashes array<string>", "append", GroupStateTimeout.NoTimeout)
