"""Recorded answers of search providers as a data source: ``spark.read.format("recorded_answers")``.

The recordings are a table (query, provider, priority, status, body) that Spark can read. The source takes it as JSON lines in files by query, and yields the hits as rows, so
that what a provider's answer looks like stays inside the source, as with a live connector.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThanOrEqual
from pyspark.sql.types import StructType

from tessera.shipping import ship
from tessera.sources.results import PROVIDERS, RESULTS

SCHEMA = "query string, provider string, rank int, title string, url string, snippet string, published_at string, score double, outcome string"


def record(answers: DataFrame, path: str, files: int | None = None) -> None:
    """Write answers as recordings: JSON lines, the answers of a query next to each other in one file, in order of priority. ``path`` is a folder that driver and executors share, as a plain path or file: URL."""
    rows = answers.select("query", "provider", F.col("priority").cast("int").alias("priority"), F.col("status").cast("int").alias("status"), "body")
    dealt = rows.repartition(files, "query") if files else rows.repartition("query")
    dealt.sortWithinPartitions("query", "priority", "provider").write.json(path)


def _class(status: int | None) -> str:
    if status is None or status in (408, 425) or status >= 500:
        return "unavailable"
    return "rate_limited" if status == 429 else "ok" if 200 <= status < 300 else "rejected"


def _items(provider: str, body: str | None) -> list[dict]:
    """The hits in an answer; none where it is no JSON or has none where the provider puts them."""
    try:
        at = json.loads(body or "")
    except ValueError:
        return []
    for name in PROVIDERS[provider][0].split(".")[1:] if provider in PROVIDERS else ["?"]:
        at = at.get(name) if isinstance(at, dict) else None
    return [x for x in at if isinstance(x, dict)] if isinstance(at, list) else []


def _outcome(provider: str, status: int | None, body: str | None) -> str:
    if provider == "bocha":
        try:
            code = json.loads(body or "").get("code")
            if code is not None and int(code) != 200:
                return _class(int(code))
        except (ValueError, AttributeError, TypeError):
            pass
    return _class(status)


def _number(x: Any) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


@dataclass
class _File(InputPartition):
    path: str


class RecordedReader(DataSourceReader):
    """A partition for each file. Filters on provider (equal, in), query (equal, in) and rank (at most) are pushed down: a query's other answers are not even parsed."""

    def __init__(self, path: str, limit: int, chain: bool) -> None:
        self.path, self.limit, self.chain = path, max(RESULTS[0], min(limit, RESULTS[1])), chain
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            # With the chain a provider answers only where those before it don't, so its filter is for Spark.
            if isinstance(f, (EqualTo, In)) and (name == "query" or (name == "provider" and not self.chain)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            elif isinstance(f, LessThanOrEqual) and name == "rank":
                self.limit = min(self.limit, int(f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.path) if n.endswith(".json"))
        return [_File(os.path.join(self.path, n)) for n in names]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as lines:
            done = None
            for line in lines:
                r = json.loads(line)
                query, provider = r.get("query"), r.get("provider")
                if any(r.get(k) not in v for k, v in self.wanted.items()) or (self.chain and done is not None and done[0] == query):
                    continue
                outcome = _outcome(provider, r.get("status"), r.get("body"))
                if self.chain and outcome in ("ok", "rejected"):
                    done = (query,)
                if outcome != "ok" or self.limit < 1:
                    continue
                title, url, snippet, date, score = PROVIDERS[provider][1] if provider in PROVIDERS else (None,) * 5
                rank = 0
                for x in _items(provider, r.get("body")):
                    text = lambda n, x=x: None if n is None or x.get(n) is None else str(x[n])
                    if text(url):
                        rank += 1
                        if rank > self.limit:
                            break
                        yield query, provider, rank, text(title), text(url), text(snippet), text(date), _number(x.get(score)) if score else None, outcome


class RecordedAnswers(DataSource):
    """Options: ``path``; ``limit`` of hits an answer (10; 20 at most); ``chain``: true (the first provider whose answer decides) or false (all)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordedReader:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        return RecordedReader(path, int(self.options.get("limit", "10")), self.options.get("chain", "true") == "true")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedAnswers)
