"""Counters of running jobs: what passes is counted on its way, in batch and in streams, without another pass."""

from __future__ import annotations

import threading
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def text_counters(given: str = "html", made: str = "text") -> dict[str, Column]:
    """Rows, characters in and out, and rows without any result."""
    size = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    return {"rows": F.count(F.lit(1)), "input_chars": size(given), "output_chars": size(made), "empty": F.coalesce(F.sum((F.coalesce(F.length(made), F.lit(0)) == 0).cast("long")), F.lit(0))}


def observed(df: DataFrame, counters: dict[str, Column], name: str = "counters") -> tuple[DataFrame, Observation]:
    """The same rows, and the counters of the first action over them (``observation.get`` waits for it). Executors add up as rows pass, and a stage that runs again does not count twice."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in counters.items())), seen


class Counters(StreamingQueryListener):
    """Adds up the counters of streams' batches by the name of the observation: ``totals``. Use with ``df.observe(name, ...)`` and ``spark.streams.addListener``.

    A batch that is tried again after a failure reports once it ends, with the same number, and counts once.
    """

    def __init__(self) -> None:
        self.lock, self.seen, self.totals = threading.Lock(), set(), {}

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p = event.progress
        with self.lock:
            for name, row in p.observedMetrics.items():
                mark = (str(p.id), p.batchId, name)
                if mark not in self.seen:
                    self.seen.add(mark)
                    total = self.totals.setdefault(name, {})
                    for k, v in row.asDict().items():
                        total[k] = total.get(k, 0) + (v or 0)

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass
