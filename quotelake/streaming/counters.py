"""Counts over all batches of streams, however many: rows dropped as late, and what a stream observes of itself."""

from __future__ import annotations

import threading
import time
from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class StreamCounters(StreamingQueryListener):
    """Add it to a session before its streams start: ``counters = StreamCounters.watch(spark)``.

    ``totals(query)`` has ``rows`` read, ``late`` rows that state dropped, and the sums of all observed metrics by name, over
    all batches of the query's runs that this session has seen.
    """

    def __init__(self):
        self._lock, self._sums, self._ended = threading.Lock(), {}, set()

    @classmethod
    def watch(cls, spark: SparkSession) -> StreamCounters:
        counters = cls()
        spark.streams.addListener(counters)
        return counters

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        add = Counter(rows=p.numInputRows, late=sum(op.numRowsDroppedByWatermark for op in p.stateOperators))
        for row in (p.observedMetrics or {}).values():
            add.update({k: int(v) for k, v in row.asDict().items() if isinstance(v, int)})
        with self._lock:
            self._sums.setdefault(str(p.id), Counter()).update(add)

    def onQueryTerminated(self, event):
        with self._lock:
            self._ended.add(str(event.runId))

    def totals(self, query, timeout=30.0) -> dict[str, int]:
        """Counts of a query. Of an ended one all batches are in: its end is told after them, and waited for."""
        until = time.monotonic() + timeout
        while not query.isActive and time.monotonic() < until:
            with self._lock:
                if str(query.runId) in self._ended:
                    break
            time.sleep(0.05)
        with self._lock:
            return dict(self._sums.get(str(query.id), Counter(rows=0, late=0)))
