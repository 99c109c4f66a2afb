"""Pairwise sentiment on a stream: r = (r + s) / 2 over the articles of a symbol and window, in time order.

State is one running value per (symbol, window) and the articles the watermark has not passed yet. Whenever it
passes some, they are folded in, all at once; when it passes the window, the value leaves and the state is dropped.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The processor travels to the workers as code, so that they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUT = "symbol STRING, window_start TIMESTAMP, window_end TIMESTAMP, avg_sentiment DOUBLE, articles BIGINT"
_WAITING = "timestamp TIMESTAMP, id BIGINT, score DOUBLE"


def fold(value: float | None, scores: np.ndarray) -> float | None:
    """The running value after some more scores. The first score of all counts as it is."""
    if not len(scores):
        return value
    if value is None:
        value, scores = float(scores[0]), scores[1:]
    return float(value * 0.5 ** len(scores) + (scores * 0.5 ** np.arange(len(scores), 0, -1)).sum())


def _just_after(time):
    return int(pd.Timestamp(time).timestamp() * 1000) + 1


def _rows(pdf):
    return list(zip([t.to_pydatetime() for t in pdf["timestamp"]], pdf["id"].tolist(), pdf["score"].tolist()))


class PairwiseFold(StatefulProcessor):
    def init(self, handle):
        self.handle = handle
        self.running = handle.getValueState("running", "value DOUBLE, articles BIGINT")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            self.waiting.appendList(_rows(pdf))
            earliest = pdf["timestamp"].min()
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        symbol, start, end = key[0], pd.Timestamp(key[1]), pd.Timestamp(key[2])
        held = pd.DataFrame(list(self.waiting.get()), columns=["timestamp", "id", "score"]).sort_values(["timestamp", "id"])
        passed = (held["timestamp"] < watermark).to_numpy(bool)
        value, articles = self.running.get() if self.running.exists() else (None, 0)
        value = fold(value, held["score"].to_numpy(float)[passed])
        articles += int(passed.sum())
        held = held[~passed]
        self.waiting.clear()
        if end <= watermark:  # nothing of the window can follow
            self.running.clear()
            yield pd.DataFrame([(symbol, start, end, value, articles)],
                               columns=["symbol", "window_start", "window_end", "avg_sentiment", "articles"])
            return
        if len(held):
            self.waiting.put(_rows(held))
        self.running.update((value, articles))
        # the timer that has expired is gone
        self.handle.registerTimer(_just_after(held["timestamp"].min() if len(held) else end))

    def _wake(self, time):
        """One timer, when the watermark passes the earliest article that waits, or the window."""
        at, pending = _just_after(time), list(self.handle.listTimers())
        if not pending or at < min(pending):
            for t in pending:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self):
        pass


def pairwise_sentiment_stream(news: DataFrame, width="1 hour") -> DataFrame:
    """`window_sentiment(mode="pairwise")` for a watermarked stream with a whole-number ``id`` that orders equal times.

    Articles without symbols or score don't count; a symbol named twice by an article counts twice, as in a batch. A window
    leaves when the watermark has passed it. Needs the state store of `build_session`.
    """
    scored = news.where((F.size("symbols") > 0) & F.col("sentiment_score").isNotNull()).select(
        F.explode("symbols").alias("symbol"), F.window("timestamp", width).alias("w"), "timestamp",
        F.col("id").cast("bigint").alias("id"), F.col("sentiment_score").cast("double").alias("score"))
    keyed = scored.select("symbol", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "timestamp", "id", "score")
    folded = keyed.groupBy("symbol", "window_start", "window_end").transformWithStateInPandas(
        statefulProcessor=PairwiseFold(), outputStructType=_OUT, outputMode="append", timeMode="eventTime")
    return folded.select("window_start", "window_end", "symbol", "avg_sentiment", "articles")
