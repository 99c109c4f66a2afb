"""The breaking-news pattern on a stream.

Each significant article closes whatever was open before it, and opens the
pattern again if it is strong enough, so the newest one is all there is to
remember. Articles wait in state until the watermark has passed them, so that
they are taken in time order.

State is kept per key and bucket of the pattern's length, with a copy of the
next bucket's articles: a key that gets a large share of all news is spread
over its buckets when a backlog is read, and no state outlives two of them.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quotelake.functions import lexicons as lex
from quotelake.operators.ordered import with_halo
from quotelake.operators.pattern import pattern_alert, pattern_key
from quotelake.session import SESSION_CONF

STATE_STORE = SESSION_CONF["spark.sql.streaming.stateStore.providerClass"]

# The processor travels to the workers as code, so that they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ARTICLE = "title STRING, url STRING, symbols ARRAY<STRING>, sentiment_score DOUBLE, timestamp TIMESTAMP, id BIGINT"
_STATE = _ARTICLE + ", home BOOLEAN"
_FIELDS = ["title", "url", "symbols", "sentiment_score", "timestamp", "id"]
_COLUMNS = [*_FIELDS, "home"]


class OpenStart(StatefulProcessor):
    def __init__(self, start=lex.BREAKING_START_SCORE, within_seconds=lex.BREAKING_WITHIN_SECONDS):
        self.start = start
        self.within = pd.Timedelta(seconds=within_seconds)

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)
        self.newest = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            self.waiting.appendList(self._articles(pdf))
            earliest = pdf["timestamp"].min()
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            # one timer, at the first article waiting; later ones follow from it
            at, pending = self._just_after(first), list(self.handle.listTimers())
            if not pending or at < min(pending):
                for t in pending:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        held = pd.DataFrame(list(self.waiting.get()), columns=_COLUMNS).sort_values(["timestamp", "id"], kind="stable")
        passed = (held["timestamp"] < watermark).to_numpy(bool)
        later, line = held[~passed], held[passed]
        if self.newest.exists():  # the newest article of before stands in front of those that have passed now
            line = pd.concat([pd.DataFrame([tuple(self.newest.get())], columns=_COLUMNS), line])
        self.waiting.clear()
        if len(later):
            self.waiting.put(self._articles(later))
            self.handle.registerTimer(self._just_after(later["timestamp"].iloc[0]))
        if len(line):
            newest = line.iloc[-1:]
            forget = newest["timestamp"].iloc[0] + self.within
            if forget < watermark:
                self.newest.clear()
            else:
                self.newest.update(self._articles(newest)[0])
                if not len(later):  # come back to forget it
                    self.handle.registerTimer(self._just_after(forget))
        # every article but the last is followed by the one behind it
        starts = line.iloc[:-1]
        gap = line["timestamp"].iloc[1:].reset_index(drop=True) - starts["timestamp"].reset_index(drop=True)
        hit = starts["home"].to_numpy(bool) & (starts["sentiment_score"].abs() > self.start).to_numpy(bool) & (
            gap < self.within).to_numpy(bool)
        if hit.any():
            yield starts[hit][_FIELDS].reset_index(drop=True)

    def close(self):
        pass

    @staticmethod
    def _just_after(time):
        return int(pd.Timestamp(time).timestamp() * 1000) + 1

    @staticmethod
    def _articles(pdf):
        symbols = [[] if x is None else list(x) for x in pdf["symbols"]]
        return list(zip(pdf["title"].tolist(), pdf["url"].tolist(), symbols, pdf["sentiment_score"].astype(float).tolist(),
                        [t.to_pydatetime() for t in pdf["timestamp"]], pdf["id"].astype(int).tolist(),
                        pdf["home"].astype(bool).tolist()))


def breaking_news_stream(news: DataFrame, start=lex.BREAKING_START_SCORE, follow=lex.BREAKING_FOLLOW_SCORE,
                         within_seconds=lex.BREAKING_WITHIN_SECONDS) -> DataFrame:
    """`breaking_news_pattern` for a watermarked stream with an ``id``.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` set to
    `STATE_STORE`, as `build_session` does. Only significant articles reach the state.
    """
    significant = news.where(F.abs("sentiment_score") > follow).select(pattern_key().alias("_key"), *_FIELDS)
    spread = with_halo(significant, "timestamp", within_seconds).withColumnRenamed("_home", "home")
    starts = spread.groupBy("_key", "_bucket").transformWithStateInPandas(
        statefulProcessor=OpenStart(start, within_seconds), outputStructType=_ARTICLE, outputMode="append",
        timeMode="eventTime")
    return starts.select(*pattern_alert())
