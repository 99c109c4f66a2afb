"""The two stream jobs: several outputs from one decoded stream, one streaming
query per output, each with its own checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.functions import lexicons as lex
from quotelake.operators import notifications as N
from quotelake.operators import signals as G
from quotelake.operators import windows as W
from quotelake.operators.alerts import route_alerts, route_news_alerts
from quotelake.sources import decode as D
from quotelake.sources import topics as TP
from quotelake.streaming import sinks as K
from quotelake.streaming.lateness import NEWS_LATENESS, STOCK_LATENESS, with_bounded_lateness
from quotelake.streaming.pattern_state import breaking_news_stream
from quotelake.streaming.sentiment_fold import pairwise_sentiment_stream

TRIGGER = {"processingTime": "60 seconds"}


def _files(df, checkpoint, name, path, trigger):
    return (
        df.writeStream.queryName(name).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**trigger)
        .format("parquet").start(f"{path}/{name}")
    )


def _topic(df, topic, checkpoint, name, out, servers, trigger):
    folder = None if servers else f"{out}/{name}"
    return K.write_topic(K.topic_messages(df, topic), f"{checkpoint}/{name}", name, servers, folder, trigger)


def decoded_stream(messages: DataFrame, decoder, strict=True) -> DataFrame:
    decoded = decoder(messages, keep=[c for c in ("arrival",) if c in messages.columns])
    return D.strict(decoded) if strict else D.quarantine(decoded)[0]


def with_arrival(ticks: DataFrame) -> DataFrame:
    """Order rows that share a time: by the broker's offset, or by a hash of
    their content where there is none. Both are the same again on a replay."""
    order = F.col("arrival") if "arrival" in ticks.columns else F.xxhash64(*ticks.columns)
    return ticks.withColumn("id", order)


def stock_alert_stream(ticks: DataFrame, width="1 hour") -> DataFrame:
    """Price and volume alerts of a watermarked stream, in one query."""
    return G.all_stock_alerts(G.price_change_alerts(ticks), W.volume_anomalies(ticks, width))


def user_alert_stream(ticks: DataFrame, user_alerts: DataFrame, users: DataFrame, kinds) -> DataFrame:
    """Users' own thresholds, tested on every tick and not only on those that raise another alert."""
    events = ticks.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return route_alerts(events, user_alerts.where(F.col("alert_type").isin(list(kinds))), users)


def start_stock_job(messages: DataFrame, out: str, checkpoint: str, servers=None, strict=True, trigger=None,
                    user_alerts: DataFrame = None, users: DataFrame = None, time="record", enrich=False):
    """Averages, processed ticks and alerts from a stream of quote messages.

    Returns the running queries. ``out`` takes the tables, and the topics too
    if no servers are given. With ``user_alerts`` and ``users`` the price and volume
    alerts of users go to topics of their own. ``time`` is that of `with_bounded_lateness`. Ticks are stored at once; with
    ``enrich`` their window columns follow when the watermark has passed their hour.
    """
    trigger = trigger or TRIGGER
    ticks = with_bounded_lateness(with_arrival(decoded_stream(messages, D.decode_stock, strict)), STOCK_LATENESS, time)
    arrived = ticks.withColumn("arrival", F.col("id"))

    def stored(rows, name):
        rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
        return K.upsert_processed(rows, f"{out}/stock_data_processed", f"{checkpoint}/{name}", trigger=trigger)

    own = [] if user_alerts is None else [
        _topic(user_alert_stream(ticks, user_alerts, users, kinds), topic, checkpoint, name, out, servers, trigger)
        for name, topic, kinds in (("price_alerts", TP.PRICE_ALERTS, ["PRICE_ABOVE", "PRICE_BELOW"]),
                                   ("volume_alerts", TP.VOLUME_ALERTS, ["VOLUME_SPIKE"]))]
    return own + [
        _files(W.window_price_stats(ticks), checkpoint, "price_averages", out, trigger),
        stored(K.processed_rows(arrived), "stock_data_processed"),
        *([stored(K.window_rows(W.enriched_stream(arrived)), "stock_data_windows")] if enrich else []),
        _topic(stock_alert_stream(ticks), TP.STOCK_ALERTS, checkpoint, "stock_alerts", out, servers, trigger),
    ]


def stock_notifications(stock_alerts: DataFrame, user_alerts: DataFrame, users: DataFrame) -> DataFrame:
    """Notification rows for the users whose alerts a stock alert meets, with what the alert itself says."""
    events = stock_alerts.select(
        F.xxhash64(*stock_alerts.columns).alias("id"), "symbol", F.col("current_price").alias("price"), "volume",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("alert_type").alias("event_type"),
        "current_price", "previous_price", "change_percent")
    own = ["event_type", "current_price", "previous_price", "change_percent"]
    return N.notify_stock_alert(route_alerts(events, user_alerts, users, own))


def price_notifications(stock_alerts: DataFrame, watchlist: DataFrame, users: DataFrame) -> DataFrame:
    """Notification rows for everybody who watches a symbol whose price has moved by an alert's measure."""
    moves = stock_alerts.where(F.col("alert_type").isin("SIGNIFICANT_INCREASE", "SIGNIFICANT_DECREASE")).select(
        "symbol", F.col("previous_price").alias("old_price"), F.col("current_price").alias("new_price"), "change_percent",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))
    audience = watchlist.select("user_id", "symbol").distinct().join(
        users.select(F.col("id").alias("user_id"), "email"), "user_id")
    return N.notify_price_alert(moves.join(audience, "symbol"))


def news_notifications(news_alerts: DataFrame, watchlist: DataFrame, user_alerts: DataFrame,
                       users: DataFrame) -> DataFrame:
    """Notification rows for the users a news alert concerns, one per user and alert."""
    alerts = news_alerts.withColumns({
        "id": F.xxhash64("headline", "url", "timestamp"), "timestamp": F.col("timestamp").cast("timestamp_ntz")})
    return N.notify_news_alert(route_news_alerts(alerts, watchlist, user_alerts, users))


def start_notifications(alerts: DataFrame, to_rows, out: str, checkpoint: str, trigger=None):
    """Start a stream that turns each batch of alerts into notification rows.

    ``to_rows`` maps a batch to rows and may read tables afresh. A batch owns
    the folder with its stream and number, so a replay sends nothing twice, and a new checkpoint overwrites nothing.
    """
    def write(batch, n):
        run = K.query_id(batch.sparkSession, checkpoint)
        to_rows(batch).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{out}/run={run}/batch={n}")
    return (
        alerts.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or TRIGGER))
        .foreachBatch(write).start()
    )


def enriched_news(messages: DataFrame, strict=True, positive=lex.POSITIVE_WORDS, negative=lex.NEGATIVE_WORDS,
                  known=lex.KNOWN_SYMBOLS) -> DataFrame:
    news = decoded_stream(messages, D.decode_news, strict)
    news = news.withColumn("id", F.xxhash64("url", "title", "timestamp"))
    return G.extract_symbols(G.score_sentiment(news, positive, negative), known)


def start_news_job(messages: DataFrame, out: str, checkpoint: str, servers=None, strict=True, trigger=None,
                   lexicons=None, keywords=lex.MARKET_KEYWORDS, time="record"):
    """Signals, alerts, pattern alerts and pairwise window sentiment from a stream of
    article messages. Returns the running queries."""
    trigger = trigger or TRIGGER
    news = with_bounded_lateness(enriched_news(messages, strict, **(lexicons or {})), NEWS_LATENESS, time)
    sentiment = W.sentiment_lines(pairwise_sentiment_stream(news))
    return [
        _topic(G.trading_signals(news), TP.SIGNALS, checkpoint, "trading_signals", out, servers, trigger),
        _topic(G.all_news_alerts(G.news_alerts(news, keywords), breaking_news_stream(news)), TP.NEWS_ALERTS,
               checkpoint, "news_alerts", out, servers, trigger),
        _files(sentiment, checkpoint, "sentiment_lines", out, trigger),
    ]
