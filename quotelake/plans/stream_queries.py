"""Streams over the driver's tables, run until everything present is read.

A closing record far in the future ends each stream: the watermark passes all
windows and patterns, so the results are those of the whole tables. The
record itself belongs to a symbol of its own and its window never closes.
"""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import functions as F

from quotelake.operators import signals as G
from quotelake.operators import windows as W
from quotelake.operators.alerts import route_alerts
from quotelake.plans.catalog import KEYWORDS, NEGATIVE, POSITIVE, TICKERS, query
from quotelake.plans.signal_queries import (
    NEWS_ALERT_COLUMNS, NEWS_ALERTS_SQL, PAIRWISE_SQL, PATTERN_SQL, PRICE_ALERTS_SQL, STOCK_ALERT_COLUMNS, settled, settled_sql)
from quotelake.plans.user_queries import ROUTE_ALERTS_SQL
from quotelake.session import scratch_path
from quotelake.sources import adapters as A
from quotelake.sources import decode as D
from quotelake.sources import topics as TP
from quotelake.streaming import committed as C
from quotelake.streaming import jobs as J
from quotelake.streaming import pattern_state as PS
from quotelake.streaming import sentiment_fold as SF
from quotelake.streaming import sinks as K
from quotelake.streaming.counters import StreamCounters
from quotelake.streaming.lateness import NEWS_LATENESS, with_bounded_lateness

NOW = {"availableNow": True}


def stream_of(spark, d, name):
    """A table as a stream of its files. The pattern matches the one name,
    whether the table is a folder or a single file, which streams refuse as a
    plain path."""
    schema = A.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


END = "2100-01-01 00:00:00"


def closing(spark, schema, name, **values):
    """A stream of the one record that closes another; columns not given are null."""
    path = scratch_path(spark, f"closing-{name}")
    row = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*row).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def tick_stream(spark, d):
    events = stream_of(spark, d, "events")
    end = closing(spark, events.schema, "events", event_id=-1, event_type="end", ts=END)
    return with_bounded_lateness(A.ticks_of(events.unionByName(end), F.col("event_type")))


def run_to_files(spark, df, name, root=None):
    """Run a stream into Parquet files of the shared folder; read them back."""
    root = root or scratch_path(spark, name)
    q = (
        df.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**NOW).start(f"{root}/out"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@query("stream_window_price_stats", """
SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start,
       time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE AS window_end, symbol,
       ((2 * CAST(sum(price) * 10000 AS HUGEINT) + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS avg_price,
       CAST(max(price) - min(price) AS DOUBLE) AS price_range, count(*) AS tick_count
FROM ticks GROUP BY 1, 2, 3""", ["ticks"])
def _(spark, d):
    return run_to_files(spark, W.window_price_stats(tick_stream(spark, d)), "price-stats")


@query("stream_ohlc_interval", """
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start,
       time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS window_end, symbol,
       CAST(arg_min(price, (timestamp, id)) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high,
       CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (timestamp, id)) AS DOUBLE) AS close,
       CAST(sum(volume) AS BIGINT) AS volume
FROM ticks GROUP BY 1, 2, 3""", ["ticks"])
def _(spark, d):
    return run_to_files(spark, W.ohlc_interval(tick_stream(spark, d), "1h"), "ohlc")


# Change and percentage come with the message here, as the feed gives them.
_FED = """fed AS (SELECT *, CAST(price / 4 AS DECIMAL(19,4)) AS change,
                         CAST(price AS DOUBLE) - 50 AS change_percent FROM ticks)"""
_FED_PRICE = PRICE_ALERTS_SQL.replace("FROM quoted", "FROM fed")


def fed_ticks(ticks):
    return ticks.withColumns({
        "change": F.round(F.col("price") / 4, 4).cast("decimal(19,4)"),
        "change_percent": F.col("price").cast("double") - 50})


@query("stream_stock_alerts", f"""
WITH {_FED}, {_FED_PRICE}, win AS (
  SELECT symbol, time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS window_end,
         arg_max(struct_pack(price := price, change_percent := change_percent, volume := volume,
                             timestamp := timestamp), (timestamp, -id)) AS n,
         sum(volume) AS total, count(*) AS ticks
  FROM fed GROUP BY 1, 2)
SELECT {STOCK_ALERT_COLUMNS} FROM price_alerts
UNION ALL
SELECT symbol, 'HIGH_VOLUME', CAST(n.price AS DOUBLE), CAST(n.price AS DOUBLE), n.change_percent, n.volume, n.timestamp
FROM win WHERE ticks > 1 AND n.volume > (total // ticks) * 3""", ["ticks"])
def _(spark, d):
    alerts = J.stock_alert_stream(fed_ticks(tick_stream(spark, d)))
    return run_to_files(spark, alerts, "stock-alerts")


def news_stream(spark, d, close=False):
    """Documents published as messages of the news topic, read back as a stream. The closing article is a significant
    one about a symbol of its own, which no pattern follows."""
    root = scratch_path(spark, "topics")
    n = A.news(spark, d)
    if close:
        n = n.unionByName(spark.range(1).select(*[F.lit({
            "title": "end", "content": "que", "url": "end", "timestamp": END, "source": "end", "category": "end"}.get(
                f.name)).cast(f.dataType).alias(f.name) for f in n.schema]))
    messages = n.select(F.to_json(F.struct(
        "title", "content", "url", F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("timestamp"),
        "source", "category")).alias("value"), F.lit(TP.NEWS).alias("topic"))
    K.publish(messages, folder=root)
    lines = TP.read_topic(spark, TP.NEWS, folder=root)
    news = J.enriched_news(lines, positive=POSITIVE, negative=NEGATIVE, known=TICKERS)
    return with_bounded_lateness(news, NEWS_LATENESS)


@query("stream_window_sentiment_mean", f"""
WITH exploded AS (
  SELECT unnest(symbols) AS symbol, sentiment_score AS score, time_bucket(INTERVAL 1 HOUR, timestamp) AS w FROM scored)
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, symbol, {settled_sql("avg(score)")} AS avg_sentiment,
       count(*) AS articles FROM exploded GROUP BY w, symbol""", ["scored"])
def _(spark, d):
    means = W.window_sentiment(news_stream(spark, d, close=True))
    return run_to_files(spark, means, "sentiment").withColumn("avg_sentiment", settled("avg_sentiment"))


@query("stream_trading_signals", """
SELECT symbols[1] AS symbol, CASE WHEN sentiment_score > 0.3 THEN 'BUY' ELSE 'SELL' END AS signal_type,
       abs(sentiment_score) AS confidence,
       'News sentiment: ' || CAST(sentiment_score AS VARCHAR) || ' - ' || title AS reason,
       'news-analysis' AS source, timestamp
FROM scored WHERE len(symbols) > 0 AND abs(sentiment_score) > 0.3""", ["scored"])
def _(spark, d):
    return run_to_files(spark, G.trading_signals(news_stream(spark, d)), "signals")


@query("stream_news_alerts", f"WITH {NEWS_ALERTS_SQL} SELECT {NEWS_ALERT_COLUMNS} FROM news_alerts", ["scored"])
def _(spark, d):
    return run_to_files(spark, G.news_alerts(news_stream(spark, d), KEYWORDS).drop("id"), "news-alerts")


@contextmanager
def keyed_state(spark):
    """The state store that keyed processors need, whatever the session has."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PS.STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("stream_breaking_news", f"""
WITH {PATTERN_SQL}
SELECT {NEWS_ALERT_COLUMNS} FROM pattern_alerts""", ["scored"])
def _(spark, d):
    with keyed_state(spark):
        return run_to_files(spark, PS.breaking_news_stream(news_stream(spark, d, close=True)), "pattern")


@query("stream_window_sentiment_pairwise", f"""
WITH {PAIRWISE_SQL}
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, symbol, {settled_sql("r")} AS avg_sentiment, n AS articles
FROM pairwise""", ["scored"])
def _(spark, d):
    with keyed_state(spark):
        folded = SF.pairwise_sentiment_stream(news_stream(spark, d, close=True))
        return run_to_files(spark, folded, "pairwise").withColumn("avg_sentiment", settled("avg_sentiment"))


@query("stream_route_alerts", ROUTE_ALERTS_SQL, ["user_ticks", "user_alerts", "users"])
def _(spark, d):
    symbol = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    ticks = A.ticks_of(stream_of(spark, d, "events"), symbol)
    routed = route_alerts(ticks, A.user_alerts(spark, d), A.users(spark, d))
    return run_to_files(spark, routed, "routed")


@query("stream_upsert_processed", """
SELECT symbol, CAST(arg_max(price, h) AS DOUBLE) AS price, arg_max(volume, h) AS volume, timestamp, source
FROM (SELECT *, id AS h FROM ticks) GROUP BY symbol, timestamp, source""", ["ticks"])
def _(spark, d):
    root = scratch_path(spark, "upsert")
    ticks = A.ticks_of(stream_of(spark, d, "events"), F.col("event_type")).withColumns({
        "change_percent": F.lit(None).cast("double"), "arrival": F.col("id")})
    K.upsert_processed(K.processed_rows(ticks), f"{root}/out", f"{root}/checkpoint", trigger=NOW).awaitTermination()
    return K.read_processed(spark, f"{root}/out").select("symbol", "price", "volume", "timestamp", "source")


@query("stream_enrich_processed", """
WITH e AS (
  SELECT symbol, price, volume, timestamp, source, id,
         ((2 * CAST(sum(price) OVER five * 10000 AS HUGEINT) + count(*) OVER five) // (2 * count(*) OVER five))
             / 10000.0::DOUBLE AS avg_price_5min,
         ((2 * CAST(sum(price) OVER hour * 10000 AS HUGEINT) + count(*) OVER hour) // (2 * count(*) OVER hour))
             / 10000.0::DOUBLE AS avg_price_1h,
         CAST(volume AS DOUBLE) * count(*) OVER hour / CAST(sum(volume) OVER hour AS DOUBLE) AS volume_ratio
  FROM ticks
  WINDOW five AS (PARTITION BY symbol, time_bucket(INTERVAL 5 MINUTE, timestamp)),
         hour AS (PARTITION BY symbol, time_bucket(INTERVAL 1 HOUR, timestamp)))
SELECT symbol, CAST(arg_max(price, id) AS DOUBLE) AS price, arg_max(volume, id) AS volume, timestamp,
       arg_min(avg_price_5min, id) AS avg_price_5min, arg_min(avg_price_1h, id) AS avg_price_1h,
       arg_min(volume_ratio, id) AS volume_ratio, arg_min(source, id) AS source
FROM e GROUP BY symbol, timestamp""", ["ticks"])
def _(spark, d):
    """Ticks, joined with the aggregates of their windows while they stream, in the stored table."""
    root = scratch_path(spark, "enriched")
    ticks = tick_stream(spark, d).withColumns({"change_percent": F.lit(None).cast("double"), "arrival": F.col("id")})
    rows = K.processed_rows(W.enriched_stream(ticks)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    K.upsert_processed(rows, f"{root}/out", f"{root}/checkpoint", trigger=NOW).awaitTermination()
    return K.read_processed(spark, f"{root}/out", windows=True).select(
        "symbol", "price", "volume", "timestamp", "avg_price_5min", "avg_price_1h", "volume_ratio", "source")


CUTOFF = datetime(2024, 1, 15, 12)


@query("shared_day_table", f"""
SELECT id, symbol, CAST(price AS DOUBLE) AS price, volume, timestamp FROM ticks WHERE timestamp >= '{CUTOFF}'""", ["ticks"])
def _(spark, d):
    """One table filled by a stream and a batch, cut by retention, compacted, and filled by the stream's replay."""
    root, all_ticks = scratch_path(spark, "shared"), A.ticks(spark, d).select("id", "symbol", "price", "volume", "timestamp")
    streamed = A.ticks_of(stream_of(spark, d, "events"), F.col("event_type")).select(*all_ticks.columns)
    C.append_stream(streamed.where("id % 3 > 0"), f"{root}/out", f"{root}/checkpoint", trigger=NOW).awaitTermination()
    C.append(f"{root}/out", {"stock_data": all_ticks.where("id % 3 = 0")})
    C.delete_before(spark, f"{root}/out", "stock_data", all_ticks.schema, CUTOFF)
    C.compact(spark, f"{root}/out", "stock_data", all_ticks.schema)
    return C.read(spark, f"{root}/out", "stock_data", all_ticks.schema)


@query("stream_derived_tables", f"""
WITH signals AS (
  SELECT symbols[1] AS symbol, abs(sentiment_score) AS confidence FROM scored
  WHERE len(symbols) > 0 AND abs(sentiment_score) > 0.3)
SELECT 'news_data' AS name, count(*) AS records, {settled_sql("sum(sentiment_score)")} AS total FROM scored
UNION ALL SELECT 'news_symbols', count(*), 0 FROM (SELECT DISTINCT id, unnest(symbols) FROM scored)
UNION ALL SELECT 'trading_signals', count(*), {settled_sql("sum(confidence)")} FROM signals""", ["scored"])
def _(spark, d):
    """Articles, their symbols and signals from one stream, each batch one change; the first batch comes twice."""
    root, schemas = scratch_path(spark, "derived"), {}

    def tables(batch):
        out = {"news_data": batch.select("id", "title", "url", "timestamp", "sentiment_score"),
               "news_symbols": K.news_symbol_rows(batch), "trading_signals": G.trading_signals(batch)}
        schemas.update({name: df.schema for name, df in out.items()})
        return out

    news = news_stream(spark, d)
    C.append_stream(news, f"{root}/out", f"{root}/checkpoint", tables, NOW, days=("news_data",)).awaitTermination()
    owner = f"{K.query_id(spark, f'{root}/checkpoint')}-0"
    C.append(f"{root}/out", {n: spark.createDataFrame([], s) for n, s in schemas.items()}, owner)  # the replay
    parts = []
    for name, value in (("news_data", "sentiment_score"), ("news_symbols", None), ("trading_signals", "confidence")):
        rows = C.read(spark, f"{root}/out", name, schemas[name])
        total = F.sum(F.col(value).cast("double")) if value else F.lit(0.0)
        parts.append(rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("records"), total.alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("total", settled("total"))


@query("stream_counts", """
SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE id % 5 > 0) AS BIGINT) AS good,
       CAST(count(*) FILTER (WHERE id % 5 = 0) AS BIGINT) AS failed FROM ticks""", ["ticks"])
def _(spark, d):
    """Read, decoded and failed messages of a stream over all its batches; every fifth one cannot be decoded."""
    counters = StreamCounters.watch(spark)
    try:
        ticks = A.ticks_of(stream_of(spark, d, "events"), F.col("event_type"))
        value = F.to_json(F.struct("symbol", "price", "volume", F.unix_timestamp(
            F.col("timestamp").cast("timestamp")).alias("timestamp"), "source"))
        raw = ticks.select(F.when(F.col("id") % 5 == 0, F.lit("not json")).otherwise(value).alias("value"))
        decoded = D.decode_stock(raw).observe("decoding", F.count(F.lit(1)).alias("processed"),
                                              F.count_if(F.col("decode_error").isNotNull()).alias("failed"))
        root = scratch_path(spark, "counts")
        q = (D.quarantine(decoded)[0].writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
             .trigger(**NOW).start(f"{root}/out"))
        q.awaitTermination()
        seen = counters.totals(q)
    finally:
        spark.streams.removeListener(counters)
    return spark.range(1).select(F.lit(seen["rows"]).cast("bigint").alias("rows"),
                                 F.lit(seen["processed"] - seen["failed"]).cast("bigint").alias("good"),
                                 F.lit(seen["failed"]).cast("bigint").alias("failed"))


# The job's messages are one second apart, by id, so that every table of the job has one right content.
_SPACED = "spaced AS (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_seconds(id) AS timestamp) FROM ticks)"


@query("stock_job", f"""
WITH {_SPACED}, {_FED.replace("FROM ticks", "FROM spaced")}, {_FED_PRICE}, hours AS (
  SELECT symbol, time_bucket(INTERVAL 1 HOUR, timestamp) AS h, arg_max(price, id) AS price, arg_max(volume, id) AS volume,
         sum(volume) // count(*) AS mean, count(*) AS ticks
  FROM fed GROUP BY ALL)
SELECT 'price_averages' AS output, symbol, time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE AS at,
       ((2 * CAST(sum(price) * 10000 AS HUGEINT) + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS price,
       count(*) AS amount FROM fed GROUP BY ALL
UNION ALL SELECT 'stock_data_processed', symbol, timestamp, CAST(price AS DOUBLE), volume FROM fed
UNION ALL SELECT alert_type, symbol, NULL, CAST(previous_price AS DOUBLE), volume FROM price_alerts
UNION ALL SELECT 'HIGH_VOLUME', symbol, NULL, CAST(price AS DOUBLE), volume FROM hours WHERE ticks > 1 AND volume > mean * 3
""", ["ticks"])
def _(spark, d):
    """The whole stock job from its topic to its three outputs, stopped after half of the messages and started again."""
    root = scratch_path(spark, "stock-job")
    ticks = fed_ticks(A.ticks(spark, d))
    half = (ticks.agg(F.max("id")).first()[0] or 0) // 2
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    fields = ["symbol", "price", "volume", "timestamp", "change", "change_percent", "source"]
    spaced = ticks.withColumn("timestamp", start + F.col("id"))
    end = spark.range(1).select(
        F.lit("end").alias("symbol"), F.lit(1).cast("decimal(19,4)").alias("price"), F.lit(1).cast("bigint").alias("volume"),
        F.unix_timestamp(F.lit(END).cast("timestamp")).alias("timestamp"), F.lit(0).cast("decimal(19,4)").alias("change"),
        F.lit(0.0).alias("change_percent"), F.lit("end").alias("source"))
    later = spaced.where(F.col("id") > half).select(*fields).unionByName(end)
    for part in (spaced.where(F.col("id") <= half).select(*fields), later):
        K.publish(part.select(F.to_json(F.struct(*fields)).alias("value"), F.lit(TP.STOCK).alias("topic")),
                  folder=f"{root}/topics")
        lines = TP.read_topic(spark, TP.STOCK, folder=f"{root}/topics")
        for q in J.start_stock_job(lines, f"{root}/out", f"{root}/checkpoint", trigger=NOW):
            q.awaitTermination()

    def rows(df, output, at, price, amount):
        return df.select(F.expr(output).alias("output"), "symbol", F.expr(at).cast("timestamp_ntz").alias("at"),
                         F.expr(price).cast("double").alias("price"), F.expr(amount).cast("bigint").alias("amount"))

    averages = spark.read.schema(W.window_price_stats(tick_stream(spark, d)).schema).parquet(f"{root}/out/price_averages")
    alerts = spark.read.text(f"{root}/out/stock_alerts").select(F.from_json(
        "value", "symbol STRING, alertType STRING, previousPrice DOUBLE, volume BIGINT").alias("a")).select("a.*")
    return rows(averages, "'price_averages'", "window_end", "avg_price", "tick_count").unionByName(
        rows(K.read_processed(spark, f"{root}/out/stock_data_processed").where("symbol <> 'end'"), "'stock_data_processed'",
             "timestamp", "price", "volume")).unionByName(rows(alerts, "alertType", "NULL", "previousPrice", "volume"))


@query("read_topics", """
SELECT topic, count(*) AS messages FROM (
  SELECT 'stock-data' AS topic FROM ticks UNION ALL SELECT 'economic-data' FROM observations) GROUP BY topic
""", ["ticks", "observations"])
def _(spark, d):
    root = scratch_path(spark, "topics")
    out = K.topic_messages(A.ticks(spark, d), TP.STOCK).unionByName(
        K.topic_messages(A.observations(spark, d), TP.ECONOMIC)).unionByName(
        K.topic_messages(A.users(spark, d), "other"))
    K.publish(out, folder=root)
    lines = run_to_files(spark, TP.read_topics(spark, TP.DATA_TOPICS, folder=root), "lines")
    return lines.groupBy("topic").agg(F.count("value").alias("messages"))


@query("stream_decode_stock", """
SELECT symbol, CAST(price AS DOUBLE) AS price, volume, date_trunc('second', timestamp) AS timestamp, source
FROM ticks""", ["ticks"])
def _(spark, d):
    ticks = A.ticks_of(stream_of(spark, d, "events"), F.col("event_type"))
    raw = ticks.select(F.to_json(F.struct(
        "symbol", "price", "volume", F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("timestamp"),
        "source")).alias("value"))
    good = D.parse_stock_json(raw).select("symbol", "price", "volume", "timestamp", "source")
    return run_to_files(spark, good, "decoded")
