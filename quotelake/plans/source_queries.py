"""Decoding, normalising, topics and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.plans.catalog import AS_OF, query
from quotelake.plans.signal_queries import scored_news
from quotelake.session import scratch_path
from quotelake.sources import adapters as A
from quotelake.sources import decode as D
from quotelake.sources import payloads as PL
from quotelake.sources import tables as TB
from quotelake.streaming import sinks as K

_SECOND = "date_trunc('second', timestamp)"


def _epoch(ts="timestamp"):
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def stock_messages(spark, d):
    """Ticks as JSON text, with the price quoted."""
    t = A.ticks(spark, d)
    return t.select("id", F.to_json(F.struct(
        "symbol", F.col("price").cast("string").alias("price"), "volume", _epoch().alias("timestamp"), "source",
        F.when(F.col("symbol") == "view", F.lit(1.25)).alias("change_percent"))).alias("value"))


@query("parse_stock_json", f"""
SELECT id, symbol, CAST(price AS DOUBLE) AS price, volume, {_SECOND} AS timestamp, CAST(NULL AS DOUBLE) AS change,
       CASE WHEN symbol = 'view' THEN 1.25::DOUBLE END AS change_percent, source FROM ticks""", ["ticks"])
def _(spark, d):
    return D.parse_stock_json(stock_messages(spark, d), keep=["id"])


def messy_stock_messages(spark, d):
    """Signups are cut off, errors quote their time, purchases lack a source."""
    t, s = A.ticks(spark, d), F.col("symbol")
    seconds = _epoch()
    common = ["symbol", F.col("price").cast("string").alias("price"), F.col("volume").cast("string").alias("volume")]
    good = F.to_json(F.struct(*common, seconds.alias("timestamp"), "source", F.lit("28.5").alias("pe_ratio")))
    return t.select("id", F.when(s == "signup", F.regexp_replace(good, "}$", ""))
                    .when(s == "error", F.to_json(F.struct(
                        *common, seconds.cast("string").alias("timestamp"), "source", F.lit(2.75e12).alias("market_cap"))))
                    .when(s == "purchase", F.to_json(F.struct(*common, seconds.alias("timestamp"))))
                    .otherwise(good).alias("value"))


_INGEST = f"TIMESTAMP '{AS_OF}'"


def _lenient(spark, d):
    return D.parse_stock_json_lenient(
        messy_stock_messages(spark, d), F.lit(AS_OF).cast("timestamp_ntz"), keep=["id"])


@query("parse_stock_json_lenient", f"""
SELECT id, symbol, CAST(price AS DOUBLE) AS price, volume,
       CASE WHEN symbol = 'error' THEN {_INGEST} ELSE {_SECOND} END AS timestamp,
       CAST(NULL AS DOUBLE) AS change, CAST(NULL AS DOUBLE) AS change_percent,
       CASE WHEN symbol = 'error' THEN 2750000000000::DOUBLE END AS market_cap,
       CASE WHEN symbol <> 'error' THEN 28.5::DOUBLE END AS pe_ratio, source
FROM ticks WHERE symbol NOT IN ('signup', 'purchase')""", ["ticks"])
def _(spark, d):
    return D.quarantine(_lenient(spark, d))[0]


@query("quarantine", """
SELECT CASE symbol WHEN 'signup' THEN 'symbol is missing' ELSE 'source is missing' END AS decode_error,
       count(*) AS messages FROM ticks WHERE symbol IN ('signup', 'purchase') GROUP BY 1""", ["ticks"])
def _(spark, d):
    return D.quarantine(_lenient(spark, d))[1].groupBy("decode_error").agg(F.count("raw_value").alias("messages"))


@query("parse_news_json", """
SELECT id, title, content, url, timestamp, source,
       CASE WHEN category = 'fr' THEN 0.5::DOUBLE END AS sentiment_score,
       array_to_string(CASE WHEN len(symbols) > 0 THEN symbols END, ',') AS symbols, category FROM counted""", ["counted"])
def _(spark, d):
    n = scored_news(spark, d)
    raw = n.select("id", F.to_json(F.struct(
        "title", "content", "url", _epoch().alias("timestamp"), "source", "category",
        F.when(F.col("category") == "fr", F.lit(0.5)).alias("sentiment_score"),
        F.when(F.size("symbols") > 0, F.col("symbols")).alias("symbols"))).alias("value"))
    return D.parse_news_json(raw, keep=["id"])


@query("parse_economic_json", """
SELECT id, indicator, CAST(value AS DOUBLE) AS value, timestamp, 'US' AS country, 'orders' AS source,
       CAST(NULL AS VARCHAR) AS unit, 'daily' AS period FROM observations""", ["observations"])
def _(spark, d):
    o = A.observations(spark, d)
    raw = o.select("id", F.to_json(F.struct(
        "indicator", F.col("value").cast("double").alias("value"), _epoch().alias("timestamp"),
        F.lit("US").alias("country"), F.lit("orders").alias("source"), F.lit("daily").alias("period"))).alias("message"))
    return D.parse_economic_json(raw, value="message", keep=["id"])


@query("normalize_quote", f"""
SELECT symbol, CAST(price AS DOUBLE) AS price, volume, {_INGEST} AS timestamp,
       CASE WHEN symbol = 'view' THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS change, 1.24::DOUBLE AS change_percent,
       'alpha_vantage' AS source
FROM ticks WHERE symbol <> 'error'""", ["ticks"])
def _(spark, d):
    s = F.col("symbol")
    quote = F.create_map(
        F.lit("05. price"), F.col("price").cast("string"), F.lit("06. volume"),
        F.col("volume").cast("double").cast("string"), F.lit("10. change percent"), F.lit("1.24%"))
    full = F.map_concat(quote, F.create_map(F.lit("09. change"), F.lit("1.5")))
    body = F.when(s == "error", F.lit("{}")).otherwise(F.to_json(F.when(s == "view", quote).otherwise(full)))
    landed = A.ticks(spark, d).select(
        "symbol", F.concat(F.lit('{"Global Quote": '), body, F.lit("}")).alias("payload"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("fetched_at"))
    return PL.normalize_quote(landed)


@query("normalize_articles", """
SELECT title, content, url, date_trunc('second', timestamp) AS timestamp,
       CASE WHEN category = 'de' THEN 'unknown' ELSE source END AS source, CAST(NULL AS DOUBLE) AS sentiment_score,
       '' AS symbols, 'general' AS category
FROM news WHERE category <> 'fr' AND content <> ''""", ["news"])
def _(spark, d):
    n, lang = A.news(spark, d), F.col("category")
    article = F.struct(
        F.when(lang != "fr", F.col("title")).alias("title"), "content", "url",
        F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.struct(F.when(lang != "de", F.col("source")).alias("name")).alias("source"))
    return PL.normalize_articles(n.select(F.to_json(F.struct(F.array(article).alias("articles"))).alias("payload")))


@query("normalize_observations", """
SELECT CAST(id AS VARCHAR) AS indicator, CAST(value AS DOUBLE) AS value, CAST(timestamp AS TIMESTAMP) AS timestamp,
       'US' AS country, 'fred' AS source, CASE WHEN indicator = '5-LOW' THEN 'Unknown' ELSE indicator END AS unit,
       'monthly' AS period
FROM observations WHERE indicator <> '2-HIGH'""", ["observations"])
def _(spark, d):
    o, kind = A.observations(spark, d), F.col("indicator")

    def obs(day, value):
        return F.struct(F.date_format(day, "yyyy-MM-dd").alias("date"), value.alias("value"))

    newest = F.when(kind == "2-HIGH", F.lit(".")).otherwise(F.col("value").cast("double").cast("string"))
    older = obs(F.col("timestamp") - F.expr("INTERVAL 40 DAYS"), F.lit("1.0"))
    payload = F.struct(
        F.when(kind != "5-LOW", kind).alias("units"), F.array(older, obs(F.col("timestamp"), newest)).alias("observations"))
    return PL.normalize_observations(
        o.select(F.col("id").cast("string").alias("indicator"), F.to_json(payload).alias("payload")))


@query("read_table", """
SELECT id, symbol, CAST(price AS DOUBLE) AS price, volume, timestamp FROM ticks
WHERE timestamp BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-28 18:00:00'""", ["ticks"])
def _(spark, d):
    root = scratch_path(spark, "tables")
    TB.write_table(A.ticks(spark, d), root, "stock_data", files_per_day=2)
    out = TB.read_table(spark, root, "stock_data", "2024-01-03 06:00:00", "2024-01-28 18:00:00")
    return out.select("id", "symbol", "price", "volume", "timestamp")


# Topics

@query("topic_messages", """
SELECT 'stock-alerts' AS topic, symbol, id AS event_id, volume FROM ticks""", ["ticks"])
def _(spark, d):
    m = K.topic_messages(A.ticks(spark, d).withColumnRenamed("id", "event_id"), "stock-alerts")
    v = F.col("value")
    return m.select("topic", F.get_json_object(v, "$.symbol").alias("symbol"),
                    F.get_json_object(v, "$.eventId").cast("bigint").alias("event_id"),
                    F.get_json_object(v, "$.volume").cast("bigint").alias("volume"))


@query("publish_keyed", """
SELECT key, topic, count(*) AS messages FROM (
  SELECT symbol AS key, 'stock-data' AS topic FROM ticks
  UNION ALL SELECT indicator, 'economic-data' FROM observations
  UNION ALL SELECT 'news_data_1706659200', 'news-data' FROM news)
GROUP BY ALL""", ["ticks", "observations", "news"])
def _(spark, d):
    out = K.keyed_messages(A.ticks(spark, d), "stock_data", "stock-data", AS_OF)
    out = out.unionByName(K.keyed_messages(A.observations(spark, d), "economic_data", "economic-data", AS_OF))
    out = out.unionByName(K.keyed_messages(A.news(spark, d), "news_data", "news-data", AS_OF))
    return out.groupBy("key", "topic").agg(F.count("value").alias("messages"))


@query("fan_out_topics", """
SELECT topic, id FROM (
  SELECT '/topic/stocks/' || symbol AS topic, id FROM ticks UNION ALL SELECT '/topic/stocks', id FROM ticks
  UNION ALL SELECT '/topic/news', id FROM news UNION ALL SELECT '/topic/economic', id FROM observations)
""", ["ticks", "news", "observations"])
def _(spark, d):
    out = K.fan_out_topics(A.ticks(spark, d)).unionByName(K.fan_out_topics(A.news(spark, d), "news")).unionByName(
        K.fan_out_topics(A.observations(spark, d), "economic"))
    return out.select("topic", F.get_json_object("value", "$.id").cast("bigint").alias("id"))


# Stored results

def hourly(spark, d):
    """Rows that repeat (symbol, hour), as an upsert meets them."""
    t = A.ticks(spark, d).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    t = t.withColumns({"change_percent": F.col("price").cast("double"), "arrival": F.col("id")})
    return K.processed_rows(t)


_UPSERT_SQL = """
WITH rows AS (SELECT *, CASE WHEN price < 50 THEN 0 ELSE 1 END AS gen, date_trunc('hour', timestamp) AS hour FROM ticks)
SELECT symbol, CAST(arg_max(price, (gen, id)) AS DOUBLE) AS price, arg_max(volume, (gen, id)) AS volume,
       hour AS timestamp, CAST(arg_min(price, (gen, id)) AS DOUBLE) AS change_percent,
       CAST(arg_min(price, (gen, id)) AS DOUBLE) AS avg_price_5min, 'events' AS source
FROM rows GROUP BY symbol, hour"""


@query("upsert_processed", _UPSERT_SQL, ["ticks"])
def _(spark, d):
    root, rows = scratch_path(spark, "processed"), hourly(spark, d)
    K.upsert_batch(rows.where("price < 50"), 0, root)
    for _ in range(2):  # the second time is a replay
        K.upsert_batch(rows.where("price >= 50"), 1, root)
    return K.read_processed(spark, root)


@query("compact_processed_in_place", _UPSERT_SQL, ["ticks"])
def _(spark, d):
    """As `upsert_processed`, folded together between the batches; a replay of the first one has no effect."""
    root, rows = scratch_path(spark, "compacted"), hourly(spark, d)
    K.upsert_batch(rows.where("price < 50"), 0, root)
    K.compact_in_place(spark, root)
    K.upsert_batch(rows.where("price >= 50"), 0, root)
    K.upsert_batch(rows.where("price >= 50"), 1, root)
    K.compact_in_place(spark, root)
    return K.read_processed(spark, root)


@query("merge_processed", """
WITH rows AS (SELECT *, CASE WHEN price < 50 THEN 0 ELSE 1 END AS gen, date_trunc('hour', timestamp) AS hour FROM ticks)
SELECT symbol, CAST(arg_max(price, (gen, id)) AS DOUBLE) AS price, arg_max(volume, (gen, id)) AS volume,
       hour AS timestamp, CAST(arg_min(price, (gen, id)) AS DOUBLE) AS change_percent,
       CAST(arg_min(price, (gen, id)) AS DOUBLE) AS avg_price_5min, 'events' AS source
FROM rows GROUP BY symbol, hour""", ["ticks"])
def _(spark, d):
    rows = hourly(spark, d)
    none = rows.where("false")
    return K.merge_processed(K.merge_processed(none, rows.where("price < 50")), rows.where("price >= 50"))


@query("merge_touch", f"""
SELECT u.id, CASE WHEN n > 0 THEN 'INACTIVE' ELSE status END AS status,
       CASE WHEN n > 0 THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
FROM users u LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o
  ON o.o_custkey = u.id""", ["users"])
def _(spark, d):
    o = A.table(spark, d, "orders").where("o_orderstatus = 'P'")
    updates = o.select(F.col("o_custkey").alias("id"), F.lit("INACTIVE").alias("status")).distinct()
    return K.merge_touch(A.users(spark, d), updates, ["id"], AS_OF).select("id", "status", "updated_at")


@query("retain_since", """
SELECT id, symbol, CAST(price AS DOUBLE) AS price, volume, timestamp, source FROM ticks
WHERE timestamp >= TIMESTAMP '2024-01-10 12:00:00'""", ["ticks"])
def _(spark, d):
    return K.retain_since(A.ticks(spark, d), "2024-01-10 12:00:00")


@query("expired_count", """
SELECT count(*) AS deleted FROM notifications WHERE created_at < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY
""", ["notifications"])
def _(spark, d):
    return K.expired_count(A.notifications(spark, d), "2001-07-02 00:00:00", "created_at")


@query("points_by_source", """
SELECT 'stock' AS data_type, source, count(*) AS points FROM ticks GROUP BY source
UNION ALL SELECT 'news', source, count(*) FROM news GROUP BY source""", ["ticks", "news"])
def _(spark, d):
    return K.points_by_source(A.ticks(spark, d), "stock").unionByName(K.points_by_source(A.news(spark, d), "news"))


@query("messages_by_status", """
SELECT 'stock-data' AS topic, CASE WHEN symbol IN ('signup', 'purchase') THEN 'error' ELSE 'success' END AS status,
       count(*) AS messages FROM ticks GROUP BY 2""", ["ticks"])
def _(spark, d):
    return K.messages_by_status(_lenient(spark, d), "stock-data")


@query("append_derived", """
SELECT news_id, symbol FROM (SELECT id AS news_id, unnest(symbols) AS symbol FROM counted)""", ["counted"])
def _(spark, d):
    root = scratch_path(spark, "derived")
    n = scored_news(spark, d)
    K.append_derived(spark, root, news=n)
    return spark.read.schema("news_id BIGINT, symbol STRING").parquet(f"{root}/news_symbols")
