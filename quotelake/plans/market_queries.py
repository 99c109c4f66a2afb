"""Market analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import market as M
from quotelake.operators.signals import trading_signals
from quotelake.plans.catalog import AS_OF, query, settled, settled_sql
from quotelake.plans.signal_queries import quoted, scored_news
from quotelake.sources import adapters as A

_LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, id DESC) AS rn FROM {q})
  WHERE rn = 1)"""
_MOVER = """id, symbol, CAST(price AS DOUBLE) AS price, volume, timestamp, source, CAST(change AS DOUBLE) AS change,
       change_percent"""


@query("trending_with_ratio", f"""
WITH day AS (
  SELECT symbol, CAST(timestamp AS DATE) AS date, sum(volume) AS v,
         sum(volume) FILTER (timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS recent
  FROM user_ticks WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND timestamp <= TIMESTAMP '{AS_OF}'
  GROUP BY ALL)
SELECT symbol, CAST(sum(recent) AS BIGINT) AS total_volume, CAST(sum(v) AS DOUBLE) / count(*) AS average_volume,
       CAST(sum(recent) AS DOUBLE) / (CAST(sum(v) AS DOUBLE) / count(*)) AS volume_ratio
FROM day GROUP BY symbol HAVING sum(recent) IS NOT NULL ORDER BY total_volume DESC, symbol LIMIT 20""", ["user_ticks"])
def _(spark, d):
    return M.trending_with_ratio(A.user_ticks(spark, d), AS_OF, 20, "7 days")


for _period, _span in [("1D", "1 DAY"), ("1W", "7 DAY"), ("1M", "1 MONTH"), ("3M", "3 MONTH"), ("1Y", "1 YEAR")]:
    @query(f"period_statistics_{_period}", f"""
    WITH r AS (
      SELECT *, CAST(price - lag(price) OVER w AS DOUBLE) / nullif(CAST(lag(price) OVER w AS DOUBLE), 0) * 100 / 100 AS ret
      FROM ticks WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {_span} AND timestamp <= TIMESTAMP '{AS_OF}'
      WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, id))
    SELECT symbol, '{_period}' AS period, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price,
           CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price,
           CAST(sum(volume) AS BIGINT) AS total_volume, CAST(sum(volume) AS DOUBLE) / count(*) AS avg_volume,
           round(stddev_samp(ret), 6) AS volatility
    FROM r GROUP BY symbol""", ["ticks"])
    def _(spark, d, _period=_period):
        stats = M.period_statistics(A.ticks(spark, d), AS_OF, _period)
        return stats.withColumn("volatility", F.round("volatility", 6))


for _kind, _sql in [
    ("gainers", "WHERE change_percent > 0 ORDER BY change_percent DESC, symbol"),
    ("losers", "WHERE change_percent < 0 ORDER BY change_percent, symbol"),
    ("most_active", "ORDER BY volume DESC, symbol"),
]:
    @query(f"market_movers_{_kind}", f"""
    WITH {_LATEST.format(q="user_quoted")} SELECT {_MOVER} FROM latest {_sql} LIMIT 20""", ["user_quoted"])
    def _(spark, d, _kind=_kind):
        return M.market_movers(A.quoted(A.user_ticks(spark, d)), _kind, 20)


_SUMMARY_COLUMNS = "symbol, CAST(price AS DOUBLE) AS price, CAST(change AS DOUBLE) AS change, change_percent, volume"


@query("market_summary", f"""
WITH {_LATEST.format(q="user_quoted")}, stocks AS (SELECT * FROM latest WHERE symbol NOT IN ('U1', 'U2'))
SELECT 'indices' AS category, {_SUMMARY_COLUMNS} FROM latest WHERE symbol IN ('U1', 'U2')
UNION ALL SELECT 'top_gainers', * FROM (SELECT {_SUMMARY_COLUMNS} FROM stocks WHERE change_percent > 0
  ORDER BY change_percent DESC, symbol LIMIT 5)
UNION ALL SELECT 'top_losers', * FROM (SELECT {_SUMMARY_COLUMNS} FROM stocks WHERE change_percent < 0
  ORDER BY change_percent, symbol LIMIT 5)
UNION ALL SELECT 'most_active', * FROM (SELECT {_SUMMARY_COLUMNS} FROM stocks ORDER BY volume DESC, symbol LIMIT 5)
""", ["user_quoted"])
def _(spark, d):
    return M.market_summary(A.quoted(A.user_ticks(spark, d)), 5, ["U1", "U2"])


@query("latest_indicator", """
SELECT indicator, id, CAST(value AS DOUBLE) AS value, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY timestamp DESC, id DESC) AS rn FROM observations)
WHERE rn = 1""", ["observations"])
def _(spark, d):
    return M.latest_indicator(A.observations(spark, d))


@query("high_low_52w", """
WITH day AS (SELECT symbol, CAST(timestamp AS DATE) AS date, max(price) AS hi, min(price) AS lo
             FROM bars GROUP BY ALL)
SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(hi AS DOUBLE) AS day_high, CAST(lo AS DOUBLE) AS day_low,
       CAST(max(hi) OVER w AS DOUBLE) AS fifty_two_week_high, CAST(min(lo) OVER w AS DOUBLE) AS fifty_two_week_low
FROM day
WINDOW w AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 363 DAY PRECEDING AND CURRENT ROW)""", ["bars"])
def _(spark, d):
    return M.high_low_52w(A.bars(spark, d))


@query("signal_summary", f"""
WITH signals AS (
  SELECT unnest(symbols) AS symbol, CASE WHEN sentiment_score > 0.3 THEN 'BUY' ELSE 'SELL' END AS signal_type,
         abs(sentiment_score) AS confidence FROM scored WHERE len(symbols) > 0 AND abs(sentiment_score) > 0.3)
SELECT symbol, signal_type, count(*) AS signals, {settled_sql("avg(confidence)")} AS avg_confidence
FROM signals GROUP BY ALL""", ["scored"])
def _(spark, d):
    s = M.signal_summary(trading_signals(scored_news(spark, d), all_symbols=True))
    return s.withColumn("avg_confidence", settled("avg_confidence"))


_COUNTED = {"users": "customer", "stock_data": "events", "news_data": "documents", "notifications": "orders",
            "trades": "lineitem"}


@query("table_counts", "SELECT 'status' AS name, 'Sample Data Loaded Successfully!' AS status, "
       "CAST(NULL AS BIGINT) AS row_count" + "".join(
           f" UNION ALL SELECT '{n}', NULL, count(*) FROM {t}" for n, t in _COUNTED.items()))
def _(spark, d):
    return M.table_counts({n: A.table(spark, d, t) for n, t in _COUNTED.items()})


@query("news_filter", """
SELECT id, title, source, array_to_string(symbols, ',') AS symbols FROM counted
WHERE list_has_any(symbols, ['SCH', 'UNG']) AND category = 'de' ORDER BY timestamp DESC, id DESC LIMIT 500
""", ["counted"])
def _(spark, d):
    return M.news_filter(scored_news(spark, d), ["SCH", "UNG"], "de", 500).select("id", "title", "source", "symbols")
