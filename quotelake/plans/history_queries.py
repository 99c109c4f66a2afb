"""Queries on stored ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import history as H
from quotelake.operators import windows as W
from quotelake.plans.catalog import AS_OF, query
from quotelake.sources import adapters as A

_TICK = "id, symbol, CAST(price AS DOUBLE) AS price, volume, timestamp, source"
_QUOTED = _TICK + ", CAST(change AS DOUBLE) AS change, change_percent"


@query("ohlc_daily", """
SELECT symbol, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date,
       CAST(arg_min(price, (timestamp, id)) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high,
       CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (timestamp, id)) AS DOUBLE) AS close,
       CAST(sum(volume) AS BIGINT) AS volume
FROM ticks GROUP BY symbol, CAST(timestamp AS DATE)""", ["ticks"])
def _(spark, d):
    return W.ohlc_daily(A.ticks(spark, d))


@query("ohlc_daily_bars", """
SELECT symbol, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date,
       CAST(arg_min(price, id) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high,
       CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, id) AS DOUBLE) AS close,
       CAST(sum(volume) AS BIGINT) AS volume
FROM bars GROUP BY symbol, CAST(timestamp AS DATE)""", ["bars"])
def _(spark, d):
    return W.ohlc_daily(A.bars(spark, d), order=("timestamp", "order_key"))


for _name, _width in [("1m", "1 minute"), ("5m", "5 minutes"), ("15m", "15 minutes"), ("1h", "1 hour"), ("1d", "1 day")]:
    @query(f"ohlc_interval_{_name}", f"""
    SELECT time_bucket(INTERVAL '{_width}', timestamp) AS window_start,
           time_bucket(INTERVAL '{_width}', timestamp) + INTERVAL '{_width}' AS window_end, symbol,
           CAST(arg_min(price, (timestamp, id)) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high,
           CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (timestamp, id)) AS DOUBLE) AS close,
           CAST(sum(volume) AS BIGINT) AS volume
    FROM ticks GROUP BY 1, 2, 3""", ["ticks"])
    def _(spark, d, _name=_name):
        return W.ohlc_interval(A.ticks(spark, d), _name)


@query("ohlc_history", """
WITH b AS (
  SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, symbol,
         CAST(arg_min(price, (timestamp, id)) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high,
         CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (timestamp, id)) AS DOUBLE) AS close,
         CAST(sum(volume) AS BIGINT) AS volume
  FROM ticks WHERE symbol = 'view' AND timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-30'
  GROUP BY 1, 2)
SELECT *, window_start + INTERVAL 1 HOUR AS window_end, count(*) OVER () AS total_elements,
       CAST(ceil(count(*) OVER () / 100.0) AS BIGINT) AS total_pages, false AS first,
       2 >= ceil(count(*) OVER () / 100.0) AS last
FROM b ORDER BY window_start LIMIT 100 OFFSET 100""", ["ticks"])
def _(spark, d):
    return W.ohlc_history(A.ticks(spark, d), "view", "2024-01-02 00:00:00", "2024-01-30 00:00:00", "1h", page=1)


@query("first_last_value", """
SELECT id, symbol, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date,
       CAST(first_value(price) OVER w AS DOUBLE) AS first_price, CAST(last_value(price) OVER w AS DOUBLE) AS last_price
FROM ticks
WINDOW w AS (PARTITION BY symbol, CAST(timestamp AS DATE) ORDER BY timestamp, id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", ["ticks"])
def _(spark, d):
    return H.first_last_value(A.ticks(spark, d)).select("id", "symbol", "date", "first_price", "last_price")


@query("filter_symbol", f"SELECT {_TICK} FROM ticks WHERE symbol = 'click'", ["ticks"])
def _(spark, d):
    return H.filter_symbol(A.ticks(spark, d), "click")


@query("filter_symbols", f"SELECT {_TICK} FROM ticks WHERE symbol IN ('click', 'view')", ["ticks"])
def _(spark, d):
    return H.filter_symbols(A.ticks(spark, d), ["click", "view"])


@query("filter_symbols_join", f"""
SELECT {_TICK} FROM ticks WHERE symbol IN (SELECT symbol FROM watchlist)""", ["ticks", "watchlist"])
def _(spark, d):
    return H.filter_symbols(A.ticks(spark, d), A.watchlist(spark, d))


@query("ticks_between", f"""
SELECT {_TICK} FROM ticks
WHERE symbol = 'view' AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""", ["ticks"])
def _(spark, d):
    return H.ticks_between(A.ticks(spark, d), "view", "2024-01-05 00:00:00", "2024-01-25 00:00:00")


@query("ticks_price_between", f"""
SELECT {_TICK} FROM ticks WHERE symbol = 'error' AND price BETWEEN 10.5 AND 100""", ["ticks"])
def _(spark, d):
    return H.ticks_price_between(A.ticks(spark, d), "error", 10.5, 100)


@query("big_movers_since", f"""
SELECT {_QUOTED} FROM quoted
WHERE abs(change_percent) >= 5 AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
ORDER BY abs(change_percent) DESC, timestamp DESC, symbol LIMIT 50""", ["quoted"])
def _(spark, d):
    return H.big_movers_since(A.quoted(A.ticks(spark, d)), 5, AS_OF, 50, "30 days")


@query("latest_for_symbols", f"""
SELECT {_TICK} FROM ticks t
WHERE symbol IN ('click', 'view', 'signup')
  AND timestamp = (SELECT max(timestamp) FROM ticks t2 WHERE t2.symbol = t.symbol)""", ["ticks"])
def _(spark, d):
    return H.latest_for_symbols(A.ticks(spark, d), ["click", "view", "signup"])


@query("latest_for_symbols_ties", """
SELECT symbol, CAST(price AS DOUBLE) AS price, volume, timestamp FROM bars b
WHERE timestamp = (SELECT max(timestamp) FROM bars b2 WHERE b2.symbol = b.symbol)""", ["bars"])
def _(spark, d):
    return H.latest_for_symbols(A.bars(spark, d).drop("order_key"))


@query("latest_tick", f"""
SELECT {_TICK} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, id DESC) AS rn
                     FROM user_ticks) WHERE rn = 1""", ["user_ticks"])
def _(spark, d):
    return H.latest_tick(A.user_ticks(spark, d))


@query("latest_tick_of", f"""
SELECT {_TICK} FROM ticks WHERE symbol = 'click' ORDER BY timestamp DESC, id DESC LIMIT 1""", ["ticks"])
def _(spark, d):
    return H.latest_tick(A.ticks(spark, d), "click")


@query("stock_statistics", """
SELECT symbol, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price, CAST(min(price) AS DOUBLE) AS min_price,
       CAST(max(price) AS DOUBLE) AS max_price, CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS data_points
FROM ticks WHERE timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY symbol""", ["ticks"])
def _(spark, d):
    return H.stock_statistics(A.ticks(spark, d), "2024-01-01 00:00:00", "2024-01-31 00:00:00")


@query("stock_statistics_bars", """
SELECT symbol, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price, CAST(min(price) AS DOUBLE) AS min_price,
       CAST(max(price) AS DOUBLE) AS max_price, CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS data_points
FROM bars WHERE timestamp BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-12-31' GROUP BY symbol""", ["bars"])
def _(spark, d):
    return H.stock_statistics(A.bars(spark, d), "1995-01-01 00:00:00", "2001-12-31 00:00:00")


@query("trending_by_volume", f"""
SELECT symbol, CAST(sum(volume) AS BIGINT) AS total_volume FROM user_ticks
WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY
GROUP BY symbol ORDER BY total_volume DESC, symbol LIMIT 10""", ["user_ticks"])
def _(spark, d):
    return H.trending_by_volume(A.user_ticks(spark, d), AS_OF, 10, "31 days")


@query("count_by_symbol", "SELECT symbol, count(*) AS tick_count FROM user_ticks GROUP BY symbol", ["user_ticks"])
def _(spark, d):
    return H.count_by_symbol(A.user_ticks(spark, d))


@query("distinct_symbols", "SELECT DISTINCT symbol FROM user_ticks ORDER BY symbol", ["user_ticks"])
def _(spark, d):
    return H.distinct_symbols(A.user_ticks(spark, d))


# The sketch promises a relative error; five of its standard deviations are compared with the exact count.
@query("approx_symbol_count", "SELECT count(DISTINCT symbol) AS symbols, true AS within_bound FROM user_ticks",
       ["user_ticks"])
def _(spark, d):
    ticks = A.user_ticks(spark, d)
    exact = ticks.agg(F.count_distinct("symbol").alias("symbols")).scalar()
    return H.approx_symbol_count(ticks, 0.01).select(
        exact.alias("symbols"), (F.abs(F.col("symbols") - exact) <= 0.05 * exact).alias("within_bound"))


@query("database_stats", """
SELECT 'symbol' AS kind, symbol, CAST(1 AS BIGINT) AS symbols, count(*) AS records FROM user_ticks GROUP BY symbol
UNION ALL SELECT 'total', NULL, count(DISTINCT symbol), count(*) FROM user_ticks""", ["user_ticks"])
def _(spark, d):
    return H.database_stats(A.user_ticks(spark, d))


@query("tick_returns", f"SELECT {_QUOTED} FROM quoted", ["quoted"])
def _(spark, d):
    return H.tick_returns(A.ticks(spark, d))


@query("rolling_average", """
SELECT id, symbol, CAST(price AS DOUBLE) AS price, volume, timestamp, source,
       CAST(sum(price) OVER five AS DOUBLE) / count(*) OVER five AS avg_price_5min,
       CAST(sum(price) OVER hour AS DOUBLE) / count(*) OVER hour AS avg_price_1h
FROM ticks
WINDOW five AS (PARTITION BY symbol ORDER BY timestamp RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW),
       hour AS (PARTITION BY symbol ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)
""", ["ticks"])
def _(spark, d):
    return W.rolling_average(A.ticks(spark, d))


@query("sliding_average", """
WITH starts AS (
  SELECT symbol, price,
         unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, timestamp) - INTERVAL 45 MINUTE,
                                time_bucket(INTERVAL 15 MINUTE, timestamp), INTERVAL 15 MINUTE)) AS window_start
  FROM ticks)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, symbol,
       ((2 * CAST(sum(price) * 10000 AS HUGEINT) + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS avg_price
FROM starts GROUP BY ALL""", ["ticks"])
def _(spark, d):
    return W.sliding_average(A.ticks(spark, d), "1 hour", "15 minutes")


@query("enrich_processed", """
SELECT id, symbol, CAST(price AS DOUBLE) AS price, volume, timestamp, source,
       ((2 * CAST(sum(price) OVER five * 10000 AS HUGEINT) + count(*) OVER five) // (2 * count(*) OVER five))
           / 10000.0::DOUBLE AS avg_price_5min,
       ((2 * CAST(sum(price) OVER hour * 10000 AS HUGEINT) + count(*) OVER hour) // (2 * count(*) OVER hour))
           / 10000.0::DOUBLE AS avg_price_1h,
       CAST(volume AS DOUBLE) * count(*) OVER hour / CAST(sum(volume) OVER hour AS DOUBLE) AS volume_ratio
FROM ticks
WINDOW five AS (PARTITION BY symbol, time_bucket(INTERVAL 5 MINUTE, timestamp)),
       hour AS (PARTITION BY symbol, time_bucket(INTERVAL 1 HOUR, timestamp))""", ["ticks"])
def _(spark, d):
    return W.enrich_processed(A.ticks(spark, d))


@query("top_k", f"SELECT {_TICK} FROM ticks ORDER BY price DESC, id LIMIT 25", ["ticks"])
def _(spark, d):
    return H.top_k(A.ticks(spark, d), [F.desc("price"), "id"], 25)


@query("tick_page", f"""
SELECT {_TICK}, (SELECT count(*) FROM ticks WHERE symbol = 'view') AS total_elements,
       CAST(ceil((SELECT count(*) FROM ticks WHERE symbol = 'view') / 20.0) AS BIGINT) AS total_pages,
       false AS first, 4 >= ceil((SELECT count(*) FROM ticks WHERE symbol = 'view') / 20.0) AS last
FROM ticks WHERE symbol = 'view' ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 60""", ["ticks"])
def _(spark, d):
    return H.tick_page(A.ticks(spark, d), "view", page=3, size=20)


@query("tick_page_after", f"""
SELECT {_TICK} FROM ticks WHERE symbol = 'view' AND timestamp < TIMESTAMP '2024-01-20'
ORDER BY timestamp DESC, id DESC LIMIT 20""", ["ticks"])
def _(spark, d):
    return H.tick_page_after(A.ticks(spark, d), "view", "2024-01-20 00:00:00", 0, 20)
