"""Detectors, windows and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions import lexicons as lex
from quotelake.operators import pattern as P
from quotelake.operators import signals as G
from quotelake.operators import windows as W
from quotelake.plans.catalog import KEYWORDS, NEGATIVE, POSITIVE, TICKERS, query, settled, settled_sql
from quotelake.sources import adapters as A

STOCK_ALERT_COLUMNS = """symbol, alert_type, CAST(current_price AS DOUBLE) AS current_price,
       CAST(previous_price AS DOUBLE) AS previous_price, change_percent, volume, timestamp"""

PRICE_ALERTS_SQL = """price_alerts AS (
  SELECT symbol, CASE WHEN change_percent > 0 THEN 'SIGNIFICANT_INCREASE' ELSE 'SIGNIFICANT_DECREASE' END AS alert_type,
         price AS current_price, price - coalesce(change, 0) AS previous_price, change_percent, volume, timestamp
  FROM quoted WHERE abs(change_percent) >= 5)"""

VOLUME_ALERTS_SQL = """volume_alerts AS (
  SELECT symbol, 'HIGH_VOLUME' AS alert_type, n.price AS current_price, n.price AS previous_price,
         coalesce(n.change_percent, 0) AS change_percent, n.volume AS volume, n.timestamp AS timestamp
  FROM (SELECT symbol, arg_max(struct_pack(price := price, change_percent := change_percent, volume := volume,
                                           timestamp := timestamp), (timestamp, -id)) AS n,
               sum(volume) AS total, count(*) AS ticks
        FROM quoted GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, timestamp))
  WHERE ticks > 1 AND n.volume > (total // ticks) * 3)"""

_KEYWORD_HIT = "(" + " OR ".join(f"contains(lower_text, '{k}')" for k in KEYWORDS) + ")"

NEWS_ALERTS_SQL = f"""news_alerts AS (
  SELECT id, title AS headline,
         CASE WHEN length(content) > 200 THEN content[1:200] || '...' ELSE content END AS summary, url,
         symbols AS affected_symbols, sentiment_score,
         CASE WHEN sentiment_score > 0.5 THEN 'POSITIVE_NEWS' WHEN sentiment_score < -0.5 THEN 'NEGATIVE_NEWS'
              ELSE 'MARKET_NEWS' END AS alert_type, timestamp
  FROM scored WHERE len(symbols) > 0 AND {_KEYWORD_HIT})"""

PATTERN_SQL = """pattern_alerts AS (
  SELECT 'Breaking News Pattern Detected: ' || title AS headline,
         'Multiple significant news events detected in short timeframe' AS summary, url,
         symbols AS affected_symbols, sentiment_score, 'BREAKING_NEWS_PATTERN' AS alert_type, timestamp
  FROM (SELECT *, coalesce(symbols[1], 'UNKNOWN') AS k FROM scored) s
  WHERE abs(sentiment_score) > 0.7 AND EXISTS (
    SELECT 1 FROM (SELECT *, coalesce(symbols[1], 'UNKNOWN') AS k FROM scored) f
    WHERE f.k = s.k AND abs(f.sentiment_score) > 0.5
      AND (f.timestamp > s.timestamp OR (f.timestamp = s.timestamp AND f.id > s.id))
      AND f.timestamp < s.timestamp + INTERVAL 30 MINUTE))"""

NEWS_ALERT_COLUMNS = """headline, summary, url, array_to_string(affected_symbols, ',') AS affected_symbols, sentiment_score,
       alert_type, timestamp"""


def quoted(spark, d):
    return A.quoted(A.ticks(spark, d))


def scored_news(spark, d):
    """Articles with score and symbols from the lexicons of the catalogue."""
    return G.extract_symbols(G.score_sentiment(A.news(spark, d), POSITIVE, NEGATIVE), TICKERS)


@query("price_change_alerts", f"WITH {PRICE_ALERTS_SQL} SELECT {STOCK_ALERT_COLUMNS} FROM price_alerts", ["quoted"])
def _(spark, d):
    return G.price_change_alerts(quoted(spark, d))


@query("volume_anomalies", f"WITH {VOLUME_ALERTS_SQL} SELECT {STOCK_ALERT_COLUMNS} FROM volume_alerts", ["quoted"])
def _(spark, d):
    return W.volume_anomalies(quoted(spark, d))


@query("all_stock_alerts", f"""
WITH {PRICE_ALERTS_SQL}, {VOLUME_ALERTS_SQL}
SELECT {STOCK_ALERT_COLUMNS} FROM (SELECT * FROM price_alerts UNION ALL SELECT * FROM volume_alerts)""", ["quoted"])
def _(spark, d):
    q = quoted(spark, d)
    return G.all_stock_alerts(G.price_change_alerts(q), W.volume_anomalies(q))


_STATS = """
SELECT time_bucket(INTERVAL '{w}', timestamp) AS window_start,
       time_bucket(INTERVAL '{w}', timestamp) + INTERVAL '{w}' AS window_end, symbol,
       ((2 * CAST(sum(price) * 10000 AS HUGEINT) + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS avg_price,
       CAST(max(price) - min(price) AS DOUBLE) AS price_range, count(*) AS tick_count
FROM {t} GROUP BY 1, 2, 3"""


@query("window_price_stats", _STATS.format(w="5 minutes", t="ticks"), ["ticks"])
def _(spark, d):
    return W.window_price_stats(A.ticks(spark, d))


@query("window_price_stats_users", _STATS.format(w="1 day", t="user_ticks"), ["user_ticks"])
def _(spark, d):
    return W.window_price_stats(A.user_ticks(spark, d), "1 day")


@query("score_sentiment", "SELECT id, sentiment_score FROM scored", ["scored"])
def _(spark, d):
    return G.score_sentiment(A.news(spark, d), POSITIVE, NEGATIVE).select("id", "sentiment_score")


def _sum_of(column, words):
    return " + ".join(f"CAST(contains({column}, '{w}') AS INTEGER)" for w in words)


@query("score_sentiment_market_words", f"""
SELECT id, CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE CAST(p - n AS DOUBLE) / (p + n) END AS sentiment_score
FROM (SELECT id, {_sum_of("lower_text", lex.POSITIVE_WORDS)} AS p, {_sum_of("lower_text", lex.NEGATIVE_WORDS)} AS n
      FROM news)""", ["news"])
def _(spark, d):
    return G.score_sentiment(A.news(spark, d)).select("id", "sentiment_score")


@query("extract_symbols", f"""
SELECT id, array_to_string(list_filter({lex.KNOWN_SYMBOLS}, lambda x: contains(upper_text, x)), ',') AS symbols
FROM news""", ["news"])
def _(spark, d):
    return G.extract_symbols(A.news(spark, d)).select("id", "symbols")


@query("extract_symbols_words", f"""
SELECT id, array_to_string(list_filter({lex.KNOWN_SYMBOLS},
       lambda x: regexp_matches(upper_text, '\\b' || x || '\\b')), ',') AS symbols
FROM news""", ["news"])
def _(spark, d):
    return G.extract_symbols(A.news(spark, d), match="word").select("id", "symbols")


_SIGNAL = """SELECT {symbol} AS symbol, CASE WHEN sentiment_score > 0.3 THEN 'BUY' ELSE 'SELL' END AS signal_type,
       abs(sentiment_score) AS confidence,
       'News sentiment: ' || CAST(sentiment_score AS VARCHAR) || ' - ' || title AS reason,
       'news-analysis' AS source, timestamp
FROM scored WHERE len(symbols) > 0 AND abs(sentiment_score) > 0.3"""


@query("trading_signals", _SIGNAL.format(symbol="symbols[1]"), ["scored"])
def _(spark, d):
    return G.trading_signals(scored_news(spark, d))


@query("trading_signals_all_symbols", _SIGNAL.format(symbol="unnest(symbols)"), ["scored"])
def _(spark, d):
    return G.trading_signals(scored_news(spark, d), all_symbols=True)


@query("news_alerts", f"WITH {NEWS_ALERTS_SQL} SELECT id, {NEWS_ALERT_COLUMNS} FROM news_alerts", ["scored"])
def _(spark, d):
    return G.news_alerts(scored_news(spark, d), KEYWORDS)


@query("breaking_news_pattern", f"WITH {PATTERN_SQL} SELECT {NEWS_ALERT_COLUMNS} FROM pattern_alerts", ["scored"])
def _(spark, d):
    return P.breaking_news_pattern(scored_news(spark, d))


@query("all_news_alerts", f"""
WITH {NEWS_ALERTS_SQL}, {PATTERN_SQL}
SELECT {NEWS_ALERT_COLUMNS} FROM (
  SELECT headline, summary, url, affected_symbols, sentiment_score, alert_type, timestamp FROM news_alerts
  UNION ALL SELECT * FROM pattern_alerts)""", ["scored"])
def _(spark, d):
    n = scored_news(spark, d)
    return G.all_news_alerts(G.news_alerts(n, KEYWORDS), P.breaking_news_pattern(n))


_EXPLODED = """exploded AS (
  SELECT unnest(symbols) AS symbol, sentiment_score AS score, timestamp, id,
         time_bucket(INTERVAL 1 HOUR, timestamp) AS w FROM scored)"""


@query("window_sentiment_mean", f"""
WITH {_EXPLODED}
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, symbol, {settled_sql("avg(score)")} AS avg_sentiment,
       count(*) AS articles FROM exploded GROUP BY w, symbol""", ["scored"])
def _(spark, d):
    return W.window_sentiment(scored_news(spark, d)).withColumn("avg_sentiment", settled("avg_sentiment"))


PAIRWISE_SQL = f"""{_EXPLODED}, pairwise AS (
  SELECT w, symbol, list_reduce(list(score ORDER BY timestamp, id), lambda a, b: (a + b) / 2) AS r, count(*) AS n
  FROM exploded GROUP BY w, symbol)"""


@query("window_sentiment_pairwise", f"""
WITH {PAIRWISE_SQL}
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, symbol, {settled_sql("r")} AS avg_sentiment, n AS articles
FROM pairwise""", ["scored"])
def _(spark, d):
    return W.window_sentiment(scored_news(spark, d), mode="pairwise").withColumn(
        "avg_sentiment", settled("avg_sentiment"))


# Articles are a minute apart at least, so windows of 30 and 90 seconds cut minutes and join them.
def _pairwise_of(seconds):
    @query(f"window_sentiment_pairwise_{seconds}s", f"""
    WITH short AS (SELECT symbol, score, timestamp, id, time_bucket(INTERVAL {seconds} SECOND, timestamp) AS w FROM (
      SELECT unnest(symbols) AS symbol, sentiment_score AS score, id,
             TIMESTAMP '2024-01-01' + id * INTERVAL 11 SECOND AS timestamp FROM scored)),
    pairwise AS (SELECT w, symbol, list_reduce(list(score ORDER BY timestamp, id), lambda a, b: (a + b) / 2) AS r,
                 count(*) AS n FROM short GROUP BY w, symbol)
    SELECT w AS window_start, w + INTERVAL {seconds} SECOND AS window_end, symbol, {settled_sql("r")} AS avg_sentiment,
           n AS articles FROM pairwise""", ["scored"])
    def _(spark, d):
        at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs=F.col("id") * 11)
        dense = scored_news(spark, d).withColumn("timestamp", at)
        return W.window_sentiment(dense, f"{seconds} seconds", "pairwise").withColumn(
            "avg_sentiment", settled("avg_sentiment"))


_pairwise_of(30)
_pairwise_of(90)


@query("sentiment_lines", f"""
WITH {PAIRWISE_SQL}
SELECT w AS window_start, symbol, 'Symbol: ' || symbol || ', Avg Sentiment: ' ||
       CAST(CAST(round(CAST(r AS DECIMAL(18,12)), 3) AS DECIMAL(18,3)) AS VARCHAR) AS line
FROM pairwise""", ["scored"])
def _(spark, d):
    pairwise = W.window_sentiment(scored_news(spark, d), mode="pairwise")
    return W.sentiment_lines(pairwise.withColumn("avg_sentiment", F.round("avg_sentiment", 12)))
