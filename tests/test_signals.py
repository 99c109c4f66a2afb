"""Thresholds at and next to their boundary."""

import pytest
from pyspark.sql import functions as F

from quotelake.operators import pattern as P
from quotelake.operators import signals as G
from quotelake.operators import windows as W

TICK = ("id BIGINT, symbol STRING, price DECIMAL(19,4), volume BIGINT, timestamp TIMESTAMP_NTZ, "
        "change DECIMAL(19,4), change_percent DECIMAL(10,4)")
NEWS = ("id BIGINT, title STRING, content STRING, url STRING, timestamp TIMESTAMP_NTZ, source STRING, "
        "sentiment_score DOUBLE, symbols ARRAY<STRING>, category STRING")


def tick(id, at="2024-01-01 00:00:00", price=100, volume=10, change=1, pct=0, symbol="A"):
    return (id, symbol, price, volume, at, change, pct)


def article(id, score=None, at="2024-01-01 00:00:00", symbols=("AAPL",), title="t", content="c"):
    return (id, title, content, f"u{id}", at, "s", score, None if symbols is None else list(symbols), "general")


def test_price_move_boundaries(rows):
    t = rows(TICK, tick(1, pct="-5.0"), tick(2, pct="4.9999"), tick(3, pct="5.0"), tick(4, pct=None),
             tick(5, pct="7", change=None), tick(6, pct="-4.9999"))
    got = {r["change_percent"]: r for r in G.price_change_alerts(t).collect()}
    assert sorted(float(k) for k in got) == [-5.0, 5.0, 7.0]
    kinds = {float(k): (r["alert_type"], float(r["previous_price"])) for k, r in got.items()}
    assert kinds == {-5.0: ("SIGNIFICANT_DECREASE", 99), 5.0: ("SIGNIFICANT_INCREASE", 99),
                     7.0: ("SIGNIFICANT_INCREASE", 100)}


def test_volume_anomaly(rows):
    # mean of 1, 1, 1, 9 is 3: nine is three times the mean, ten of 1, 1, 1, 10 is more
    def window(symbol, newest, day="01"):
        return [tick(i, f"2024-01-{day} 00:0{i}:00", volume=1, symbol=symbol) for i in range(3)] + [
            tick(9, f"2024-01-{day} 00:30:00", volume=newest, symbol=symbol, pct=None)]
    t = rows(TICK, *window("NO", 9), *window("YES", 10), tick(1, volume=1000, symbol="ONE"),
             # two rows at the newest time: the first to arrive counts
             *window("TIE", 1)[:3], tick(4, "2024-01-01 00:30:00", volume=500, symbol="TIE"),
             tick(5, "2024-01-01 00:30:00", volume=1, symbol="TIE"),
             *window("TIE2", 1)[:3], tick(4, "2024-01-01 00:30:00", volume=1, symbol="TIE2"),
             tick(5, "2024-01-01 00:30:00", volume=500, symbol="TIE2"),
             # the next hour is another window
             *window("SPLIT", 1)[:3], tick(4, "2024-01-01 01:00:00", volume=500, symbol="SPLIT"))
    got = W.volume_anomalies(t).collect()
    assert sorted(r["symbol"] for r in got) == ["TIE", "YES"]
    assert {r["symbol"]: float(r["change_percent"]) for r in got}["YES"] == 0
    assert all(r["current_price"] == r["previous_price"] and r["alert_type"] == "HIGH_VOLUME" for r in got)


def test_average_rounds_half_up(rows):
    t = rows(TICK, tick(1, price="1.0001"), tick(2, price="1.0002"), tick(3, price="3", symbol="B"),
             tick(4, "2024-01-01 00:04:59.999999", price="3.0001", symbol="B"),
             tick(5, "2024-01-01 00:05:00", price="9", symbol="B"))
    got = {(r["symbol"], str(r["window_start"])[11:16]): (float(r["avg_price"]), float(r["price_range"]), r["tick_count"])
           for r in W.window_price_stats(t).collect()}
    assert got == {("A", "00:00"): (1.0002, 0.0001, 2), ("B", "00:00"): (3.0001, 0.0001, 2), ("B", "00:05"): (9, 0, 1)}


def test_sentiment_counts_different_words_once(rows):
    n = rows(NEWS, article(1, title="Growth growth", content="profit and LOSS"), article(2, title="x", content=None),
             article(3, score=0.9, title="loss"), article(4, title="regrowth", content="below"))
    got = {r["id"]: r["sentiment_score"] for r in G.score_sentiment(n).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 0.0, 3: 0.9, 4: 0.0}
    words = {r["id"]: r["sentiment_score"] for r in G.score_sentiment(n, match="word").collect()}
    assert words[4] == -1.0


def test_symbols_keep_list_order_and_given_ones(rows):
    n = rows(NEWS, article(1, symbols=None, title="tsla and aapl"), article(2, symbols=(), content="msft"),
             article(3, symbols=("ZZ",), content="msft"), article(4, symbols=None, title="a very bad day"))
    got = {r["id"]: r["symbols"] for r in G.extract_symbols(n).collect()}
    assert got == {1: ["AAPL", "TSLA"], 2: ["MSFT"], 3: ["ZZ"], 4: ["V"]}
    words = {r["id"]: r["symbols"] for r in G.extract_symbols(n, match="word").collect()}
    assert words[4] == []


def test_trading_signal_boundaries(rows):
    n = rows(NEWS, article(1, 0.3), article(2, 0.3001), article(3, -0.3), article(4, -0.3001, symbols=("X", "Y")),
             article(5, 0.9, symbols=()), article(6, 0.9, symbols=None), article(7, None))
    got = {(r["symbol"], r["signal_type"], r["confidence"], r["reason"]) for r in G.trading_signals(n).collect()}
    assert got == {("AAPL", "BUY", 0.3001, "News sentiment: 0.3001 - t"),
                   ("X", "SELL", 0.3001, "News sentiment: -0.3001 - t")}
    assert G.trading_signals(n, all_symbols=True).count() == 3


def test_news_alert_boundaries(rows):
    n = rows(NEWS, article(1, 0.5, content="merger" + "x" * 194), article(2, 0.51, content="merger" + "x" * 195),
             article(3, -0.51, title="FDA"), article(4, None, title="dividend"), article(5, 0.9, content="nothing"),
             article(6, 0.9, title="merger", symbols=()))
    got = {r["id"]: (r["alert_type"], len(r["summary"]), r["summary"][-3:]) for r in G.news_alerts(n).collect()}
    assert got == {1: ("MARKET_NEWS", 200, "xxx"), 2: ("POSITIVE_NEWS", 203, "..."), 3: ("NEGATIVE_NEWS", 1, "c"),
                   4: ("MARKET_NEWS", 1, "c")}


PATTERN_ROWS = [
    article(1, 0.8, "2024-01-01 00:00:00", ("IN",)), article(2, -0.6, "2024-01-01 00:29:59", ("IN",)),
    article(3, 0.8, "2024-01-01 00:00:00", ("OUT",)), article(4, 0.6, "2024-01-01 00:30:00", ("OUT",)),
    article(5, 0.7, "2024-01-01 00:00:00", ("WEAK",)), article(6, 0.9, "2024-01-01 00:01:00", ("WEAK",)),
    # something unrelated in between
    article(7, 0.8, "2024-01-01 00:00:00", ("GAP",)), article(8, 0.5, "2024-01-01 00:05:00", ("GAP",)),
    article(9, 0.51, "2024-01-01 00:06:00", ("GAP",)),
    # two open starts: the second closes the first and is closed by the third
    article(10, 0.8, "2024-01-01 00:00:00", ("TWO",)), article(11, -0.9, "2024-01-01 00:10:00", ("TWO",)),
    article(12, 0.6, "2024-01-01 00:20:00", ("TWO",)),
    article(13, 0.8, "2024-01-01 00:00:00", None), article(14, 0.8, "2024-01-01 00:00:00", ()),
    article(15, None, "2024-01-01 00:00:00", ("NONE",)),
    article(16, 0.8, "2024-01-01 00:59:59", ("EDGE", "IN")), article(17, 0.8, "2024-01-01 01:00:00", ("EDGE",)),
]
PATTERN_STARTS = {"u1", "u7", "u10", "u11", "u13", "u16"}


def test_breaking_news_pattern(rows):
    got = P.breaking_news_pattern(rows(NEWS, *PATTERN_ROWS)).collect()
    assert {r["url"] for r in got} == PATTERN_STARTS and len(got) == len(PATTERN_STARTS)
    first = next(r for r in got if r["url"] == "u1")
    assert first["headline"] == "Breaking News Pattern Detected: t" and first["alert_type"] == "BREAKING_NEWS_PATTERN"


def test_pairwise_sentiment_is_the_fold(rows, spark):
    scores = [((i * 37) % 41 - 20) / 20 for i in range(300)]
    data = [article(i, s, f"2024-01-01 00:{i // 6:02d}:{(i * 7) % 60:02d}", ("HOT", "A")[: 1 + i % 2])
            for i, s in enumerate(scores)]
    n = rows(NEWS, *data)
    got = {(r["symbol"]): r["avg_sentiment"] for r in W.window_sentiment(n, mode="pairwise").collect()}
    for symbol in ("HOT", "A"):
        fold = None
        for d in sorted((d for d in data if symbol in d[7]), key=lambda d: (d[4], d[0])):
            fold = d[6] if fold is None else (fold + d[6]) / 2
        assert got[symbol] == pytest.approx(fold, abs=1e-12)


def test_union_keeps_duplicates(rows):
    a = G.price_change_alerts(rows(TICK, tick(1, pct=9)))
    assert G.all_stock_alerts(a, a).count() == 2


def test_ohlc_invariants(spark, sf_dir):
    from quotelake.sources import adapters as A

    bars = W.ohlc_interval(A.ticks(spark, sf_dir), "15m")
    assert bars.where("low > open OR low > close OR high < open OR high < close").count() == 0
    assert bars.agg(F.sum("volume")).first()[0] == A.ticks(spark, sf_dir).agg(F.sum("volume")).first()[0]
    with pytest.raises(ValueError):
        W.ohlc_interval(bars, "2h")


def test_busy_symbol_meets_the_alerts_that_fire(spark, monkeypatch):
    """Candidates follow the results: 1,500 alerts of one symbol, of which each event fires a few."""
    from decimal import Decimal

    from quotelake.operators import alerts as R

    monkeypatch.setattr(R, "LEAF", 8)
    monkeypatch.setattr(R, "BLOCK", 16)
    kinds = ["PRICE_ABOVE", "PRICE_BELOW", "VOLUME_SPIKE", "NEWS_SENTIMENT"]
    mine = [(i, i % 7, "A", kinds[i % 4], Decimal(i % 250) if i % 4 < 3 else Decimal(i % 250) / 250, i % 11 > 0) for i in range(1500)]
    mine += [(2000, 1, "B", "PRICE_ABOVE", Decimal(5), True), (2001, 1, None, "PRICE_ABOVE", Decimal(1), True)]
    users = spark.createDataFrame([(i, f"u{i}@x") for i in range(6)], "id LONG, email STRING")  # user 6 is gone
    alerts = spark.createDataFrame(mine, "id LONG, user_id LONG, symbol STRING, alert_type STRING, "
                                         "threshold_value DECIMAL(19,4), enabled BOOLEAN")
    seen = [(1, "A", Decimal("2.5"), 3, 0.1), (2, "A", Decimal(-1), None, None), (3, "A", None, 500, 1.0),
            (4, "A", Decimal(245), 0, 0.004), (5, "B", Decimal(5), 1, None), (6, None, Decimal(5), 1, None)] * 3
    events = spark.createDataFrame([(*e, None) for e in seen], "id LONG, symbol STRING, price DECIMAL(19,4), volume LONG, "
                                                               "sentiment_score DOUBLE, timestamp TIMESTAMP_NTZ")

    def fires(kind, price, volume, score, t):
        if kind == "NEWS_SENTIMENT":
            return score is not None and abs(score) >= float(t)
        if kind == "VOLUME_SPIKE":
            return volume is not None and volume >= t
        return price is not None and (price >= t if kind == "PRICE_ABOVE" else price <= t)

    want = sorted((e[0], a[0]) for e in seen for a in mine
                  if a[5] and a[1] < 6 and a[2] == e[1] is not None and fires(a[3], *e[2:5], a[4]))
    assert sorted((r.event_id, r.alert_id) for r in R.route_alerts(events, alerts, users).collect()) == want
    _, blocks, leaves = index = R.threshold_index(alerts, users)
    assert leaves.where(F.size("alerts") > 8).isEmpty() and blocks.where(F.size("lows") > 16).isEmpty()
    assert blocks.where("alert_type = 'PRICE_ABOVE' AND symbol = 'A'").count() > 1
    facts = events.select("id", "symbol", F.explode(F.array(F.lit("PRICE_ABOVE"))).alias("alert_type"),
                          F.col("price").cast("decimal(28,4)").alias("value"), F.lit(None).cast("double").alias("strength"))
    fired = sum(1 for e, a in want if a % 4 == 0)
    assert fired <= R.alert_candidates(facts, index).count() <= fired + 7 * len(seen)
