"""Streams against batches, replays, retention, and the two jobs."""

import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_signals import NEWS, PATTERN_ROWS, PATTERN_STARTS, article

from quotelake.operators import windows as W
from quotelake.operators.quality import drop_repeated_keys
from quotelake.plans.stream_queries import NOW, run_to_files
from quotelake.sources import tables as TB
from quotelake.sources import topics as TP
from quotelake.streaming import jobs as J
from quotelake.streaming import sinks as K
from quotelake.streaming.lateness import late_rows, with_bounded_lateness
from quotelake.streaming.pattern_state import breaking_news_stream

TICK = "id BIGINT, symbol STRING, price DECIMAL(19,4), volume BIGINT, timestamp TIMESTAMP_NTZ, source STRING"


def land(path, *batches):
    """One file per micro-batch, in order."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{path}/b={i}")
    for i in range(len(batches)):
        for f in os.listdir(f"{path}/b={i}"):
            os.utime(f"{path}/b={i}/{f}", (1_700_000_000 + i * 60,) * 2)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b=*")


def test_pattern_stream_equals_batch(spark, rows, tmp_path):
    """Articles come in three batches, out of order inside them; a last far
    article moves the watermark past everything."""
    data = sorted(PATTERN_ROWS, key=lambda r: (r[4], -r[0]))
    third = len(data) // 3
    parts = [data[2 * third - 1:third - 1:-1], data[third - 1::-1], data[2 * third:],
             [article(99, 0.6, "2024-01-09 00:00:00", ("FAR",))], [article(100, 0.6, "2024-01-10 00:00:00", ("FAR",))]]
    land(str(tmp_path / "in"), *[rows(NEWS, *p) for p in parts])
    news = stream(spark, tmp_path / "in", rows(NEWS, *data[:1]).schema)
    q = breaking_news_stream(with_bounded_lateness(news, "2 hours"))
    out = run_to_files(spark, q, "p", str(tmp_path / "run"))
    got = [r["url"] for r in out.collect()]
    assert sorted(got) == sorted(PATTERN_STARTS)


def test_windows_and_late_rows(spark, rows, tmp_path):
    def t(id, at, price=1):
        return (id, "A", price, 1, f"2024-01-01 {at}", "s")
    land(str(tmp_path / "in"),
         rows(TICK, t(1, "00:01:00", 2), t(2, "00:06:00", 4)),
         rows(TICK, t(3, "00:05:50", 6), t(4, "00:20:00")),
         rows(TICK, t(5, "00:00:10", 100), t(6, "00:01:00", 100), t(7, "00:40:00")))  # 5 and 6: their window has closed
    ticks = with_bounded_lateness(stream(spark, tmp_path / "in", rows(TICK, t(1, "00:00:00")).schema))
    q = (W.window_price_stats(ticks).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(**NOW).start(str(tmp_path / "out")))
    q.awaitTermination()
    got = {str(r["window_start"])[11:16]: (float(r["avg_price"]), r["tick_count"])
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"00:00": (2.0, 1), "00:05": (5.0, 2), "00:20": (1.0, 1)}
    assert late_rows(q) >= 1  # counted after they were combined per input partition


def test_ingest_time_never_late(spark, rows):
    df = rows(TICK, (1, "A", 1, 1, "2001-01-01 00:00:00", "s"))
    assert with_bounded_lateness(df, time="ingest").first()["timestamp"].year > 2001
    with pytest.raises(ValueError):
        with_bounded_lateness(df, time="other")


def test_repeated_keys_in_a_stream(spark, rows, tmp_path):
    row = (1, "A", 1, 1, "2024-01-01 00:00:00", "s")
    land(str(tmp_path / "in"), rows(TICK, row, row), rows(TICK, row, (2, "A", 1, 1, "2024-01-01 00:00:01", "s")))
    ticks = with_bounded_lateness(stream(spark, tmp_path / "in", rows(TICK, row).schema))
    out = run_to_files(spark, drop_repeated_keys(ticks, ["symbol", "timestamp"]), "d", str(tmp_path / "run"))
    assert sorted(r["id"] for r in out.collect()) == [1, 2]


def processed(rows, *data):
    return rows("symbol STRING, price DECIMAL(19,4), volume BIGINT, timestamp TIMESTAMP_NTZ, change_percent DOUBLE, "
                "avg_price_5min DECIMAL(19,4), source STRING, arrival BIGINT", *data)


def test_upsert(spark, rows, tmp_path):
    at, later = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    first = processed(rows, ("A", 1, 10, at, 0.1, 1, "x", 1), ("A", 2, 20, at, 0.2, 2, "y", 2), ("B", 5, 5, later, None, 5, "x", 3))
    second = processed(rows, ("A", 3, 30, at, 0.3, 3, "z", 1))
    root = str(tmp_path / "t")

    def table():
        return {(r["symbol"], str(r["timestamp"])[:10]): (float(r["price"]), r["volume"], r["change_percent"],
                                                         float(r["avg_price_5min"]), r["source"])
                for r in K.read_processed(spark, root).collect()}
    K.upsert_batch(first, 0, root)
    assert table() == {("A", "2024-01-01"): (2, 20, 0.1, 1, "x"), ("B", "2024-01-02"): (5, 5, None, 5, "x")}
    K.upsert_batch(second, 1, root)
    once = table()
    assert once[("A", "2024-01-01")] == (3, 30, 0.1, 1, "x")
    K.upsert_batch(second, 1, root)
    assert table() == once
    merged = K.merge_processed(K.merge_processed(first.where("false"), first), second)
    assert merged.exceptAll(K.read_processed(spark, root)).count() == 0 and merged.count() == 2
    K.upsert_batch(processed(rows, ("A", 9, 90, at, None, 9, "w", 1)), 0, root, run="another")
    assert table()[("A", "2024-01-01")] == (9, 90, 0.1, 1, "x") and len(table()) == 2
    K.upsert_batch(second, 1, root)  # a late replay of the first run doesn't come before the second
    once = table()
    assert once[("A", "2024-01-01")] == (9, 90, 0.1, 1, "x")
    K.compact_processed(spark, root, str(tmp_path / "c"))
    root = str(tmp_path / "c")
    assert table() == once
    plan = K.read_processed(spark, root, start="2024-01-02 00:00:00")
    assert plan.count() == 1
    assert "dt#" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]


def test_retention(spark, rows, tmp_path):
    root = str(tmp_path)
    t = rows(TICK, *[(i, "A", i, 1, f"2024-01-{d:02d} {h:02d}:00:00", "s")
                     for i, (d, h) in enumerate([(1, 0), (2, 5), (3, 5), (3, 6), (3, 7), (4, 0)])])
    TB.write_table(t, root, "stock_data")
    assert K.delete_expired_days(spark, root, "stock_data", datetime(2024, 1, 3, 6)) == 3
    left = TB.read_table(spark, root, "stock_data")
    assert sorted(r["id"] for r in left.collect()) == [3, 4, 5]
    assert sorted(d for d in os.listdir(f"{root}/stock_data") if d.startswith("dt=")) == ["dt=2024-01-03", "dt=2024-01-04"]
    assert K.delete_expired_days(spark, root, "stock_data", datetime(2024, 1, 3, 6)) == 0
    assert TB.read_table(spark, root, "stock_data").count() == 3


def test_stream_of_ticks_into_day_partitions(spark, rows, tmp_path):
    data = rows(TICK, (1, "A", 1, 1, "2024-01-01 10:00:00", "s"), (2, "A", 1, 1, "2024-01-02 10:00:00", "s"))
    land(str(tmp_path / "in"), data)
    for _ in range(2):  # a restart reads nothing twice
        K.append_ticks(stream(spark, tmp_path / "in", data.schema), str(tmp_path), str(tmp_path / "cp"), NOW).awaitTermination()
    got = TB.read_table(spark, str(tmp_path), "stock_data", end="2024-01-01 23:00:00")
    assert [r["id"] for r in got.collect()] == [1] and TB.read_table(spark, str(tmp_path), "stock_data").count() == 2


def test_debug_sink(spark, rows, tmp_path):
    data = rows(TICK, (1, "A", 1, 1, "2024-01-01 10:00:00", "s"))
    land(str(tmp_path / "in"), data)
    q = K.debug_sink(stream(spark, tmp_path / "in", data.schema), "watched", memory=True)
    q.processAllAvailable()
    q.stop()
    assert spark.table("watched").count() == 1


def publish(folder, topic, records):
    path = f"{folder}/topic={topic}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{time.time_ns()}.txt", "w") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)


def topic_json(spark, out, name):
    return [json.loads(r["value"]) for r in spark.read.text(f"{out}/{name}").collect()]


def test_stock_job(spark, tmp_path):
    base = datetime(2022, 1, 1)

    def tick(minutes, volume=10, **k):
        at = int((base + timedelta(minutes=minutes)).timestamp() - base.timestamp()) + 1640995200
        return {"symbol": "AAPL", "price": 100 + minutes, "volume": volume, "timestamp": at, "source": "t"} | k
    folder, out = str(tmp_path / "topics"), str(tmp_path / "out")
    publish(folder, TP.STOCK, [tick(0), tick(1), tick(2, change=9, change_percent=9.5), tick(3), tick(4, volume=900),
                               tick(200, symbol="MSFT"), "not json"])
    publish(folder, "other", ["ignored"])

    def run():
        lines = TP.read_topic(spark, TP.STOCK, folder=folder)
        for q in J.start_stock_job(lines, out, str(tmp_path / "cp"), strict=False, trigger=NOW):
            q.awaitTermination()
    run()
    averages = spark.read.parquet(f"{out}/price_averages").collect()
    assert [(r["symbol"], float(r["avg_price"]), r["tick_count"]) for r in averages] == [("AAPL", 102.0, 5)]
    alerts = topic_json(spark, out, "stock_alerts")
    assert sorted((a["alertType"], a["currentPrice"], a["previousPrice"]) for a in alerts) == [
        ("HIGH_VOLUME", 104.0, 104.0), ("SIGNIFICANT_INCREASE", 102.0, 93.0)]
    assert K.read_processed(spark, f"{out}/stock_data_processed").count() == 6
    # more data after a restart: what was read stays read, a corrected price replaces the old one
    publish(folder, TP.STOCK, [tick(201, symbol="MSFT"), tick(0, price=55)])
    run()
    assert len(topic_json(spark, out, "stock_alerts")) == 2
    stored = K.read_processed(spark, f"{out}/stock_data_processed")
    assert stored.count() == 7
    assert float(stored.where("symbol = 'AAPL'").orderBy("timestamp").first()["price"]) == 55
    # a fresh checkpoint on the same tables is a new run and loses nothing that is stored
    before = {tuple(r) for r in stored.collect()}
    for q in J.start_stock_job(TP.read_topic(spark, TP.STOCK, folder=folder), out, str(tmp_path / "cp-new"), strict=False,
                               trigger=NOW):
        q.awaitTermination()
    again = {tuple(r) for r in K.read_processed(spark, f"{out}/stock_data_processed").collect()}
    assert again == before and len(list((tmp_path / "out" / "stock_data_processed").glob("run=*"))) == 2
    with pytest.raises(Exception, match="cannot decode message"):
        lines = TP.read_topic(spark, TP.STOCK, folder=folder)
        for q in J.start_stock_job(lines, str(tmp_path / "o2"), str(tmp_path / "c2"), trigger=NOW):
            q.awaitTermination()


def test_compaction_beside_a_running_upsert(spark, rows, tmp_path):
    """Generations keep what is stored the same while batches of two runs come and are replayed."""
    root = str(tmp_path / "p")

    def batch(n, run, *ticks):
        new = rows("symbol STRING, price DECIMAL(19,4), volume BIGINT, timestamp TIMESTAMP_NTZ, change_percent DOUBLE, "
                   "avg_price_5min DECIMAL(19,4), source STRING, arrival BIGINT",
                   *[("A", p, 1, f"2024-01-0{day} 00:00:00", float(p), p, "s", k) for k, (day, p) in enumerate(ticks)])
        K.upsert_batch(new, n, root, run=run)

    def stored():
        return [(int(r.price), int(r.avg_price_5min)) for r in K.read_processed(spark, root).orderBy("timestamp").collect()]
    batch(0, "one", (1, 10), (2, 20))
    batch(1, "one", (1, 11))
    assert stored() == [(11, 10), (20, 20)]
    os.makedirs(f"{root}/run=000000001_one/batch=7")  # being written: no sign that it is finished
    K.compact_in_place(spark, root)
    assert stored() == [(11, 10), (20, 20)]
    batch(1, "one", (1, 99))  # covered already
    batch(2, "one", (2, 21), (3, 30))
    batch(0, "two", (3, 31))
    want = [(11, 10), (21, 20), (31, 30)]
    assert stored() == want
    for _ in range(2):
        K.compact_in_place(spark, root)
        assert stored() == want
    assert K.read_processed(spark, root, start="2024-01-03 00:00:00").count() == 1
    assert len([n for n in os.listdir(root) if n.startswith("_generation")]) == 2


def test_stored_ticks_get_their_windows(spark, tmp_path):
    def tick(second, price, volume=10, symbol="A"):
        return {"symbol": symbol, "price": price, "volume": volume, "timestamp": 1640995200 + second, "source": "t"}
    folder, out = str(tmp_path / "topics"), str(tmp_path / "out")
    publish(folder, TP.STOCK, [tick(0, 10), tick(10, 20), tick(600, 60, 40), tick(90_000, 1, symbol="end")])

    def run():
        for q in J.start_stock_job(TP.read_topic(spark, TP.STOCK, folder=folder), out, str(tmp_path / "cp"), trigger=NOW,
                                   enrich=True):
            q.awaitTermination()
        rows = K.read_processed(spark, f"{out}/stock_data_processed", windows=True).where("symbol = 'A'").orderBy("timestamp").collect()
        return [(float(r.price), float(r.avg_price_5min), float(r.avg_price_1h), r.volume_ratio) for r in rows]
    want = [(10, 15, 30, 0.5), (20, 15, 30, 0.5), (60, 60, 30, 2)]
    assert run() == want
    # a correction that is too late for the windows still replaces the price, and nothing else
    publish(folder, TP.STOCK, [tick(10, 25), tick(100_000, 1, symbol="end")])
    assert run() == [want[0], (25, 15, 30, 0.5), want[2]]


def test_pairwise_fold_releases_in_order(spark, rows, tmp_path):
    from quotelake.streaming.sentiment_fold import pairwise_sentiment_stream

    schema = "symbols ARRAY<STRING>, sentiment_score DOUBLE, timestamp TIMESTAMP, id BIGINT"
    day = "2024-01-01 "
    batches = [
        [(["A"], 0.5, day + "10:20:00", 3), (["A", "B"], 0.9, day + "10:10:00", 2), ([], 1.0, day + "10:10:00", 9)],
        [(["A"], -0.3, day + "10:16:00", 5), (["A"], 0.1, day + "10:16:00", 4), (["B"], None, day + "10:30:00", 6)],
        [(["A"], 0.7, day + "10:40:00", 7)],
        [(["C"], 0.2, day + "12:00:00", 8)],  # passes the first hour
        [(["A"], 0.9, day + "10:50:00", 10), (["end"], 0.0, day + "23:00:00", 11)]]  # one too late
    got = []
    for batch in batches:
        land(str(tmp_path / "in"), rows(schema, *batch))
        news = with_bounded_lateness(stream(spark, tmp_path / "in", spark.createDataFrame([], schema).schema), "5 minutes")
        q = pairwise_sentiment_stream(news).writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(**NOW).start(str(tmp_path / "out"))
        q.awaitTermination()
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert got[:3] == [0, 0, 0] and got[3] == 2
    found = {(r.symbol, r.window_start.hour): (round(r.avg_sentiment, 9), r.articles)
             for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    scores = [0.9, 0.1, -0.3, 0.5, 0.7]  # of A in order of time and id
    value = scores[0]
    for s in scores[1:]:
        value = (value + s) / 2
    assert found == {("A", 10): (round(value, 9), 5), ("B", 10): (0.9, 1), ("C", 12): (0.2, 1)}


def test_alerts_become_notifications(spark, rows, tmp_path):
    at = "2024-01-01 00:00:00"
    users = rows("id BIGINT, email STRING", (1, "a@x"), (2, "b@x"))
    mine = rows("id BIGINT, user_id BIGINT, symbol STRING, alert_type STRING, threshold_value DECIMAL(19,4), enabled BOOLEAN",
                (1, 1, "A", "PRICE_ABOVE", 10, True), (2, 2, "A", "PRICE_ABOVE", 11, True),
                (3, 2, "B", "NEWS_SENTIMENT", "0.6", True))
    watch = rows("user_id BIGINT, symbol STRING", (1, "A"), (1, "B"))
    stock = rows("symbol STRING, alert_type STRING, current_price DECIMAL(19,4), previous_price DECIMAL(19,4), "
                 "change_percent DOUBLE, volume BIGINT, timestamp TIMESTAMP_NTZ", ("A", "HIGH_VOLUME", 10, 10, 0.0, 5, at))
    news = rows("headline STRING, summary STRING, url STRING, affected_symbols ARRAY<STRING>, sentiment_score DOUBLE, "
                "alert_type STRING, timestamp TIMESTAMP_NTZ", ("h", "s", "u", ["A", "B"], -0.6, "NEGATIVE_NEWS", at))
    land(str(tmp_path / "s"), stock)
    land(str(tmp_path / "n"), news)

    def run(name, schema, to_rows):
        for _ in range(2):
            J.start_notifications(stream(spark, tmp_path / name, schema), to_rows, str(tmp_path / f"{name}-out"),
                                  str(tmp_path / f"{name}-cp"), NOW).awaitTermination()
        return spark.read.parquet(str(tmp_path / f"{name}-out")).collect()
    got = run("s", stock.schema, lambda b: J.stock_notifications(b, mine, users))
    assert [(r["user_id"], r["subject"], r["status"]) for r in got] == [(1, "Stock Alert: A - PRICE_ABOVE", "PENDING")]
    data = json.loads(got[0]["template_data"])
    assert (data["eventType"], data["currentPrice"], data["previousPrice"], data["changePercent"]) == ("HIGH_VOLUME", 10, 10, 0)
    moved = rows("symbol STRING, alert_type STRING, current_price DECIMAL(19,4), previous_price DECIMAL(19,4), "
                 "change_percent DOUBLE, volume BIGINT, timestamp TIMESTAMP_NTZ",
                 ("A", "SIGNIFICANT_DECREASE", 9, 10, -10.0, 5, at), ("A", "HIGH_VOLUME", 9, 10, -10.0, 5, at),
                 ("C", "SIGNIFICANT_INCREASE", 9, 8, 12.5, 5, at))
    land(str(tmp_path / "p"), moved)
    priced = run("p", moved.schema, lambda b: J.price_notifications(b, watch, users))
    assert [(r["user_id"], r["subject"]) for r in priced] == [(1, "Price Alert: A Price Decrease 10.00%")]
    data = json.loads(priced[0]["template_data"])
    assert (data["oldPrice"], data["newPrice"], data["changePercent"]) == (10, 9, -10)
    got = run("n", news.schema, lambda b: J.news_notifications(b, watch, mine, users))
    assert sorted((r["user_id"], r["subject"], r["recipient_email"]) for r in got) == [
        (1, "News Alert: h", "a@x"), (2, "News Alert: h", "b@x")]


def test_news_job(spark, tmp_path):
    def news(minutes, title, **k):
        return {"title": title, "content": "quarterly merger talk", "url": title, "timestamp": 1640995200 + 60 * minutes,
                "source": "s", "category": "g"} | k
    folder, out = str(tmp_path / "topics"), str(tmp_path / "out")
    publish(folder, TP.NEWS, [
        news(0, "AAPL growth beat"), news(10, "AAPL strong profit"), news(20, "AAPL loss", sentiment_score=-0.4),
        news(300, "MSFT decline", sentiment_score=-0.9), news(500, "nothing", symbols=["ZZ"], sentiment_score=0.6)])
    lines = TP.read_topic(spark, TP.NEWS, folder=folder)
    for q in J.start_news_job(lines, out, str(tmp_path / "cp"), trigger=NOW):
        q.awaitTermination()
    signals = topic_json(spark, out, "trading_signals")
    assert sorted((s["symbol"], s["signalType"], s["confidence"]) for s in signals) == [
        ("AAPL", "BUY", 1.0), ("AAPL", "BUY", 1.0), ("AAPL", "SELL", 0.4), ("MSFT", "SELL", 0.9), ("ZZ", "BUY", 0.6)]
    alerts = topic_json(spark, out, "news_alerts")
    assert sorted((a["alertType"], a["headline"]) for a in alerts) == [
        ("BREAKING_NEWS_PATTERN", "Breaking News Pattern Detected: AAPL growth beat"),
        ("MARKET_NEWS", "AAPL loss"), ("NEGATIVE_NEWS", "MSFT decline"),
        ("POSITIVE_NEWS", "AAPL growth beat"), ("POSITIVE_NEWS", "AAPL strong profit"), ("POSITIVE_NEWS", "nothing")]
    lines = sorted(r["line"] for r in spark.read.parquet(f"{out}/sentiment_lines").collect())
    assert lines == ["Symbol: AAPL, Avg Sentiment: 0.300", "Symbol: MSFT, Avg Sentiment: -0.900"]


def test_user_thresholds_on_every_tick(spark, rows, tmp_path):
    folder, out = str(tmp_path / "topics"), str(tmp_path / "out")
    publish(folder, TP.STOCK, [
        {"symbol": "A", "price": p, "volume": v, "timestamp": 1640995200 + i, "source": "t"}
        for i, (p, v) in enumerate([(10, 5), (11, 5), (11, 50)])])
    mine = rows("id BIGINT, user_id BIGINT, symbol STRING, alert_type STRING, threshold_value DECIMAL(19,4), enabled BOOLEAN",
                (1, 1, "A", "PRICE_ABOVE", 11, True), (2, 1, "A", "VOLUME_SPIKE", 50, True),
                (3, 1, "A", "PRICE_BELOW", 9, True))
    users = rows("id BIGINT, email STRING", (1, "a@x"))
    lines = TP.read_topic(spark, TP.STOCK, folder=folder)
    for q in J.start_stock_job(lines, out, str(tmp_path / "cp"), trigger=NOW, user_alerts=mine, users=users):
        q.awaitTermination()
    # no tick moved by 5 %, so the common topic is silent
    assert sorted(a["alertId"] for a in topic_json(spark, out, "price_alerts")) == [1, 1]
    assert [(a["alertId"], a["volume"]) for a in topic_json(spark, out, "volume_alerts")] == [(2, 50)]
