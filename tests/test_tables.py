"""Users, alerts, notifications and rules on the small seeded tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quotelake import schemas as S
from quotelake.operators import alerts as R
from quotelake.operators import history as H
from quotelake.operators import market as M
from quotelake.operators import notifications as N
from quotelake.operators import quality as Q
from quotelake.operators import users as U
from quotelake.sources import tables as TB

AS_OF = "2024-01-15 12:00:00"


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("db"))
    TB.load_seed(spark, "tests/fixtures", root, AS_OF)
    return {n: TB.read_table(spark, root, n) for n in S.TABLES} | {"root": root}


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_seed_and_counts(db):
    counts = {r["name"]: r["row_count"] for r in M.table_counts({n: db[n] for n in S.TABLES}).collect()}
    assert counts == {"status": None, "users": 3, "user_roles": 3, "user_watchlist": 4, "stock_data": 5, "news_data": 2,
                      "news_symbols": 4, "economic_data": 3, "notifications": 7, "user_alerts": 5,
                      "stock_data_processed": 1, "trading_signals": 3}
    assert TB.by_id(db["stock_data"], 2).first()["timestamp"] == datetime(2024, 1, 14, 10)
    assert db["users"].schema["email_verified"].dataType.simpleString() == "boolean"


def test_between_includes_both_ends(db):
    t = db["stock_data"]
    assert ids(H.ticks_between(t, "AAPL", "2024-01-14 10:00:00", "2024-01-15 11:00:00")) == [1, 2]
    assert ids(H.ticks_between(t, "AAPL", "2024-01-14 10:00:01", "2024-01-15 11:00:00")) == [1]
    assert ids(H.ticks_price_between(t, "AAPL", 179, 180.5)) == [1, 2]
    assert ids(H.ticks_price_between(t, "AAPL", 179.01, 180.49)) == []


def test_latest_and_ties(db):
    t = db["stock_data"]
    assert ids(H.latest_for_symbols(t, ["AAPL", "MSFT"])) == [1, 3, 4]
    assert ids(H.latest_tick(t)) == [1, 4, 5]
    assert ids(H.latest_tick(t, "MSFT")) == [4]
    assert ids(H.big_movers_since(t, 5, AS_OF)) == [3, 4]
    assert ids(H.filter_symbols(t, ["TSLA"] * 1500)) == [5]
    assert {r["indicator"]: r["id"] for r in M.latest_indicator(db["economic_data"]).collect()} == {"GDP": 2, "UNRATE": 3}


def test_pages(db):
    t = db["stock_data"]
    first = H.tick_page(t, "MSFT", 0, 1).first()
    assert (first["id"], first["total_elements"], first["total_pages"], first["first"], first["last"]) == (4, 2, 2, True, False)
    last = H.tick_page(t, "MSFT", 1, 1).first()
    assert (last["id"], last["first"], last["last"]) == (3, False, True)
    assert ids(H.tick_page_after(t, "MSFT", "2024-01-15 11:00:00", 4, 5)) == [3]


def test_movers_and_summary(db):
    t = db["stock_data"]
    assert [r["symbol"] for r in M.market_movers(t, "gainers").collect()] == ["MSFT", "AAPL"]
    assert [r["symbol"] for r in M.market_movers(t, "losers").collect()] == ["TSLA"]
    got = {(r["category"], r["symbol"]) for r in M.market_summary(t, 1, ["AAPL"]).collect()}
    assert got == {("indices", "AAPL"), ("top_gainers", "MSFT"), ("top_losers", "TSLA"), ("most_active", "TSLA")}
    summary = {(r["symbol"], r["signal_type"]): (r["signals"], r["avg_confidence"])
               for r in M.signal_summary(db["trading_signals"]).collect()}
    assert summary == {("AAPL", "BUY"): (2, pytest.approx(0.7)), ("TSLA", "HOLD"): (1, 0.5)}


def test_profiles_and_locks(db):
    p = sorted((r["user_id"], r["roles"], r["symbol"] or "") for r in
               U.user_profiles(db["users"], db["user_roles"], db["user_watchlist"]).collect())
    assert p == [(1, ["ADMIN", "USER"], "AAPL"), (1, ["ADMIN", "USER"], "MSFT"), (2, ["PREMIUM_USER"], "AAPL"),
                 (2, ["PREMIUM_USER"], "NONE"), (3, [], "")]
    # user 2 was locked until 10:00
    assert ids(U.unlocked_users(db["users"], AS_OF)) == [1, 2, 3]
    assert ids(U.unlocked_users(db["users"], "2024-01-15 10:00:00")) == [1, 3]
    one = U.unlocked_users(db["users"], AS_OF, verified=True, role="ADMIN", roles=db["user_roles"]).collect()
    assert [(r["id"], r["full_name"]) for r in one] == [(1, "Ann Lee")]


def test_one_shape_at_every_size(spark):
    many = spark.range(12_000).select(F.col("id"), F.concat(F.lit("S"), "id").alias("symbol"), F.lit(1.0).alias("price"))
    stats = H.database_stats(many).collect()
    assert len(stats) == 12_001
    assert [(r["symbol"], r["symbols"], r["records"]) for r in stats if r["kind"] == "total"] == [(None, 12_000, 12_000)]
    for n in (3, 1000, 1001, 5000):
        kept = H.filter_symbols(many, [f"S{i}" for i in range(n)])
        assert kept.columns == many.columns and kept.count() == n
    joined = H.filter_symbols(many, many.where("id < 7"))
    assert joined.columns == many.columns and joined.count() == 7
    watch = many.select(F.lit(1).alias("user_id"), "symbol")
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, username STRING")
    roles = spark.createDataFrame([], "user_id INT, role STRING")
    assert U.user_profiles(users, roles, watch).count() == 12_001
    news = spark.createDataFrame([(1, "t"), (2, "u")], "id INT, title STRING")
    assert U.news_with_symbols(news, watch.withColumnRenamed("user_id", "news_id")).count() == 12_001


def test_limits_are_what_was_asked_for(spark):
    quotes = spark.range(300).select(
        F.col("id"), F.concat(F.lit("S"), "id").alias("symbol"), F.col("id").alias("volume"), F.col("id").alias("price"),
        (F.col("id") + 1.0).alias("change_percent"), F.lit("2024-01-01").cast("timestamp_ntz").alias("timestamp"))
    assert M.market_movers(quotes, "gainers", 200).count() == 200
    news = quotes.select("id", "timestamp", F.array("symbol").alias("symbols"))
    assert M.news_filter(news, limit=250).count() == 250
    notes = quotes.select("id", F.lit(1).alias("user_id"), F.col("timestamp").alias("created_at"))
    assert N.notification_page(notes, 1, size=300).count() == 300


def test_watchlist_quotes_keep_unquoted(db):
    got = {(r["user_id"], r["symbol"]): r["latest_price"] for r in
           U.watchlist_quotes(db["user_watchlist"], db["stock_data"]).collect()}
    assert got[(2, "NONE")] is None and float(got[(1, "MSFT")]) == 401


def test_watchlist_changes_are_idempotent(rows, db):
    schema = "user_id BIGINT, symbol STRING, op STRING, added_at TIMESTAMP_NTZ, seq BIGINT"
    changes = rows(schema, (1, "tsla", "A", AS_OF, 1), (1, "TSLA", "A", AS_OF, 2), (1, "aapl", "A", AS_OF, 3),
                   (2, "none", "R", AS_OF, 4), (2, "none", "R", AS_OF, 5))
    once = U.update_watchlist(db["user_watchlist"], changes)
    assert {(r[0], r[1]) for r in once.collect()} == {(1, "AAPL"), (1, "MSFT"), (1, "TSLA"), (2, "AAPL")}
    assert once.where("symbol = 'AAPL' AND user_id = 1").first()["added_at"] == datetime(2024, 1, 10, 12)
    assert U.update_watchlist(once, changes).exceptAll(once).count() == 0
    again = rows(schema, (1, "aapl", "R", AS_OF, 1), (1, "aapl", "A", AS_OF, 2), (1, "msft", "A", AS_OF, 3),
                 (1, "msft", "R", AS_OF, 4))
    got = U.update_watchlist(once, again).where("user_id = 1")
    assert {(r["symbol"], r["added_at"]) for r in got.collect()} == {
        ("AAPL", datetime(2024, 1, 15, 12)), ("TSLA", datetime(2024, 1, 15, 12))}


def test_roles(rows, db):
    changes = rows("user_id BIGINT, role STRING, op STRING, changed_at TIMESTAMP_NTZ, seq BIGINT",
                   (1, "ADMIN", "R", AS_OF, 1), (2, "PREMIUM_USER", "R", AS_OF, 1), (2, "PREMIUM_USER", "A", AS_OF, 2),
                   (3, "ADMIN", "A", AS_OF, 1), (3, "ADMIN", "R", AS_OF, 2))
    got = U.update_roles(db["user_roles"], changes, db["users"].where("id = 3"))
    assert {(r[0], r[1]) for r in got.collect()} == {(1, "USER"), (2, "PREMIUM_USER"), (3, "USER")}


def test_alert_changes(rows, db):
    changes = rows(
        "id BIGINT, op STRING, user_id BIGINT, symbol STRING, alert_type STRING, threshold_value DECIMAL(19,4), "
        "enabled BOOLEAN, changed_at TIMESTAMP_NTZ, seq BIGINT",
        (1, "U", None, None, None, 190, None, AS_OF, 1), (1, "U", None, None, None, None, False, AS_OF, 2),
        (2, "U", None, None, None, 170, None, AS_OF, 1), (2, "D", None, None, None, None, None, AS_OF, 2),
        (77, "C", 3, "NVDA", "PRICE_BELOW", 500, True, AS_OF, 1),
        (3, "U", None, None, None, None, False, AS_OF, 1), (3, "D", None, None, None, None, None, AS_OF, 2),
        (3, "C", 3, "AMD", "PRICE_ABOVE", 5, None, AS_OF, 3))
    got = {r["id"]: r for r in U.update_alerts(db["user_alerts"], changes).collect()}
    assert sorted(got) == [1, 3, 4, 5, 77]
    assert (float(got[1]["threshold_value"]), got[1]["enabled"], got[1]["symbol"]) == (190, False, "AAPL")
    assert got[77]["symbol"] == "NVDA" and got[4]["updated_at"] is None
    assert (got[3]["symbol"], got[3]["enabled"], got[3]["created_at"]) == ("AMD", None, datetime(2024, 1, 15, 12))


def test_profile_changes_do_not_create_users(rows, db):
    changes = rows(
        "id BIGINT, first_name STRING, last_name STRING, phone_number STRING, changed_at TIMESTAMP_NTZ, seq BIGINT",
        (1, None, "Leigh", None, AS_OF, 1), (42, "X", None, None, AS_OF, 1))
    got = {r["id"]: (r["first_name"], r["last_name"], r["updated_at"]) for r in
           U.update_profiles(db["users"], changes).collect()}
    assert sorted(got) == [1, 2, 3] and got[1] == ("Ann", "Leigh", datetime(2024, 1, 15, 12))


def test_alert_routing_includes_the_threshold(db):
    got = R.route_alerts(db["stock_data"], db["user_alerts"], db["users"]).collect()
    assert sorted((r["alert_id"], r["event_id"]) for r in got) == [(1, 1), (2, 2), (3, 3)]
    assert {r["email"] for r in got} == {"ann@example.org"}
    per_day = R.route_alerts_per(db["stock_data"], db["user_alerts"], db["users"]).collect()
    assert sorted((r["alert_id"], str(r["window_start"])[:10]) for r in per_day) == [
        (1, "2024-01-15"), (2, "2024-01-14"), (3, "2024-01-15")]


def _with_symbol_arrays(db):
    named = db["news_symbols"].groupBy(F.col("news_id").alias("id")).agg(F.collect_set("symbol").alias("symbols"))
    return db["news_data"].drop("symbols").join(named, "id", "left").withColumn(
        "symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def test_news_routing(db):
    nested = _with_symbol_arrays(db).select(
        "id", F.col("title").alias("headline"), F.col("content").alias("summary"), "url",
        F.col("symbols").alias("affected_symbols"), F.col("sentiment_score").cast("double").alias("sentiment_score"),
        F.lit("MARKET_NEWS").alias("alert_type"), "timestamp")
    got = R.route_news_alerts(nested, db["user_watchlist"], db["user_alerts"], db["users"])
    # user 1 watches both symbols of article 1 and gets it once; user 2's alert is met exactly
    assert sorted((r["user_id"], r["news_id"]) for r in got.collect()) == [(1, 1), (2, 1), (2, 2)]


def test_preferences(rows, db):
    prefs = rows(
        "user_id BIGINT, email_enabled BOOLEAN, sms_enabled BOOLEAN, push_enabled BOOLEAN, alert_types ARRAY<STRING>",
        (2, True, False, True, ["PRICE_ABOVE"]))
    n = db["notifications"].withColumn("alert_type", F.when(F.col("id") == 6, "PRICE_ABOVE").when(
        F.col("id") == 7, "VOLUME_SPIKE"))
    assert ids(R.apply_preferences(n, prefs)) == [1, 2, 3, 4, 6]


def test_notification_selections(db):
    n = db["notifications"]
    assert ids(N.retryable_notifications(n)) == [2]
    assert ids(N.due_notifications(n, AS_OF)) == [4]
    assert ids(N.due_notifications(n, "2024-01-15 11:59:59")) == []
    again = N.requeue_failed(n, AS_OF, backoff=True).first()
    assert (again["retry_count"], again["status"], again["scheduled_at"]) == (3, "PENDING", datetime(2024, 1, 15, 12, 4))
    assert ids(N.release_due(n, AS_OF).where("status = 'PENDING'")) == [4]
    assert ids(N.recent_notifications(n, 2, AS_OF, "30 days", size=2)) == [4, 7]
    assert N.notification_page(n, 2, size=1000).count() == 4
    assert tuple(N.notification_stats(n).first()) == (7, 1, 2, 3)


def test_delivery(rows, db):
    outcomes = rows("id BIGINT, delivered BOOLEAN, error STRING, finished_at TIMESTAMP_NTZ",
                    (6, True, None, AS_OF), (7, False, None, AS_OF), (1, False, "late", AS_OF))
    got = {r["id"]: (r["status"], r["sent_at"], r["error_message"]) for r in
           N.apply_delivery_results(db["notifications"], outcomes).collect()}
    assert got[6] == ("SENT", datetime(2024, 1, 15, 12), None)
    assert got[7] == ("FAILED", None, "Failed to send email")
    assert got[5] == ("FAILED", None, "Failed to send notification")
    assert got[1][0] == "SENT" and got[2][2] == "boom"


def test_notification_texts(rows):
    a = rows("user_id BIGINT, email STRING, symbol STRING, alert_type STRING, change_percent DOUBLE, volume BIGINT, "
             "average_volume BIGINT, old_price DOUBLE, new_price DOUBLE, timestamp TIMESTAMP_NTZ",
             (1, "e", "AAPL", "HIGH_VOLUME", -5.125, 1000, 300, 2.0, 1.0, AS_OF))
    assert N.notify_price_alert(a).first()["subject"] == "Price Alert: AAPL Price Decrease 5.13%"
    v = N.notify_volume_alert(a).first()
    assert v["subject"] == "Volume Alert: AAPL - Unusual Volume (3.3x normal)"
    assert '"averageVolume":300' in v["template_data"]
    s = N.notify_stock_alert(a).first()
    assert (s["subject"], s["content"]) == ("Stock Alert: AAPL - HIGH_VOLUME", "Alert for AAPL: HIGH_VOLUME")
    assert '"alertType":"HIGH_VOLUME"' in s["template_data"]


def test_digest(db):
    d = U.daily_digest(db["users"], db["user_watchlist"], db["stock_data"], AS_OF)
    assert sorted((r["user_id"], r["symbol"]) for r in d.collect()) == [(1, "AAPL"), (1, "MSFT"), (2, "AAPL")]
    heads = {r["user_id"]: r["subject"] for r in N.digest_rows(d, "Q", AS_OF).collect()}
    assert heads == {1: "Daily Market Digest - 2024-01-15", 2: "Daily Market Digest - 2024-01-15"}


def test_table_rules(db):
    bad = {r["id"]: r["violations"] for r in Q.check_constraints(db["users"], "users").collect()}
    assert bad == {1: [], 2: [], 3: ["username is not 3 to 50 long", "password is not 6 to 120 long",
                                     "status is not a known value"]}
    for name in S.TABLES:
        if name in ("news_symbols", "stock_data_processed"):
            continue
        good, wrong = Q.split_by_violations(Q.check_constraints(db[name], name))
        assert good.columns == db[name].columns
        assert wrong.count() == (1 if name == "users" else 0)
    with pytest.raises(ValueError):
        Q.table_rules("nothing")


def test_record_rules(rows):
    r = rows("symbol STRING, price DOUBLE, volume BIGINT, timestamp TIMESTAMP_NTZ",
             ("A", 0.01, 0, AS_OF), ("A", 100000.0, 1, AS_OF), ("A", 0.009, -1, AS_OF), (None, None, None, None))
    got = [row["violations"] for row in Q.validate_records(r, "stock").collect()]
    assert got[:3] == [[], [], ["price is out of range", "volume is negative"]]
    assert got[3] == ["symbol is missing", "price is missing", "timestamp is missing"]


def test_keys_and_references(db):
    assert Q.check_unique_keys(db["user_watchlist"], ["user_id", "symbol"]).count() == 0
    assert Q.check_unique_keys(db["stock_data"], ["symbol", "timestamp"]).first()["occurrences"] == 2
    orphans = Q.check_foreign_keys(db["news_symbols"], db["news_data"], "news_id")
    assert [(r["news_id"], r["symbol"]) for r in orphans.collect()] == [(9, "GONE")]
    left = Q.cascade_delete(db["user_alerts"], db["users"].where("id <> 1"), "user_id")
    assert ids(left) == [4, 5]


def test_news_filter(db):
    n = _with_symbol_arrays(db)
    assert ids(M.news_filter(n, ["AAPL", "TSLA"])) == [1, 2]
    assert ids(M.news_filter(n, ["AAPL"], "business")) == []
    assert ids(M.news_filter(n, limit=1)) == [1]


def test_rows_without_a_time_or_price(rows):
    from quotelake.operators import windows as W
    from quotelake.streaming.sinks import expired_count, retain_since

    t = rows("id BIGINT, timestamp TIMESTAMP_NTZ", (1, None), (2, "2024-01-01 00:00:00"), (3, AS_OF))
    assert ids(retain_since(t, AS_OF)) == [1, 3] and expired_count(t, AS_OF).first()["deleted"] == 1
    ticks = rows("id BIGINT, symbol STRING, price DECIMAL(19,4), timestamp TIMESTAMP_NTZ",
                 (1, "A", 10, "2024-01-01 00:00:00"), (2, "A", None, "2024-01-01 00:00:10"),
                 (3, "A", 20, "2024-01-01 00:00:20"), (4, "B", None, "2024-01-01 00:00:20"))
    got = {r["id"]: r["avg_price_5min"] for r in W.rolling_average(ticks).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 15.0, 4: None}


def test_both_forms_of_routing_compare_alike(rows):
    at = "2024-01-01 00:00:00"
    events = rows("id BIGINT, symbol STRING, sentiment_score DOUBLE, timestamp TIMESTAMP_NTZ",
                  (1, "A", 0.49999, at), (2, "B", -0.5, at))
    mine = rows("id BIGINT, user_id BIGINT, symbol STRING, alert_type STRING, threshold_value DECIMAL(19,4), enabled BOOLEAN",
                (1, 1, "A", "NEWS_SENTIMENT", "0.5", True), (2, 1, "B", "NEWS_SENTIMENT", "0.5", True))
    users = rows("id BIGINT, email STRING", (1, "a@x"))
    assert [r["alert_id"] for r in R.route_alerts(events, mine, users).collect()] == [2]
    assert [r["alert_id"] for r in R.route_alerts_per(events, mine, users).collect()] == [2]


def test_open_and_close_aggregate_by_hashing(rows):
    from quotelake.operators import windows as W

    schema = "id BIGINT, symbol STRING, price DECIMAL(19,4), volume BIGINT, timestamp TIMESTAMP_NTZ"
    day = [(-5, "A", 1, 1, "2024-01-01 00:00:00"), (7, "A", 2, 1, "2024-01-01 00:00:00"),
           (3, "A", 3, 1, "2024-01-01 10:00:00"), (-9, "A", 4, 1, "2024-01-01 10:00:00")]
    for bars in (W.ohlc_daily(rows(schema, *day)), W.ohlc_interval(rows(schema, *day), "1d")):
        assert "SortAggregate" not in bars._jdf.queryExecution().executedPlan().toString()
        r = bars.first()
        assert (r["open"], r["close"]) == (1, 3)
    named = rows(schema.replace("id BIGINT", "id STRING"), *[(str(i), *r[1:]) for i, r in enumerate(day)])
    assert W.ohlc_daily(named).first()["close"] == 4
