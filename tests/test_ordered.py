"""Bucketed operators against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotelake.operators.history import newest_rows
from quotelake.operators.ordered import next_row, next_within, previous_row, rolling_sums, split_hot
from quotelake.operators.windows import ohlc_daily, window_sentiment

START = datetime(2024, 1, 1)
SCHEMA = "id BIGINT, symbol STRING, price BIGINT, timestamp TIMESTAMP_NTZ"


@pytest.fixture(scope="module")
def data():
    """A hot key, sparse keys, equal times, exact bucket edges, long gaps."""
    rnd = random.Random(5)
    out = []
    for i in range(600):
        symbol = "HOT" if i % 3 else rnd.choice("ABCDE")
        seconds = rnd.choice([0, 60, 120, 300, 3600, 86400 * 3, rnd.randrange(4000), rnd.randrange(400000)])
        out.append((i, symbol, rnd.randrange(1000), START + timedelta(seconds=seconds)))
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def by_symbol(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[1], r[3], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups.values()


@pytest.mark.parametrize("width", ["1 second", "1 minute", "7 minutes", "1 day"])
@pytest.mark.parametrize("step, hot_rows", [(-1, 10**6), (1, 10**6), (-1, 7), (1, 7)])
def test_neighbours(df, data, width, step, hot_rows):
    want = {}
    for g in by_symbol(data):
        for i, r in enumerate(g):
            j = i + step
            want[r[0]] = g[j][2] if 0 <= j < len(g) else None
    op, out = (previous_row, "previous") if step < 0 else (next_row, "following")
    got = op(df, ["symbol"], ["timestamp", "id"], ["price"], width, hot_rows=hot_rows)
    assert set(got.columns) == {*df.columns, out}
    assert {r["id"]: r[out] and r[out]["price"] for r in got.collect()} == want


def test_neighbour_with_null_value_is_not_skipped(rows):
    t = rows("id BIGINT, symbol STRING, price BIGINT, timestamp TIMESTAMP_NTZ",
             (1, "A", 5, "2024-01-01 00:00:00"), (2, "A", None, "2024-01-01 00:05:00"),
             (3, "A", 7, "2024-01-01 00:10:00"))
    got = previous_row(t, ["symbol"], ["timestamp", "id"], ["price"])
    assert {r["id"]: r["previous"] and r["previous"]["price"] for r in got.collect()} == {1: None, 2: 5, 3: None}
    assert {r["id"]: r["previous"] is None for r in got.collect()} == {1: True, 2: False, 3: False}


def test_hot_buckets_are_cut_into_small_runs(spark):
    """A burst inside one minute, copies of one instant and ids that are texts are all cut by the whole order key; the
    runs keep the order."""
    burst = spark.range(1000).select(
        "id", F.lit("BURST").alias("symbol"), (F.col("id") * 3 + 20_000_000).alias("at"))
    copies = spark.range(500).select(
        (F.lit(-2**62) + F.col("id") * (2**63 // 500)).alias("id"), F.lit("COPIES").alias("symbol"), F.lit(7).cast("bigint").alias("at"))
    calm = spark.range(50).select("id", F.lit("CALM").alias("symbol"), F.col("id").alias("at"))
    rows = burst.union(copies).union(calm).withColumn("_bucket", F.lit(0).cast("bigint"))
    for kind in ("bigint", "string"):
        typed = rows.withColumn("id", F.col("id").cast(kind))
        got = split_hot(typed, ["symbol"], ["at", "id"], hot_rows=100)
        runs = got.groupBy("symbol", "_part").agg(
            F.count("*").alias("n"), F.min(F.struct("at", "id")).alias("lo"), F.max(F.struct("at", "id")).alias("hi"))
        by_symbol = {}
        for r in runs.orderBy("symbol", "_part").collect():
            by_symbol.setdefault(r["symbol"], []).append(r)
        assert {k: len(v) for k, v in by_symbol.items()} == {"BURST": 10, "COPIES": 5, "CALM": 1}
        for parts in by_symbol.values():
            assert max(r["n"] for r in parts) <= 101
            assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("seconds, hot_rows", [(60, 10**6), (300, 10**6), (1800, 10**6), (1800, 5)])
def test_next_within(df, data, seconds, hot_rows):
    want = {}
    for g in by_symbol(data):
        for i, r in enumerate(g):
            near = i + 1 < len(g) and g[i + 1][3] < r[3] + timedelta(seconds=seconds)
            want[r[0]] = g[i + 1][2] if near else None
    got = next_within(df, ["symbol"], ["timestamp", "id"], seconds, ["price"], hot_rows=hot_rows)
    assert {r["id"]: r["following"] and r["following"]["price"] for r in got.collect()} == want


@pytest.mark.parametrize("width, hot_rows", [("1 minute", 10**6), ("1 hour", 10**6), ("1 hour", 5)])
def test_rolling_sums(df, data, width, hot_rows):
    spans = {"s1": ("1 minute", 60), "s2": ("1 hour", 3600)}
    want = {}
    for g in by_symbol(data):
        for r in g:
            want[r[0]] = tuple(
                sum(o[2] for o in g if r[3] - timedelta(seconds=n) <= o[3] <= r[3]) for _, n in spans.values())
    got = rolling_sums(df, ["symbol"], "timestamp", {"v": F.col("price")}, {k: v[0] for k, v in spans.items()}, width,
                       hot_rows)
    assert {r["id"]: (r["v_s1"], r["v_s2"]) for r in got.collect()} == want


@pytest.mark.parametrize("hot_rows", [10**6, 4])
def test_pairwise_sentiment_of_a_busy_minute(spark, hot_rows):
    rnd = random.Random(9)
    news = [(f"n{i:03}", ["UNKNOWN"], rnd.uniform(-1, 1), START + timedelta(seconds=rnd.choice([0, 0, 0, 30, 65, 3590])))
            for i in range(60)]
    value, n = None, 0
    for _, _, score, _ in sorted(news, key=lambda r: (r[3], r[0])):
        value, n = score if value is None else (value + score) / 2, n + 1
    table = spark.createDataFrame(news, "id STRING, symbols ARRAY<STRING>, sentiment_score DOUBLE, timestamp TIMESTAMP_NTZ")
    (got,) = window_sentiment(table, "1 day", "pairwise", hot_rows=hot_rows).collect()
    assert got.articles == n and got.avg_sentiment == pytest.approx(value)


def test_newest_rows_by_hashing(spark):
    day = datetime(2024, 1, 1)
    rows = [("A", 5, day, "x"), ("A", None, day, "y"), ("A", -7, day, "z"), ("B", None, day, "only"), ("C", 1, None, "untimed"),
            ("D", 2**63 - 1, day, "top"), ("D", -2**63, day + timedelta(microseconds=1), "later"), ("E", 3, day, "twice"),
            ("E", 3, day, "twice"), (None, 1, day, "none")]
    table = spark.createDataFrame(rows, "symbol STRING, id BIGINT, timestamp TIMESTAMP_NTZ, text STRING")
    got = newest_rows(table, ["symbol"], ("timestamp", "id"))
    assert got.columns == table.columns
    assert {r.symbol: r.text for r in got.collect()} == {
        "A": "x", "B": "only", "C": "untimed", "D": "later", "E": "twice", None: "none"} and got.count() == 6
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    named = table.withColumn("id", F.col("id").cast("string"))
    assert newest_rows(named, ["symbol"], ("timestamp", "id")).count() == 6


def test_bars_of_ticks_without_id(spark):
    day = datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("A", None, day, 5, 1), ("A", None, day + timedelta(hours=1), 7, 1)],
                                  "symbol STRING, id BIGINT, timestamp TIMESTAMP_NTZ, price BIGINT, volume BIGINT")
    (bar,) = ohlc_daily(ticks).collect()
    assert (bar.open, bar.high, bar.low, bar.close) == (5, 7, 5, 7)
