"""Tumbling-window aggregates.

Everything here is a partial aggregate: rows of a hot symbol are combined
before the shuffle. The functions also run on streams; put a watermark on the
input first (`quotelake.streaming.lateness`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions import lexicons as lex
from quotelake.functions.timefn import time_bucket
from quotelake.operators.history import page_of, place_of, position, ticks_in
from quotelake.operators.ordered import HOT_ROWS, rolling_sums, split_hot, written

INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}


def _bounds(df):
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def window_price_stats(ticks: DataFrame, width="5 minutes") -> DataFrame:
    """Average (4 places, half up), range and count per symbol and window."""
    stats = ticks.groupBy(F.window("timestamp", width), "symbol").agg(
        F.round(F.sum("price") / F.count("price"), 4).alias("avg_price"),
        (F.max("price") - F.min("price")).alias("price_range"),
        F.count("price").alias("tick_count"),
    )
    return _bounds(stats)


def volume_anomalies(ticks: DataFrame, width="1 hour", factor=lex.VOLUME_FACTOR, arrival="id") -> DataFrame:
    """HIGH_VOLUME where a window's newest tick exceeds ``factor`` times its mean.

    The mean is an integer division and includes the newest tick. Of several
    ticks at the newest time the first to arrive counts.
    """
    at = place_of(F.col("timestamp"), F.bitwise_not(F.col(arrival)))  # the first to arrive ranks highest
    no_change = F.lit(0).cast(ticks.schema["change_percent"].dataType)
    return (
        ticks.groupBy(F.window("timestamp", width), "symbol")
        .agg(*[F.max_by(c, at).alias(f"_{c}") for c in ("price", "change_percent", "volume")],
             F.max("timestamp").alias("_timestamp"), F.sum("volume").alias("total"), F.count("volume").alias("ticks"))
        .where((F.col("ticks") > 1) & (F.col("_volume") > F.expr("total div ticks") * factor))
        .select(
            "symbol", F.lit("HIGH_VOLUME").alias("alert_type"),
            F.col("_price").alias("current_price"), F.col("_price").alias("previous_price"),
            F.coalesce("_change_percent", no_change).alias("change_percent"),
            F.col("_volume").alias("volume"), F.col("_timestamp").alias("timestamp"),
        )
    )


def _scores(news):
    return news.where(F.size("symbols") > 0).where(F.col("sentiment_score").isNotNull())


def window_sentiment(news: DataFrame, width="1 hour", mode="mean", order=("timestamp", "id"),
                     hot_rows=HOT_ROWS) -> DataFrame:
    """Sentiment per symbol and window.

    ``mean`` is the plain average. ``pairwise`` halves the running value with
    every article, r = (r + s) / 2 in arrival order, starting from the first:
    an exponential average with weight one half. It is computed per minute, minutes with very many articles in
    several parts, and these are put together, so no window has to fit in one task (batch; for streams see
    `quotelake.streaming.sentiment_fold`).
    """
    scored = _scores(news).select(
        F.explode("symbols").alias("symbol"), *[c for c in order if c != "timestamp"], "timestamp",
        F.col("sentiment_score").cast("double").alias("score"))
    if mode == "mean":
        return _bounds(
            scored.groupBy(F.window("timestamp", width), "symbol")
            .agg(F.avg("score").alias("avg_sentiment"), F.count("score").alias("articles")))
    if mode != "pairwise":
        raise ValueError(f"mode must be 'mean' or 'pairwise', not {mode!r}")
    half = F.lit(0.5)
    # windows need not consist of whole minutes, so ranks are within both
    group = ["symbol", "window", "_bucket", "_part"]
    newest_first = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    placed = written(scored.where("timestamp IS NOT NULL").withColumn("window", F.window("timestamp", width)).withColumn(
        "_bucket", time_bucket(F.col("timestamp"), "1 minute")), "scores")
    minutes = (
        split_hot(placed, ["symbol", "window"], list(order), hot_rows)
        .withColumn("_rn", F.row_number().over(newest_first))
        .groupBy(*group)
        .agg(
            F.sum(F.col("score") * F.pow(half, F.col("_rn"))).alias("folded"),
            F.count("score").alias("n"),
            F.min_by("score", F.struct(*order)).alias("first_score"),
        )
    )
    later = (
        Window.partitionBy("symbol", "window").orderBy(F.col("_bucket").desc(), F.col("_part").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = minutes.withColumn("_later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    # the first article has no predecessor, so its weight is that of a pair
    whole = placed.groupBy("symbol", "window").agg(
        F.sum(F.col("folded") * F.pow(half, F.col("_later"))).alias("folded"),
        F.sum("n").alias("articles"),
        F.min_by("first_score", F.struct("_bucket", "_part")).alias("first_score"),
    )
    return _bounds(whole.select(
        "window", "symbol",
        (F.col("folded") + F.col("first_score") * F.pow(half, F.col("articles"))).alias("avg_sentiment"),
        "articles"))


def sentiment_lines(sentiment: DataFrame) -> DataFrame:
    """The printed form of `window_sentiment`."""
    return sentiment.select(
        "window_start", "symbol",
        F.format_string("Symbol: %s, Avg Sentiment: %.3f", "symbol", "avg_sentiment").alias("line"))


def _ohlcv(ticks, groups, order):
    at = position(ticks, order)
    return ticks.groupBy(*groups).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))


def ohlc_daily(ticks: DataFrame, order=("timestamp", "id")) -> DataFrame:
    """Open, high, low, close and volume per symbol and day."""
    return _ohlcv(ticks, ["symbol", F.to_date("timestamp").alias("date")], order)


def ohlc_interval(ticks: DataFrame, interval="1h", order=("timestamp", "id")) -> DataFrame:
    """As `ohlc_daily` for the intervals 1m, 5m, 15m, 1h and 1d."""
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {sorted(INTERVALS)}")
    return _bounds(_ohlcv(ticks, [F.window("timestamp", INTERVALS[interval]), "symbol"], order))


def ohlc_history(ticks: DataFrame, symbol, start, end, interval="1d", page=0, size=100,
                 order=("timestamp", "id")) -> DataFrame:
    """A page of one symbol's bars between two times, oldest first."""
    bars = ohlc_interval(ticks_in(ticks, symbol, start, end), interval, order)
    return page_of(bars, ["window_start"], page, size)


def rolling_average(ticks: DataFrame, spans=None, width="1 minute") -> DataFrame:
    """True moving averages of the price over the trailing spans. Ticks without a price don't count."""
    spans = spans or {"5min": "5 minutes", "1h": "1 hour"}
    summed = rolling_sums(
        ticks, ["symbol"], "timestamp",
        {"_sum": F.coalesce(F.col("price"), F.lit(0)).cast("decimal(28,4)"),
         "_n": F.col("price").isNotNull().cast("bigint")}, spans, width)
    out = summed
    for name in spans:
        out = out.withColumn(
            f"avg_price_{name}", F.try_divide(F.col(f"_sum_{name}").cast("double"), F.col(f"_n_{name}")))
    return out.drop(*[f"{v}_{s}" for v in ("_sum", "_n") for s in spans])


def sliding_average(ticks: DataFrame, length="5 minutes", slide="1 minute") -> DataFrame:
    """Moving average on overlapping windows, the form a stream can keep."""
    return _bounds(
        ticks.groupBy(F.window("timestamp", length, slide), "symbol")
        .agg(F.round(F.sum("price") / F.count("price"), 4).alias("avg_price")))


def enriched_stream(ticks: DataFrame) -> DataFrame:
    """`enrich_processed` for a watermarked stream: a tick leaves, with the aggregates of its 5-minute and hour windows,
    when the watermark has passed its hour.

    Ticks wait in the state of a stream-stream join on (symbol, hour). Ticks without a symbol or time
    have no windows and don't come out.
    """
    of_five = ticks.groupBy(F.window("timestamp", "5 minutes").alias("w5"), "symbol").agg(
        F.sum("price").alias("s5"), F.count("price").alias("n5"), F.sum("volume").alias("v5"))
    # the hours are rolled up from their 12 windows, which come along as a map
    of_hour = of_five.groupBy(F.window(F.window_time("w5"), "1 hour").alias("w1"), F.col("symbol").alias("_of")).agg(
        F.map_from_entries(F.collect_list(F.struct("w5.start", F.round(F.col("s5") / F.col("n5"), 4)))).alias("_fives"),
        F.round(F.sum("s5") / F.sum("n5"), 4).alias("avg_price_1h"), F.sum("v5").alias("_v1h"), F.sum("n5").alias("_n1h"))
    # the joined stream may have one watermarked column, the window: ticks carry their time as a plain value
    placed = ticks.withColumn("_w1", F.window("timestamp", "1 hour")).withColumn(
        "_w5", F.window("timestamp", "5 minutes").start + F.expr("INTERVAL 0 SECONDS")).withColumn(
        "timestamp", F.timestamp_micros(F.unix_micros("timestamp")))
    joined = placed.join(of_hour, F.expr("symbol = _of AND _w1 = w1"))
    ratio = F.try_divide(F.col("volume").cast("double") * F.col("_n1h"), F.col("_v1h").cast("double"))
    return joined.select(*ticks.columns, F.element_at("_fives", F.col("_w5")).alias("avg_price_5min"), "avg_price_1h",
                         ratio.alias("volume_ratio"))


def enrich_processed(ticks: DataFrame, order=("timestamp", "id")) -> DataFrame:
    """Ticks with the averages of their 5-minute and 1-hour windows and the
    ratio of their volume to the hour's mean.

    The hours are rolled up from the 5-minute sums, and both come back on one
    join, so the ticks are shuffled once.
    """
    five = F.window("timestamp", "5 minutes")
    five_min = ticks.groupBy("symbol", five.alias("w5")).agg(
        F.sum("price").alias("s5"), F.count("price").alias("n5"), F.sum("volume").alias("v5"))
    five_min = five_min.select("symbol", F.col("w5.start").alias("_w5"), "s5", "n5", "v5")
    hour = Window.partitionBy("symbol", F.date_trunc("hour", "_w5"))  # at most 12 rows each
    both = five_min.select(
        "symbol", "_w5",
        F.round(F.col("s5") / F.col("n5"), 4).alias("avg_price_5min"),
        F.round(F.sum("s5").over(hour) / F.sum("n5").over(hour), 4).alias("avg_price_1h"),
        F.sum("v5").over(hour).alias("_v1h"), F.sum("n5").over(hour).alias("_n1h"))
    joined = ticks.withColumn("_w5", five.start).join(both, ["symbol", "_w5"], "left")
    ratio = F.try_divide(F.col("volume").cast("double") * F.col("_n1h"), F.col("_v1h").cast("double"))
    return joined.withColumn("volume_ratio", ratio).drop("_w5", "_v1h", "_n1h")
