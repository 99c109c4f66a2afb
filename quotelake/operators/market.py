"""Market-level analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions import lexicons as lex
from quotelake.functions.timefn import before, moment
from quotelake.operators.history import latest_tick, newest_rows, tick_returns, top_k

PERIODS = {"1D": "1 day", "1W": "7 days", "1M": "1 month", "3M": "3 months", "1Y": "1 year"}


def trending_with_ratio(ticks: DataFrame, as_of, n=10, span="24 hours", baseline="30 days") -> DataFrame:
    """Volume of the span against the mean daily volume of the baseline.

    One pass over the baseline: days and the span's share are summed together.
    """
    days = (
        ticks.where((F.col("timestamp") >= before(as_of, baseline)) & (F.col("timestamp") <= moment(as_of)))
        .groupBy("symbol", F.to_date("timestamp").alias("date"))
        .agg(
            F.sum("volume").alias("day_volume"),
            F.sum(F.when(F.col("timestamp") >= before(as_of, span), F.col("volume"))).alias("recent"))
    )
    totals = days.groupBy("symbol").agg(
        F.sum("recent").alias("total_volume"),
        (F.sum("day_volume").cast("double") / F.count("day_volume")).alias("average_volume"),
    ).where("total_volume IS NOT NULL")
    ranked = totals.withColumn(
        "volume_ratio", F.try_divide(F.col("total_volume").cast("double"), F.col("average_volume")))
    return top_k(ranked, [F.desc("total_volume"), "symbol"], n)


def period_statistics(ticks: DataFrame, as_of, period="1M", width="1 minute") -> DataFrame:
    """Averages, extremes, volume and volatility of the period before ``as_of``.

    Volatility is the sample deviation of simple tick-to-tick returns.
    """
    rows = ticks.where((F.col("timestamp") >= before(as_of, PERIODS[period])) & (F.col("timestamp") <= moment(as_of)))
    rows = rows.select("symbol", "timestamp", "id", "price", "volume")
    returns = tick_returns(rows, width=width).withColumn("_ret", F.col("change_percent") / 100)
    return returns.groupBy("symbol").agg(
        F.lit(period).alias("period"),
        (F.sum("price").cast("double") / F.count("price")).alias("avg_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.sum("volume").alias("total_volume"),
        (F.sum("volume").cast("double") / F.count("volume")).alias("avg_volume"),
        F.stddev_samp("_ret").alias("volatility"),
    )


def _movers_of(latest, kind, n):
    pct = F.col("change_percent")
    if kind == "gainers":
        return top_k(latest.where(pct > 0), [pct.desc(), "symbol"], n)
    if kind == "losers":
        return top_k(latest.where(pct < 0), [pct.asc(), "symbol"], n)
    if kind == "most_active":
        return top_k(latest, [F.desc("volume"), "symbol"], n)
    raise ValueError(f"unknown kind of movers: {kind!r}")


def market_movers(ticks: DataFrame, kind="gainers", n=10) -> DataFrame:
    """The first ``n`` symbols by their latest tick."""
    return _movers_of(latest_tick(ticks), kind, n)


def market_summary(ticks: DataFrame, n=5, indices=lex.INDEX_SYMBOLS) -> DataFrame:
    """Index rows, gainers, losers and most active, told apart by ``category``.

    The latest ticks are found once. Each is entered in the categories it
    qualifies for, and the lists are cut before and after one shuffle.
    """
    pct, is_index = F.col("change_percent").cast("double"), F.col("symbol").isin(list(indices))

    def entry(category, qualifies, metric):
        return F.when(qualifies, F.struct(F.lit(category).alias("category"), metric.cast("double").alias("metric")))

    stock = ~is_index
    entries = F.array_compact(F.array(
        entry("indices", is_index, F.lit(0)),
        entry("top_gainers", stock & (pct > 0), pct),
        entry("top_losers", stock & (pct < 0), -pct),
        entry("most_active", stock, F.col("volume")),
    ))
    place = Window.partitionBy("category").orderBy(F.desc("metric"), "symbol")
    return (
        latest_tick(ticks).select("symbol", "price", "change", "change_percent", "volume", F.explode(entries).alias("e"))
        .withColumns({"category": F.col("e.category"), "metric": F.col("e.metric")})
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= max(n, len(indices)))
        .where((F.col("place") <= n) | (F.col("category") == "indices"))
        .select("category", "symbol", "price", "change", "change_percent", "volume")
    )


def latest_indicator(observations: DataFrame) -> DataFrame:
    """Newest observation per economic indicator."""
    return newest_rows(observations, ["indicator"], ["timestamp", *[c for c in ("id",) if c in observations.columns]])


def high_low_52w(ticks: DataFrame) -> DataFrame:
    """Per symbol and day the day's extremes and those of the 52 weeks to date.

    Ticks are reduced to days first; the frame of 364 days then runs over at
    most one row per calendar day.
    """
    days = (
        ticks.groupBy("symbol", F.to_date("timestamp").alias("date"))
        .agg(F.max("price").alias("day_high"), F.min("price").alias("day_low"))
    )
    year = Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-363, 0)
    return days.withColumns({
        "fifty_two_week_high": F.max("day_high").over(year),
        "fifty_two_week_low": F.min("day_low").over(year),
    })


def signal_summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("symbol", "signal_type").agg(
        F.count(F.lit(1)).alias("signals"), F.avg(F.col("confidence").cast("double")).alias("avg_confidence"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table, with a status row in front."""
    first = next(iter(tables.values()))
    out = first.sparkSession.sql(
        "SELECT 'status' AS name, 'Sample Data Loaded Successfully!' AS status, CAST(NULL AS BIGINT) AS row_count")
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("name"), F.lit(None).cast("string").alias("status"), "row_count"))
    return out


def news_filter(news: DataFrame, symbols=None, category=None, limit=20) -> DataFrame:
    """The newest ``limit`` articles about any of the symbols."""
    rows = news
    if symbols:
        rows = rows.where(F.arrays_overlap("symbols", F.array(*[F.lit(s) for s in symbols])))
    if category:
        rows = rows.where(F.col("category") == category)
    return top_k(rows, [F.desc("timestamp"), F.desc("id")], limit)
