"""Per-row detectors. All are stateless and run on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.functions import lexicons as lex
from quotelake.functions import text as tx

STOCK_ALERT_COLUMNS = [
    "symbol", "alert_type", "current_price", "previous_price", "change_percent", "volume", "timestamp",
]
NEWS_ALERT_COLUMNS = [
    "headline", "summary", "url", "affected_symbols", "sentiment_score", "alert_type", "timestamp",
]


def price_change_alerts(ticks: DataFrame, threshold=lex.PRICE_MOVE_PERCENT) -> DataFrame:
    """Moves of at least ``threshold`` percent, either way."""
    pct = F.col("change_percent")
    no_change = F.coalesce(F.col("change"), F.lit(0).cast(ticks.schema["change"].dataType))
    return ticks.where(F.abs(pct) >= threshold).select(
        "symbol",
        F.when(pct > 0, "SIGNIFICANT_INCREASE").otherwise("SIGNIFICANT_DECREASE").alias("alert_type"),
        F.col("price").alias("current_price"),
        (F.col("price") - no_change).alias("previous_price"),
        "change_percent", "volume", "timestamp",
    )


def score_sentiment(news: DataFrame, positive=lex.POSITIVE_WORDS, negative=lex.NEGATIVE_WORDS,
                    match="substring") -> DataFrame:
    """Fill a missing ``sentiment_score`` from the two word lists."""
    return (
        news.withColumn("_lower", F.lower(tx.article_text(F.col("title"), F.col("content"))))
        .withColumn("_pos", tx.count_terms(F.col("_lower"), positive, match))
        .withColumn("_neg", tx.count_terms(F.col("_lower"), negative, match))
        .withColumn("sentiment_score", tx.computed_once(F.coalesce(
            F.col("sentiment_score").cast("double"), tx.polarity(F.col("_pos"), F.col("_neg")))))
        .drop("_lower", "_pos", "_neg")
    )


def extract_symbols(news: DataFrame, known=lex.KNOWN_SYMBOLS, match="substring") -> DataFrame:
    """Fill missing or empty ``symbols`` with the known tickers the text holds."""
    given = F.col("symbols")
    return (
        news.withColumn("_upper", F.upper(tx.article_text(F.col("title"), F.col("content"))))
        .withColumn("_found", tx.found_terms(F.col("_upper"), known, match))
        .withColumn("symbols", tx.computed_once(
            F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(F.col("_found"))))
        .drop("_upper", "_found")
    )


def trading_signals(news: DataFrame, threshold=lex.SIGNAL_SCORE, all_symbols=False) -> DataFrame:
    """BUY or SELL for strong sentiment, for the first symbol or for all."""
    score = F.col("sentiment_score").cast("double")
    strong = news.where((F.size("symbols") > 0) & (F.abs(score) > threshold))
    symbol = F.explode("symbols") if all_symbols else F.element_at("symbols", 1)
    return strong.select(
        symbol.alias("symbol"),
        F.when(score > threshold, "BUY").otherwise("SELL").alias("signal_type"),
        F.abs(score).alias("confidence"),
        F.concat(F.lit("News sentiment: "), score.cast("string"), F.lit(" - "), F.col("title")).alias("reason"),
        F.lit("news-analysis").alias("source"),
        "timestamp",
    )


def news_alerts(news: DataFrame, keywords=lex.MARKET_KEYWORDS, threshold=lex.ALERT_SCORE,
                match="substring") -> DataFrame:
    """Market-relevant articles about at least one symbol."""
    score = F.col("sentiment_score").cast("double")
    return (
        news.where(F.size("symbols") > 0)
        .withColumn("_lower", tx.computed_once(F.lower(tx.article_text(F.col("title"), F.col("content")))))
        .where(tx.any_term(F.col("_lower"), keywords, match))
        .select(
            *[c for c in ("id",) if c in news.columns],
            F.col("title").alias("headline"),
            tx.shorten(F.col("content"), lex.SUMMARY_CHARS).alias("summary"),
            "url",
            F.col("symbols").alias("affected_symbols"),
            score.alias("sentiment_score"),
            F.when(score > threshold, "POSITIVE_NEWS").when(score < -threshold, "NEGATIVE_NEWS")
            .otherwise("MARKET_NEWS").alias("alert_type"),
            "timestamp",
        )
    )


def all_stock_alerts(*alerts: DataFrame) -> DataFrame:
    """Price and volume alerts as one set, duplicates kept."""
    out = alerts[0].select(*STOCK_ALERT_COLUMNS)
    for a in alerts[1:]:
        out = out.unionByName(a.select(*STOCK_ALERT_COLUMNS))
    return out


def all_news_alerts(*alerts: DataFrame) -> DataFrame:
    """News and pattern alerts as one set, duplicates kept."""
    out = alerts[0].select(*NEWS_ALERT_COLUMNS)
    for a in alerts[1:]:
        out = out.unionByName(a.select(*NEWS_ALERT_COLUMNS))
    return out.where(F.col("headline").isNotNull())
