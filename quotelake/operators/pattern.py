"""The two-event breaking-news pattern on batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import lexicons as lex
from quotelake.operators.ordered import next_within

PATTERN_HEADLINE = "Breaking News Pattern Detected: "
PATTERN_SUMMARY = "Multiple significant news events detected in short timeframe"
NO_SYMBOL = "UNKNOWN"


def pattern_key() -> Column:
    """First symbol of an article, or a common key for articles without one."""
    symbols = F.col("symbols")
    return F.when(F.size(symbols) > 0, F.get(symbols, F.lit(0))).otherwise(F.lit(NO_SYMBOL))


def pattern_alert(prefix="") -> list[Column]:
    """The alert columns, from the columns of the starting article."""
    def c(name):
        return F.col(prefix + name)
    return [
        F.concat(F.lit(PATTERN_HEADLINE), c("title")).alias("headline"),
        F.lit(PATTERN_SUMMARY).alias("summary"),
        c("url").alias("url"),
        c("symbols").alias("affected_symbols"),
        c("sentiment_score").cast("double").alias("sentiment_score"),
        F.lit("BREAKING_NEWS_PATTERN").alias("alert_type"),
        c("timestamp").alias("timestamp"),
    ]


def breaking_news_pattern(news: DataFrame, start=lex.BREAKING_START_SCORE, follow=lex.BREAKING_FOLLOW_SCORE,
                          within_seconds=lex.BREAKING_WITHIN_SECONDS, order=("timestamp", "id")) -> DataFrame:
    """A strong article followed by another significant one of the same first
    symbol in less than 30 minutes, whatever comes between.

    Every start is also a valid follow-up, so only the next significant
    article matters and no pairs have to be formed.
    """
    strength = F.abs(F.col("sentiment_score"))
    significant = news.where(strength > follow).withColumn("_key", pattern_key())
    followed = next_within(significant, ["_key"], list(order), within_seconds, ["timestamp"])
    return followed.where((strength > start) & F.col("following").isNotNull()).select(*pattern_alert())
