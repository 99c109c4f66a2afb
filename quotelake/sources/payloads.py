"""Landed provider payloads to records. Fetching them is not done here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.functions.text import computed_once

# Provider field names
_QUOTE = "`Global Quote` MAP<STRING, STRING>"
_ARTICLES = (
    "articles ARRAY<STRUCT<title: STRING, content: STRING, url: STRING, publishedAt: STRING, "
    "source: STRUCT<name: STRING>>>"
)
_OBSERVATIONS = "units STRING, observations ARRAY<STRUCT<date: STRING, value: STRING>>"


def normalize_quote(landed: DataFrame) -> DataFrame:
    """(symbol, payload, fetched_at) to quotes; missing numbers are 0.

    An empty quote, or one with a number that cannot be read, gives no row.
    """
    quote = F.col("_q")["Global Quote"]

    def number(field):
        return F.coalesce(quote[field], F.lit("0"))

    percent = F.rtrim(number("10. change percent"), F.lit("%"))
    rows = (
        landed.withColumn("_q", computed_once(F.from_json("payload", _QUOTE)))
        .where(F.size(quote) > 0)
        .select(
            "symbol",
            number("05. price").try_cast("double").alias("price"),
            number("06. volume").try_cast("double").try_cast("bigint").alias("volume"),
            F.col("fetched_at").alias("timestamp"),
            number("09. change").try_cast("double").alias("change"),
            percent.try_cast("double").alias("change_percent"),
            F.lit("alpha_vantage").alias("source"),
        )
    )
    return rows.dropna(subset=["price", "volume", "change", "change_percent"])


def normalize_articles(landed: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(payload) to articles with a title and whole content; `max_chars` cuts longer ones.

    An article whose time cannot be read is left out; the others stay.
    """
    a = F.col("_a")
    return (
        landed.select(F.explode(F.from_json("payload", _ARTICLES)["articles"]).alias("_a"))
        .where((F.length(a["title"]) > 0) & (F.length(a["content"]) > 0))
        .select(
            a["title"].alias("title"),
            (a["content"] if max_chars is None else F.substring(a["content"], 1, max_chars)).alias("content"),
            F.coalesce(a["url"], F.lit("")).alias("url"),
            F.try_to_timestamp(a["publishedAt"]).cast("timestamp_ntz").alias("timestamp"),
            F.coalesce(a["source"]["name"], F.lit("unknown")).alias("source"),
            F.lit(None).cast("double").alias("sentiment_score"),
            F.array().cast("array<string>").alias("symbols"),
            F.lit("general").alias("category"),
        )
        .where("timestamp IS NOT NULL")
    )


def normalize_observations(landed: DataFrame) -> DataFrame:
    """(indicator, payload) to the newest observation of each payload.

    A newest value of "." means not published yet and gives no row, even if an
    older observation has a value.
    """
    p, newest = F.col("_p"), F.col("_newest")
    return (
        landed.withColumn("_p", computed_once(F.from_json("payload", _OBSERVATIONS)))
        .withColumn("_newest", F.array_max(p["observations"]))
        .where(newest["value"] != ".")
        .select(
            "indicator",
            newest["value"].try_cast("double").alias("value"),
            F.try_to_timestamp(newest["date"]).cast("timestamp_ntz").alias("timestamp"),
            F.lit("US").alias("country"),
            F.lit("fred").alias("source"),
            F.coalesce(p["units"], F.lit("Unknown")).alias("unit"),
            F.lit("monthly").alias("period"),
        )
        .where("value IS NOT NULL AND timestamp IS NOT NULL")
    )
