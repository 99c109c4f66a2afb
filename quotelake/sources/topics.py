"""Topics as streams: a message broker, or folders of text files.

The folder form has one subfolder ``topic=<name>`` per topic with one message
per line. It gives the same columns, value and topic, and needs no connector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Topic names
STOCK, NEWS, ECONOMIC = "stock-data", "news-data", "economic-data"
STOCK_ALERTS, PRICE_ALERTS, NEWS_ALERTS = "stock-alerts", "price-alerts", "news-alerts"
VOLUME_ALERTS, SIGNALS = "volume-alerts", "trading-signals"
DATA_TOPICS = [STOCK, NEWS, ECONOMIC]
ALERT_TOPICS = [STOCK_ALERTS, PRICE_ALERTS, NEWS_ALERTS]


def kafka_read_options(topics, servers: str, group=None, starting="latest", max_offsets=None) -> dict[str, str]:
    if starting not in ("latest", "earliest"):
        raise ValueError("starting must be 'latest' or 'earliest'")
    opts = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        # a gap in the offsets is a loss of messages: fail rather than go on
        "failOnDataLoss": "true",
    }
    if group:
        opts["groupIdPrefix"] = group
    if max_offsets:
        opts["maxOffsetsPerTrigger"] = str(max_offsets)
    return opts


def kafka_write_options(servers: str) -> dict[str, str]:
    """Producer settings: all replicas acknowledge, no duplicates, compressed."""
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        "kafka.compression.type": "snappy",
    }


def read_topics(spark: SparkSession, topics, servers=None, folder=None, group=None, starting="latest",
                max_per_trigger=None, arrival=False) -> DataFrame:
    """Stream of (value STRING, topic STRING) from the listed topics.

    ``arrival`` adds the broker's offset, the order messages of one key came
    in; lines of files have none.
    """
    topics = list(topics)
    if folder is not None:
        reader = spark.readStream.schema("value STRING, topic STRING").format("text")
        if max_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_per_trigger)
        return reader.load(folder).where(F.col("topic").isin(topics)).select("value", "topic")
    options = kafka_read_options(topics, servers, group, starting, max_per_trigger)
    return (
        spark.readStream.format("kafka").options(**options).load()
        .select(F.col("value").cast("string").alias("value"), "topic",
                *([F.col("offset").alias("arrival")] if arrival else []))
    )


def read_topic(spark: SparkSession, topic: str, **kwargs) -> DataFrame:
    """Stream of (value STRING) from one topic."""
    return read_topics(spark, [topic], **kwargs).drop("topic")


def only_topic(messages: DataFrame, topic: str) -> DataFrame:
    return messages.where(F.col("topic") == topic).select("value")
