"""The driver's tables seen as market data.

Each view is a projection of whole tables: nothing is filtered out, and no
text is cut. The catalogue states the same mappings in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.operators.history import tick_returns

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
ALERT_KINDS = ["PRICE_ABOVE", "PRICE_BELOW", "VOLUME_SPIKE", "NEWS_SENTIMENT"]
NEWS_START = "2024-01-01 00:00:00"
CHANNELS = ["EMAIL", "SMS", "PUSH", "IN_APP"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index) -> Column:
    """The value a number selects, in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def ticks_of(events, symbol):
    return events.select(
        F.col("event_id").alias("id"), symbol.alias("symbol"), F.col("value").cast("decimal(19,4)").alias("price"),
        F.round(F.col("value") * 100).cast("bigint").alias("volume"), F.col("ts").alias("timestamp"),
        F.lit("events").alias("source"))


def ticks(spark, sf_dir) -> DataFrame:
    """Five busy symbols: the event types."""
    return ticks_of(table(spark, sf_dir, "events"), F.col("event_type"))


def user_ticks(spark, sf_dir) -> DataFrame:
    """Many symbols: the users of the events."""
    return ticks_of(table(spark, sf_dir, "events"), F.concat(F.lit("U"), F.col("user_id").cast("string")))


def quoted(ticks_df: DataFrame) -> DataFrame:
    """With change and change_percent from the previous tick."""
    return tick_returns(ticks_df)


def bars(spark, sf_dir) -> DataFrame:
    """Sales as ticks of their suppliers. Days are the finest time there is,
    so ``order_key`` gives rows of a day their order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        (F.col("l_extendedprice").cast("decimal(19,4)")).alias("price"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        F.col("l_shipdate").alias("timestamp"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("order_key"))


def news(spark, sf_dir) -> DataFrame:
    """Documents as articles without score and symbols."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("content"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        (F.lit(NEWS_START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int")))
        .alias("timestamp"),
        "source", F.lit(None).cast("double").alias("sentiment_score"),
        F.lit(None).cast("array<string>").alias("symbols"), F.col("lang").alias("category"))


def users(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.concat(F.lit("user"), k.cast("string")).alias("username"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"),
        F.lit(None).cast("string").alias("phone_number"),
        F.when(F.col("c_acctbal") < 0, "SUSPENDED").otherwise("ACTIVE").alias("status"),
        (F.col("c_acctbal") > 1000).alias("email_verified"),
        F.when(F.col("c_acctbal") < 0, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("locked_until"),
        F.lit(NEWS_START).cast("timestamp_ntz").alias("created_at"),
        F.lit(NEWS_START).cast("timestamp_ntz").alias("updated_at"))


def roles(spark, sf_dir) -> DataFrame:
    """USER for everybody, PREMIUM_USER for two segments, ADMIN for one."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.explode(F.array_compact(F.array(
            F.lit("USER"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "PREMIUM_USER"),
            F.when(F.col("c_mktsegment") == "FURNITURE", "ADMIN")))).alias("role"))
    return c


def watchlist(spark, sf_dir) -> DataFrame:
    """Two event types per customer."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("user_id"), F.explode(F.array(pick(EVENT_TYPES, k), pick(EVENT_TYPES, k + 2))).alias("symbol"),
        F.lit(NEWS_START).cast("timestamp_ntz").alias("added_at"))


def _alerts(spark, sf_dir, symbol):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("id"), k.alias("user_id"), symbol.alias("symbol"), pick(ALERT_KINDS, k).alias("alert_type"),
        F.when(pick(ALERT_KINDS, k) == "NEWS_SENTIMENT", F.lit(0.5).cast("decimal(19,4)"))
        .otherwise((F.abs("c_acctbal") / 10).cast("decimal(19,4)")).alias("threshold_value"),
        (F.col("c_acctbal") >= 0).alias("enabled"),
        F.lit(NEWS_START).cast("timestamp_ntz").alias("created_at"),
        F.lit(NEWS_START).cast("timestamp_ntz").alias("updated_at"))


def alerts(spark, sf_dir) -> DataFrame:
    return _alerts(spark, sf_dir, pick(EVENT_TYPES, F.col("c_custkey")))


def user_alerts(spark, sf_dir) -> DataFrame:
    """Alerts on the many symbols of `user_ticks`, ten customers to a symbol."""
    return _alerts(spark, sf_dir, F.concat(F.lit("U"), F.floor(F.col("c_custkey") / 10).cast("string")))


def notifications(spark, sf_dir) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "SENT").when(F.col("o_orderstatus") == "P", "FAILED")
        .when(k % 2 == 1, "SCHEDULED").otherwise("PENDING"))
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), pick(CHANNELS, k).alias("type"), status.alias("status"),
        F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("content"),
        F.concat(F.lit("to"), F.col("o_custkey").cast("string")).alias("recipient"),
        pick(ALERT_KINDS, k + 1).alias("alert_type"),
        F.lit(None).cast("string").alias("error_message"),
        (k % 5).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("scheduled_at"),
        F.lit(None).cast("timestamp_ntz").alias("sent_at"), F.col("o_orderdate").alias("created_at"))


def observations(spark, sf_dir) -> DataFrame:
    """Orders as observations of economic indicators, one per priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("indicator"),
        F.col("o_totalprice").cast("decimal(19,4)").alias("value"), F.col("o_orderdate").alias("timestamp"))
