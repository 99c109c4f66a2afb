"""Routing alerts to users.

The joins are equi joins on the symbol. Where one symbol holds a large share
of both sides, adaptive execution splits its partition; nothing is broadcast
by hint, since users, watchlists and alerts all grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.session import scratch_path

_MEASURES = {"price": "decimal(19,4)", "volume": "bigint", "sentiment_score": "double"}


def _with_measures(events):
    for name, kind in _MEASURES.items():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    return events


def _subscriptions(alerts, users):
    """Enabled alerts with their user's address."""
    return (
        alerts.where("enabled")
        .select(F.col("id").alias("alert_id"), "user_id", "symbol", "alert_type", "threshold_value")
        .join(users.select(F.col("id").alias("user_id"), "email"), "user_id")
    )


LEAF, BLOCK = 256, 1024  # alerts of a leaf of the threshold index, leaves of a block


def _fires(value, strength, threshold):
    """Whether an alert fires: its threshold, with the sign of its kind, is not above the value. Scores are doubles."""
    return F.coalesce(value >= threshold, strength >= threshold.cast("double"))


def _signed(kind, column):
    return F.when(kind == "PRICE_BELOW", -column).otherwise(column)


def threshold_index(alerts: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Enabled alerts with their users' addresses, sorted by threshold per symbol and kind: (roots, blocks, leaves).

    A leaf holds up to `LEAF` alerts, a block the lowest thresholds of `BLOCK` leaves, a root those of all its
    blocks. What fires at a value is all of the first leaves and part of one. Alerts are sorted by range, so a symbol with
    a large share of them is spread; only the numbers of its leaves are given in one task, one row for 256
    alerts. The leaves are written once, since three joins read them; alerts changed later need a new index.
    """
    spark, key = alerts.sparkSession, ["symbol", "alert_type"]
    subscribed = _subscriptions(alerts, users).where("symbol IS NOT NULL AND threshold_value IS NOT NULL").withColumn(
        "low", _signed(F.col("alert_type"), F.col("threshold_value")))
    order = ["low", "alert_id", "user_id", "email"]
    near = subscribed.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id())
    numbered = near.withColumn("_run", F.floor((F.row_number().over(
        Window.partitionBy(*key, "_part").orderBy(*order)) - 1) / LEAF))
    leaves = numbered.groupBy(*key, "_part", "_run").agg(
        F.min("low").alias("low"),
        F.collect_list(F.struct("alert_id", "user_id", "email", "threshold_value", "low")).alias("alerts"))
    leaves = leaves.withColumn("leaf", F.row_number().over(Window.partitionBy(*key).orderBy("_part", "_run")) - 1)
    path = scratch_path(spark, "threshold-index")
    leaves.drop("_part", "_run").write.parquet(path)
    leaves = spark.read.schema(leaves.drop("_part", "_run").schema).parquet(path)

    def lows(df, at):
        return df.groupBy(*key, F.floor(F.col(at) / BLOCK).cast("int").alias("up")).agg(
            F.min("low").alias("low"), F.sort_array(F.collect_list("low")).alias("lows"))

    blocks = lows(leaves, "leaf")
    roots = blocks.groupBy(*key).agg(F.sort_array(F.collect_list("low")).alias("lows"))
    return roots, blocks.drop("low").withColumnRenamed("up", "block"), leaves.drop("low")


def alert_candidates(facts: DataFrame, index) -> DataFrame:
    """Pairs of facts (symbol, alert_type, value, strength, ...) and alerts that may fire: all that do, and fewer than
    a leaf of others per fact."""
    roots, blocks, leaves = index
    key = ["symbol", "alert_type"]

    def reached(lows):
        return F.size(F.filter(lows, lambda low: _fires(F.col("value"), F.col("strength"), low)))

    at_block = facts.join(roots, key).withColumn("block", reached("lows") - 1).where("block >= 0").drop("lows")
    at_leaf = at_block.join(blocks, [*key, "block"]).withColumn("_last", F.col("block") * BLOCK + reached("lows") - 1)
    met = at_leaf.drop("lows", "block").withColumn("leaf", F.explode(F.sequence(F.lit(0), "_last")))
    return met.drop("_last").join(leaves, [*key, "leaf"]).drop("leaf").withColumn("alert", F.explode("alerts")).drop("alerts")


def _fired(facts, index):
    hit = _fires(F.col("value"), F.col("strength"), F.col("alert.low"))
    return alert_candidates(facts, index).where(hit)


def _facts(kind_values: dict):
    """One struct per kind of alert that there is a value for: prices and volumes as they are, scores as doubles."""
    exact = "decimal(28,4)"  # holds prices and volumes as they are
    parts = [F.when(v.isNotNull(), F.struct(
        F.lit(kind).alias("alert_type"),
        (F.lit(None) if kind == "NEWS_SENTIMENT" else _signed(F.lit(kind), v)).cast(exact).alias("value"),
        (v if kind == "NEWS_SENTIMENT" else F.lit(None)).cast("double").alias("strength")))
        for kind, v in kind_values.items()]
    return F.explode(F.array_compact(F.array(*parts)))


def route_alerts(events: DataFrame, alerts: DataFrame, users: DataFrame, carry=()) -> DataFrame:
    """One row per event and enabled alert it meets.

    PRICE_ABOVE and PRICE_BELOW include the threshold, VOLUME_SPIKE is an
    absolute volume, NEWS_SENTIMENT the strength of a score. ``events`` may be
    a stream. An event meets only alerts of kinds it has a value for, and through `threshold_index` only those that
    fire, so the work follows the result. Columns of the event named in ``carry`` come along behind the others. See
    `route_alerts_per` for busy symbols.
    """
    e = _with_measures(events)
    kinds = _facts({"PRICE_ABOVE": F.col("price"), "PRICE_BELOW": F.col("price"), "VOLUME_SPIKE": F.col("volume"),
                    "NEWS_SENTIMENT": F.abs(F.col("sentiment_score"))})
    facts = e.select(F.col("id").alias("event_id"), "symbol", *_MEASURES, "timestamp", *carry, kinds.alias("_fact")).select(
        "event_id", "symbol", *_MEASURES, "timestamp", *carry, "_fact.*")
    return _fired(facts, threshold_index(alerts, users)).select(
        "alert.user_id", "alert.email", "alert.alert_id", "symbol", "alert_type", "alert.threshold_value", "event_id",
        *_MEASURES, "timestamp", *carry)


def route_alerts_per(events: DataFrame, alerts: DataFrame, users: DataFrame, per="1 day") -> DataFrame:
    """At most one row per alert and window: does anything in it fire the alert?

    Whether a threshold is met in a window depends on the window's extremes
    alone, so events are reduced to one row per symbol, window and kind of
    alert before they meet the alerts. ``value`` is that extreme; it is compared as it is,
    as in `route_alerts`, never rounded.
    """
    e = _with_measures(events)
    extremes = e.groupBy("symbol", F.window("timestamp", per)).agg(
        F.max("price").alias("hi"), F.min("price").alias("lo"), F.max("volume").alias("vol"),
        F.max(F.abs("sentiment_score")).alias("score"))
    exact = "decimal(28,4)"  # holds prices and volumes as they are
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("alert_type"), (F.lit(None) if c == "score" else F.col(c)).cast(exact).alias("value"),
                 (F.col(c) if c == "score" else F.lit(None)).cast("double").alias("strength"))
        for kind, c in [("PRICE_ABOVE", "hi"), ("PRICE_BELOW", "lo"), ("VOLUME_SPIKE", "vol"),
                        ("NEWS_SENTIMENT", "score")]])
    facts = (
        extremes.select("symbol", F.col("window.start").alias("window_start"), F.explode(kinds).alias("k"))
        .select("symbol", "window_start", "k.*").where("value IS NOT NULL OR strength IS NOT NULL")
    )
    value, limit = F.col("value"), F.col("threshold_value")
    met = F.when(F.col("alert_type") == "PRICE_BELOW", value <= limit).when(
        F.col("alert_type") == "NEWS_SENTIMENT", F.col("strength") >= limit).otherwise(value >= limit)
    return (
        facts.join(_subscriptions(alerts, users), ["symbol", "alert_type"])
        .where(met)
        .select("user_id", "email", "alert_id", "symbol", "alert_type", "threshold_value", "window_start",
                F.coalesce(F.col("strength"), value.cast("double")).alias("value"))
    )


def route_news_alerts(news_alerts: DataFrame, watchlist: DataFrame, alerts: DataFrame,
                      users: DataFrame) -> DataFrame:
    """One row per news alert and user who watches any affected symbol or has
    a NEWS_SENTIMENT alert on it that the score meets.

    (user, news) pairs are found and made unique on ids alone; texts and
    addresses are joined afterwards.
    """
    touched = news_alerts.select(
        F.col("id").alias("news_id"), F.explode("affected_symbols").alias("symbol"),
        F.abs("sentiment_score").alias("strength"))
    audience = watchlist.select("user_id", "symbol", F.lit(None).cast("double").alias("needs")).unionByName(
        alerts.where("enabled AND alert_type = 'NEWS_SENTIMENT'")
        .select("user_id", "symbol", F.col("threshold_value").cast("double").alias("needs")))
    pairs = (
        touched.join(audience, "symbol")
        .where("needs IS NULL OR strength >= needs")
        .select("user_id", "news_id").distinct()
    )
    return (
        pairs.join(news_alerts.withColumnRenamed("id", "news_id"), "news_id")
        .join(users.select(F.col("id").alias("user_id"), "email"), "user_id")
        .select("user_id", "email", "news_id", "headline", "summary", "url", "affected_symbols",
                "sentiment_score", "alert_type", "timestamp")
    )


def apply_preferences(notifications: DataFrame, preferences: DataFrame) -> DataFrame:
    """Drop notifications on a channel or of an alert type the user turned off.

    Users without preferences, and notifications without an alert type, keep
    everything.
    """
    p = preferences.select(
        "user_id", "email_enabled", "sms_enabled", "push_enabled", "alert_types")
    channel = (
        F.when(F.col("type") == "EMAIL", F.col("email_enabled"))
        .when(F.col("type") == "SMS", F.col("sms_enabled"))
        .when(F.col("type") == "PUSH", F.col("push_enabled"))
    )
    wanted = F.array_contains("alert_types", F.col("alert_type"))
    return (
        notifications.join(p, "user_id", "left")
        .where(F.coalesce(channel, F.lit(True)) & F.coalesce(wanted, F.lit(True)))
        .select(*notifications.columns)
    )
