"""Users, roles, watchlists and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.functions.timefn import moment
from quotelake.operators.history import latest_tick
from quotelake.operators.windows import ohlc_daily


def user_profiles(users: DataFrame, roles: DataFrame, watchlist: DataFrame) -> DataFrame:
    """A row per user and watched symbol with the user's set of roles; a null symbol for an empty watchlist."""
    role_sets = roles.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))  # an enum of three
    watched = watchlist.select("user_id", "symbol").where("symbol IS NOT NULL").distinct()
    return (
        users.withColumnRenamed("id", "user_id")
        .join(role_sets, "user_id", "left")
        .join(watched, "user_id", "left")
        .withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    )


def unlocked_users(users: DataFrame, as_of, verified=False, role=None, roles: DataFrame = None) -> DataFrame:
    """Users not locked at ``as_of``, with their full name; optionally only
    those with a verified address or a role."""
    out = users.where(F.col("locked_until").isNull() | (F.col("locked_until") < moment(as_of)))
    if verified:
        out = out.where(F.coalesce("email_verified", F.lit(False)))
    if role is not None:
        holders = roles.where(F.col("role") == role).select(F.col("user_id").alias("id")).distinct()
        out = out.join(holders, "id", "left_semi")
    return out.withColumn("full_name", F.concat_ws(" ", "first_name", "last_name"))


def watchlist_quotes(watchlist: DataFrame, ticks: DataFrame) -> DataFrame:
    """Watched symbols with their latest quote; symbols never quoted stay."""
    quotes = latest_tick(ticks).select("symbol", F.col("price").alias("latest_price"), "change", "change_percent")
    return watchlist.join(quotes, "symbol", "left").select(
        "user_id", "symbol", "added_at", "latest_price", "change", "change_percent")


def daily_digest(users: DataFrame, watchlist: DataFrame, ticks: DataFrame, day) -> DataFrame:
    """One line per user and watched symbol with the day's bar.

    The lines of a digest are rows, so a very long watchlist needs no array.
    """
    date = F.to_date(moment(day))
    bars = ohlc_daily(ticks.where(F.to_date("timestamp") == date))
    lines = watchlist.select("user_id", "symbol").join(bars.drop("date"), "symbol")
    return (
        lines.join(users.select(F.col("id").alias("user_id"), "email", "first_name"), "user_id")
        .select(
            "user_id", "email", "first_name",
            F.concat(F.lit("Daily Market Digest - "), date.cast("string")).alias("subject"),
            "symbol", "open", "high", "low", "close", "volume",
            (F.try_divide((F.col("close") - F.col("open")).cast("double"), F.col("open").cast("double")) * 100)
            .alias("change_percent"))
    )


def news_with_symbols(news: DataFrame, news_symbols: DataFrame) -> DataFrame:
    """A row per article and symbol; a null symbol for an article without any."""
    named = news_symbols.select(F.col("news_id").alias("id"), "symbol").where("symbol IS NOT NULL").distinct()
    return news.drop("symbols").join(named, "id", "left")


def since_removal(changes: DataFrame, keys, removal: str, order) -> tuple[DataFrame, DataFrame]:
    """(changes after their key's last removal, keys that were removed). ``op`` tells removals apart."""
    at = F.struct(*order)
    gone = changes.where(F.col("op") == removal).groupBy(*keys).agg(F.max(at).alias("_gone"))
    later = changes.where(F.col("op") != removal).join(gone, keys, "left").where(
        F.col("_gone").isNull() | (at > F.col("_gone"))).drop("_gone")
    return later, gone.select(*keys)


def update_watchlist(watchlist: DataFrame, changes: DataFrame, order=("added_at", "seq")) -> DataFrame:
    """Add (``op`` A) and remove (R) symbols in order; case doesn't matter and repeating changes nothing.

    A symbol already watched keeps its ``added_at``; one added again after its removal takes the new time.
    """
    keys = ["user_id", "symbol"]
    later, gone = since_removal(changes.withColumn("symbol", F.upper("symbol")), keys, "R", order)
    kept = watchlist.select("user_id", F.upper("symbol").alias("symbol"), "added_at").join(gone, keys, "left_anti")
    return kept.unionByName(later.select(*keys, "added_at")).groupBy(*keys).agg(F.min("added_at").alias("added_at"))


def update_roles(roles: DataFrame, changes: DataFrame = None, new_users: DataFrame = None,
                 order=("changed_at", "seq")) -> DataFrame:
    """Add (``op`` A) and remove (R) roles in order; new users start with USER."""
    out = roles.select("user_id", "role")
    if new_users is not None:
        out = out.unionByName(new_users.select(F.col("id").alias("user_id"), F.lit("USER").alias("role")))
    if changes is not None:
        later, gone = since_removal(changes, ["user_id", "role"], "R", order)
        out = out.join(gone, ["user_id", "role"], "left_anti").unionByName(later.select("user_id", "role"))
    return out.distinct()


def apply_changes(table: DataFrame, changes: DataFrame, fields, order=("changed_at", "seq")) -> DataFrame:
    """Fold a change table into rows keyed by ``id``.

    ``op`` is C, U or D. Of every field the newest non-null value wins, fields
    no change mentions stay, and an id whose newest change is D goes. What
    was before an id's last D doesn't count: a row created again starts anew.
    ``updated_at`` moves to the newest change, ``created_at`` of a new row is its first.
    """
    at = F.struct(*order)
    later, gone = since_removal(changes, ["id"], "D", order)
    newest = later.groupBy("id").agg(
        F.max(order[0]).alias("_at"), F.min(order[0]).alias("_born"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f"_{f}") for f in fields])
    merged = table.join(gone, "id", "left_anti").join(newest, "id", "full_outer")
    out = []
    for c in table.columns:
        if c == "updated_at":
            out.append(F.coalesce("_at", c).alias(c))
        elif c == "created_at":
            out.append(F.coalesce(c, "_born").alias(c))
        elif c in fields:
            out.append(F.coalesce(f"_{c}", c).alias(c))
        else:
            out.append(F.col(c))
    return merged.select(*out)


def update_alerts(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Create, change and delete user alerts from a change table."""
    return apply_changes(alerts, changes, ["user_id", "symbol", "alert_type", "threshold_value", "enabled"])


def update_profiles(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Change first name, last name and phone number of existing users.

    ``changes`` has id, those three fields (null means keep), changed_at, seq.
    """
    known = changes.join(users.select("id"), "id", "left_semi").withColumn("op", F.lit("U"))
    return apply_changes(users, known, ["first_name", "last_name", "phone_number"])
