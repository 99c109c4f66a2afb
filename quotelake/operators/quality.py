"""Data-quality rules, keys and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import lexicons as lex

# Fixed values
REQUIRED = {
    "stock": ["symbol", "price", "timestamp"],
    "news": ["title", "url", "timestamp"],
    "economic": ["indicator", "value", "timestamp"],
}
MIN_PRICE, MAX_PRICE, MIN_VOLUME, MAX_CONTENT = 0.01, 100000, 0, 10000


def _required(names):
    return {f"{n} is missing": F.col(n).isNotNull() for n in names}


def _max_length(name, n):
    return {f"{name} is longer than {n}": F.length(name) <= n}


def _one_of(name, values):
    return {f"{name} is not a known value": F.col(name).isin(values)}


def record_rules(kind: str) -> dict[str, Column]:
    """The configured rules of one record type. A null passes all but the
    required-field rules."""
    rules = _required(REQUIRED[kind])
    if kind == "stock":
        rules["price is out of range"] = F.col("price").between(MIN_PRICE, MAX_PRICE)
        rules["volume is negative"] = F.col("volume") >= MIN_VOLUME
    if kind == "news":
        rules["content is too long"] = F.length("content") <= MAX_CONTENT
    return rules


def table_rules(table: str) -> dict[str, Column]:
    """NOT NULL, length, enum and range constraints of a stored table."""
    rules = {}
    if table == "users":
        rules |= _required(["id", "username", "email", "password", "first_name", "last_name"])
        rules["username is not 3 to 50 long"] = F.length("username").between(3, 50)
        rules["email has no valid form"] = F.col("email").rlike(r"^[^@\s]+@[^@\s]+$")
        rules |= _max_length("email", 100)
        rules["password is not 6 to 120 long"] = F.length("password").between(6, 120)
        rules |= _max_length("first_name", 50) | _max_length("last_name", 50) | _max_length("phone_number", 20)
        rules |= _one_of("status", lex.USER_STATUSES)
    elif table == "user_roles":
        rules |= _required(["user_id", "role"]) | _one_of("role", lex.USER_ROLES)
    elif table == "user_watchlist":
        rules |= _required(["user_id", "symbol"]) | _max_length("symbol", 10)
    elif table == "stock_data":
        rules |= _required(["symbol", "price", "volume", "timestamp", "source"])
        rules |= _max_length("symbol", 10) | _max_length("source", 50)
        rules["volume is negative"] = F.col("volume") >= 0
    elif table == "news_data":
        rules |= _required(["title", "timestamp", "source"]) | _max_length("source", 100) | _max_length("category", 50)
    elif table == "economic_data":
        rules |= _required(["indicator", "value", "timestamp", "country", "source"])
        rules |= _max_length("indicator", 50) | _max_length("country", 10) | _max_length("source", 50)
        rules |= _max_length("unit", 20) | _max_length("period", 20)
    elif table == "notifications":
        rules |= _required(["type", "status", "subject", "content"])
        rules |= _one_of("type", lex.NOTIFICATION_TYPES) | _one_of("status", lex.NOTIFICATION_STATUSES)
        rules |= _max_length("subject", 255) | _max_length("recipient_email", 100) | _max_length("recipient_phone", 20)
        rules |= _max_length("recipient_device_token", 255) | _max_length("template_name", 100)
    elif table == "user_alerts":
        rules |= _required(["symbol", "alert_type"]) | _max_length("symbol", 10)
        rules |= _one_of("alert_type", lex.ALERT_TYPES)
    elif table == "trading_signals":
        rules |= _required(["symbol", "signal_type", "source"]) | _max_length("symbol", 10)
        rules |= _one_of("signal_type", lex.SIGNAL_TYPES) | _max_length("source", 50)
    else:
        raise ValueError(f"no rules for table {table!r}")
    return rules


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks, in order."""
    broken = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def validate_records(df: DataFrame, kind: str) -> DataFrame:
    return with_violations(df, record_rules(kind))


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    return with_violations(df, table_rules(table))


def split_by_violations(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the column, bad rows with it)."""
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)


UNIQUE_KEYS = {
    "users": [["email"], ["username"]],
    "user_roles": [["user_id", "role"]],
    "user_watchlist": [["user_id", "symbol"]],
    "news_symbols": [["news_id", "symbol"]],
    "stock_data_processed": [["symbol", "timestamp"]],
}


def check_unique_keys(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def drop_repeated_keys(stream: DataFrame, key) -> DataFrame:
    """Keep the first arrival of a key within the watermark of a stream."""
    return stream.dropDuplicatesWithinWatermark(list(key))


def check_foreign_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key="id") -> DataFrame:
    """Child rows whose parent does not exist."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def cascade_delete(child: DataFrame, surviving_parents: DataFrame, child_key: str, parent_key="id") -> DataFrame:
    """Child rows left after their parents were deleted."""
    keys = surviving_parents.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_semi")
