"""Explicit schemas. Nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampNTZType()
PRICE = T.DecimalType(19, 4)
RATIO = T.DecimalType(10, 4)
SCORE = T.DecimalType(5, 4)
CAP = T.DecimalType(19, 2)
PE = T.DecimalType(10, 2)


def _struct(*fields):
    """(name, type) is required, (name, type, True) may be null."""
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2) for f in fields])


USERS = _struct(
    ("id", _L), ("username", _S), ("email", _S), ("password", _S), ("first_name", _S), ("last_name", _S),
    ("phone_number", _S, True), ("status", _S), ("email_verified", _B, True), ("phone_verified", _B, True),
    ("two_factor_enabled", _B, True), ("last_login", _TS, True), ("login_attempts", _I, True),
    ("locked_until", _TS, True), ("password_reset_token", _S, True), ("password_reset_expires", _TS, True),
    ("email_verification_token", _S, True), ("email_verification_expires", _TS, True),
    ("created_at", _TS, True), ("updated_at", _TS, True),
)
USER_ROLES = _struct(("user_id", _L), ("role", _S))
USER_WATCHLIST = _struct(("user_id", _L), ("symbol", _S), ("added_at", _TS, True))
STOCK_DATA = _struct(
    ("id", _L), ("symbol", _S), ("price", PRICE), ("volume", _L), ("timestamp", _TS), ("change", PRICE, True),
    ("change_percent", RATIO, True), ("market_cap", CAP, True), ("pe_ratio", PE, True), ("source", _S),
    ("day_high", PRICE, True), ("day_low", PRICE, True), ("fifty_two_week_high", PRICE, True),
    ("fifty_two_week_low", PRICE, True), ("created_at", _TS, True), ("updated_at", _TS, True),
)
NEWS_DATA = _struct(
    ("id", _L), ("title", _S), ("content", _S, True), ("url", _S, True), ("timestamp", _TS), ("source", _S),
    ("sentiment_score", SCORE, True), ("category", _S, True), ("created_at", _TS, True),
)
NEWS_SYMBOLS = _struct(("news_id", _L), ("symbol", _S))
ECONOMIC_DATA = _struct(
    ("id", _L), ("indicator", _S), ("value", PRICE), ("timestamp", _TS), ("country", _S), ("source", _S),
    ("unit", _S, True), ("period", _S, True), ("created_at", _TS, True),
)
NOTIFICATIONS = _struct(
    ("id", _L), ("user_id", _L), ("type", _S), ("status", _S), ("subject", _S), ("content", _S),
    ("recipient_email", _S, True), ("recipient_phone", _S, True), ("recipient_device_token", _S, True),
    ("template_name", _S, True), ("template_data", _S, True), ("error_message", _S, True),
    ("retry_count", _I, True), ("max_retries", _I, True), ("scheduled_at", _TS, True), ("sent_at", _TS, True),
    ("created_at", _TS, True), ("updated_at", _TS, True),
)
USER_ALERTS = _struct(
    ("id", _L), ("user_id", _L), ("symbol", _S), ("alert_type", _S), ("threshold_value", PRICE, True),
    ("enabled", _B, True), ("created_at", _TS, True), ("updated_at", _TS, True),
)
STOCK_DATA_PROCESSED = _struct(
    ("id", _L, True), ("symbol", _S), ("price", PRICE), ("volume", _L), ("timestamp", _TS),
    ("change_percent", RATIO, True), ("avg_price_5min", PRICE, True), ("avg_price_1h", PRICE, True),
    ("volume_ratio", RATIO, True), ("source", _S), ("created_at", _TS, True),
)
TRADING_SIGNALS = _struct(
    ("id", _L), ("symbol", _S), ("signal_type", _S), ("confidence", SCORE, True), ("reason", _S, True),
    ("source", _S), ("timestamp", _TS, True),
)
TABLES = {
    "users": USERS, "user_roles": USER_ROLES, "user_watchlist": USER_WATCHLIST, "stock_data": STOCK_DATA,
    "news_data": NEWS_DATA, "news_symbols": NEWS_SYMBOLS, "economic_data": ECONOMIC_DATA,
    "notifications": NOTIFICATIONS, "user_alerts": USER_ALERTS,
    "stock_data_processed": STOCK_DATA_PROCESSED, "trading_signals": TRADING_SIGNALS,
}

# Wire messages. Every field is nullable here; which ones are required is
# checked after decoding, so that a bad row can be set aside instead of lost.
# Numbers are read as text where producers are known to quote them.
STOCK_MESSAGE = T.StructType([
    T.StructField(n, t) for n, t in [
        ("symbol", _S), ("price", _S), ("volume", _S), ("timestamp", _S), ("change", _S), ("change_percent", _S),
        ("market_cap", _S), ("pe_ratio", _S), ("source", _S)]
])
NEWS_MESSAGE = T.StructType([
    T.StructField(n, t) for n, t in [
        ("title", _S), ("content", _S), ("url", _S), ("timestamp", _S), ("source", _S), ("sentiment_score", _D),
        ("symbols", T.ArrayType(_S)), ("category", _S)]
])
ECONOMIC_MESSAGE = T.StructType([
    T.StructField(n, t) for n, t in [
        ("indicator", _S), ("value", _S), ("timestamp", _S), ("country", _S), ("source", _S), ("unit", _S),
        ("period", _S)]
])
