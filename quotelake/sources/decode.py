"""Decoding wire messages. Works on batches and streams.

A decoded row carries ``decode_error``, null for a good row. `strict` turns the
first error into a failed job, `quarantine` splits good rows from bad ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake import schemas as S
from quotelake.functions.text import computed_once
from quotelake.functions.timefn import from_epoch_seconds


def _whole(text: Column) -> Column:
    """Number at hand as a long, null when the text is no number; the decoders report that."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def _message(raw: DataFrame, schema: T.StructType, value: str) -> DataFrame:
    return raw.withColumn("_m", computed_once(F.from_json(value, schema, {"mode": "PERMISSIVE"})))


def _errors(checks: dict[str, Column]) -> Column:
    """The first failed check's name, null if all hold."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _present(names):
    return {f"{n} is missing": F.col(f"_m.{n}").isNotNull() for n in names}


def _readable(names):
    """Whole numbers that are given can be read. An unreadable one is an error, never 0."""
    return {
        f"{n} is not a number": F.col(f"_m.{n}").isNull() | _whole(F.col(f"_m.{n}")).isNotNull() for n in names}


def _fits(types):
    return {
        f"{n} is not a number that fits": F.col(f"_m.{n}").isNull() | F.col(f"_m.{n}").try_cast(t).isNotNull()
        for n, t in types.items()}


def _finish(decoded, checks, cols, value, keep):
    return decoded.withColumn("decode_error", _errors(checks)).select(
        *[c.alias(n) for n, c in cols.items()], *keep, F.col(value).alias("raw_value"), "decode_error")


def parse_stock_json_lenient(raw: DataFrame, ingest_time: Column = None, value="value", keep=()) -> DataFrame:
    """Quotes whose numbers may be quoted and whose time may be missing.

    A time that is not a JSON number is replaced by the time of ingestion.
    """
    schema = T.StructType([
        T.StructField(f.name, T.DoubleType() if f.name == "timestamp" else f.dataType) for f in S.STOCK_MESSAGE])
    ingest_time = F.current_timestamp().cast("timestamp_ntz") if ingest_time is None else ingest_time
    m = _message(raw, schema, value)
    optional = {"change": S.PRICE, "change_percent": S.RATIO, "market_cap": S.CAP, "pe_ratio": S.PE}
    cols = {
        "symbol": F.col("_m.symbol"),
        "price": F.col("_m.price").try_cast(S.PRICE),
        "volume": F.col("_m.volume").try_cast("bigint"),
        "timestamp": F.coalesce(from_epoch_seconds(F.col("_m.timestamp").try_cast("bigint")), ingest_time),
        **{n: F.col(f"_m.{n}").try_cast(t) for n, t in optional.items()},
        "source": F.col("_m.source"),
    }
    checks = {
        **_present(["symbol", "price", "volume", "source"]),
        "price is not a number": F.col("_m.price").try_cast(S.PRICE).isNotNull(),
        "volume is not a whole number": F.col("_m.volume").try_cast("bigint").isNotNull(),
        **_fits(optional),
    }
    return _finish(m, checks, cols, value, keep)


def decode_stock(raw: DataFrame, value="value", keep=()) -> DataFrame:
    """Quotes as the stream job reads them: five fields required."""
    m = _message(raw, S.STOCK_MESSAGE, value)
    cols = {
        "symbol": F.col("_m.symbol"),
        "price": F.col("_m.price").try_cast(S.PRICE),
        "volume": _whole(F.col("_m.volume")),
        "timestamp": from_epoch_seconds(_whole(F.col("_m.timestamp"))),
        "change": F.col("_m.change").try_cast(S.PRICE),
        "change_percent": F.col("_m.change_percent").try_cast(S.RATIO),
        "source": F.col("_m.source"),
    }
    checks = {
        **_present(["symbol", "price", "volume", "source", "timestamp"]),
        "price is not a number": F.col("_m.price").try_cast(S.PRICE).isNotNull(),
        **_readable(["volume", "timestamp"]),
        **_fits({"change": S.PRICE, "change_percent": S.RATIO}),
    }
    return _finish(m, checks, cols, value, keep)


def decode_news(raw: DataFrame, value="value", keep=()) -> DataFrame:
    """Articles. A JSON null stays null and counts as missing."""
    m = _message(raw, S.NEWS_MESSAGE, value)
    cols = {n: F.col(f"_m.{n}") for n in ("title", "content", "url")}
    cols["timestamp"] = from_epoch_seconds(_whole(F.col("_m.timestamp")))
    cols |= {n: F.col(f"_m.{n}") for n in ("source", "sentiment_score", "symbols", "category")}
    checks = {**_present(["title", "content", "url", "source", "category", "timestamp"]), **_readable(["timestamp"])}
    return _finish(m, checks, cols, value, keep)


def decode_economic(raw: DataFrame, value="value", keep=()) -> DataFrame:
    m = _message(raw, S.ECONOMIC_MESSAGE, value)
    cols = {
        "indicator": F.col("_m.indicator"),
        "value": F.col("_m.value").try_cast(S.PRICE),
        "timestamp": from_epoch_seconds(_whole(F.col("_m.timestamp"))),
        **{n: F.col(f"_m.{n}") for n in ("country", "source", "unit", "period")},
    }
    checks = {
        **_present(["indicator", "value", "timestamp", "country", "source"]),
        "value is not a number": F.col("_m.value").try_cast(S.PRICE).isNotNull(),
        **_readable(["timestamp"]),
    }
    return _finish(m, checks, cols, value, keep)


def strict(decoded: DataFrame) -> DataFrame:
    """Fail the job on the first undecodable message.

    The error sits in a filter, so it is raised whichever columns are read, and by counts.
    """
    failure = F.raise_error(F.concat(F.lit("cannot decode message: "), "decode_error", F.lit(": "), F.coalesce(
        "raw_value", F.lit("null"))))
    readable = F.when(F.col("decode_error").isNull(), F.lit(True)).otherwise(failure.cast("boolean"))
    return decoded.where(readable).drop("raw_value", "decode_error")


def parse_stock_json(raw: DataFrame, value="value", keep=()) -> DataFrame:
    return strict(decode_stock(raw, value, keep))


def parse_news_json(raw: DataFrame, value="value", keep=()) -> DataFrame:
    return strict(decode_news(raw, value, keep))


def parse_economic_json(raw: DataFrame, value="value", keep=()) -> DataFrame:
    return strict(decode_economic(raw, value, keep))


def quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, raw bad messages with their error)."""
    good = decoded.where("decode_error IS NULL").drop("decode_error", "raw_value")
    bad = decoded.where("decode_error IS NOT NULL").select("raw_value", "decode_error")
    return good, bad
