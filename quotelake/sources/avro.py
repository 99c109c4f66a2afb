"""Avro records with a five-byte registry header, and JSON where there is none."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTIONAL_DOUBLE = ["null", "double"]

# Record names, fields and order
_FIELDS = {
    "stock_data": ("StockData", [
        ("symbol", "string"), ("price", "double"), ("volume", "long"), ("timestamp", "long"), ("change", "double"),
        ("change_percent", "double"), ("market_cap", _OPTIONAL_DOUBLE), ("pe_ratio", _OPTIONAL_DOUBLE),
        ("source", "string")]),
    "news_data": ("NewsData", [
        ("title", "string"), ("content", "string"), ("url", "string"), ("timestamp", "long"), ("source", "string"),
        ("sentiment_score", _OPTIONAL_DOUBLE), ("symbols", {"type": "array", "items": "string"}),
        ("category", "string")]),
    "economic_data": ("EconomicData", [
        ("indicator", "string"), ("value", "double"), ("timestamp", "long"), ("country", "string"),
        ("source", "string"), ("unit", "string"), ("period", "string")]),
}
HEADER_BYTES = 5


def avro_schema(kind: str) -> str:
    name, fields = _FIELDS[kind]
    return json.dumps({"type": "record", "name": name, "fields": [
        {"name": n, "type": t, **({"default": None} if t == _OPTIONAL_DOUBLE else {})} for n, t in fields]})


def record_fields(kind: str) -> list[str]:
    return [n for n, _ in _FIELDS[kind][1]]


def header(schema_id: int) -> bytes:
    """Magic byte and big-endian schema id."""
    return b"\x00" + schema_id.to_bytes(4, "big")


def without_header(value: Column) -> Column:
    return F.substring(value, HEADER_BYTES + 1, 2**31 - 1 - HEADER_BYTES)


def decode_avro(value: Column, kind: str) -> Column:
    """Struct of the record. Needs the spark-avro connector on the class path."""
    from pyspark.sql.avro.functions import from_avro

    return from_avro(without_header(value), avro_schema(kind))


def encode_avro(kind: str, schema_id: int) -> Column:
    """Header and record of the row's columns. Needs the spark-avro connector."""
    from pyspark.sql.avro.functions import to_avro

    body = to_avro(F.struct(*record_fields(kind)), avro_schema(kind))
    return F.concat(F.lit(bytearray(header(schema_id))), body)


def encode(kind: str, schema_id=None) -> Column:
    """Message value: Avro if the schema is registered, else JSON text."""
    if schema_id is not None:
        return encode_avro(kind, schema_id)
    return F.to_json(F.struct(*record_fields(kind))).cast("binary")
