"""Decoding, payloads, codecs, stored tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quotelake.sources import avro as AV
from quotelake.sources import decode as D
from quotelake.sources import payloads as PL
from quotelake.sources import tables as TB
from quotelake.sources import topics as TP
from quotelake.streaming import sinks as K

VALID = '{"symbol":"AAPL","price":150.50,"volume":1000000,"timestamp":1640995200,"source":"test"}'


def messages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value STRING")


def test_valid_message(spark):
    r = D.parse_stock_json(messages(spark, VALID)).first()
    assert (r["symbol"], float(r["price"]), r["volume"], r["timestamp"], r["change"], r["source"]) == (
        "AAPL", 150.5, 1000000, datetime(2022, 1, 1), None, "test")


@pytest.mark.parametrize("text", [
    "invalid json", "", '{"symbol":"A","volume":1,"timestamp":1,"source":"s"}',
    '{"symbol":"A","price":"abc","volume":1,"timestamp":1,"source":"s"}',
    '{"symbol":null,"price":1,"volume":1,"timestamp":1,"source":"s"}',
    '{"symbol":"A","price":1,"volume":"abc","timestamp":1,"source":"s"}',
    '{"symbol":"A","price":1,"volume":1,"timestamp":"zzz","source":"s"}',
    '{"symbol":"A","price":1,"volume":1,"timestamp":1,"source":"s","change_percent":12345678.5}'])
def test_strict_decoding_fails_the_job(spark, text):
    with pytest.raises(Exception, match="cannot decode message"):
        D.parse_stock_json(messages(spark, VALID, text)).collect()


@pytest.mark.parametrize("read", [
    lambda df: df.count(), lambda df: df.select("source").collect(), lambda df: df.select("price").collect(),
    lambda df: df.agg(F.sum("volume")).collect(), lambda df: df.groupBy("symbol").count().collect()])
def test_strictness_cannot_be_pruned(spark, read):
    with pytest.raises(Exception, match="cannot decode message"):
        read(D.parse_stock_json(messages(spark, VALID, "x")))
    assert D.parse_stock_json(messages(spark, VALID, VALID)).count() == 2


def test_unreadable_numbers_are_reported(spark):
    base = json.loads(VALID)
    good, bad = D.quarantine(D.decode_stock(messages(
        spark, json.dumps(base | {"volume": "abc"}), json.dumps(base | {"timestamp": "zzz"}),
        json.dumps(base | {"volume": "12.0"}))))
    assert [r["volume"] for r in good.collect()] == [12]
    assert sorted(r["decode_error"] for r in bad.collect()) == ["timestamp is not a number", "volume is not a number"]
    economic = {"indicator": "i", "value": 1, "timestamp": "soon", "country": "c", "source": "s"}
    assert D.decode_economic(messages(spark, json.dumps(economic))).first()["decode_error"] == "timestamp is not a number"


def test_lenient_decoding(spark):
    base = json.loads(VALID)
    texts = [
        VALID, "invalid json",
        json.dumps(base | {"price": "1.5", "volume": "7", "pe_ratio": "28.5", "market_cap": 2.75e12}),
        json.dumps(base | {"timestamp": "1640995200"}),
        json.dumps({k: v for k, v in base.items() if k != "timestamp"}),
        json.dumps(base | {"volume": "1.5"}), json.dumps(base | {"change": "n/a"})]
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    good, bad = D.quarantine(D.parse_stock_json_lenient(messages(spark, *texts), now))
    got = [(float(r["price"]), r["volume"], r["timestamp"].year, r["pe_ratio"] and float(r["pe_ratio"]))
           for r in good.collect()]
    assert got == [(150.5, 1000000, 2022, None), (1.5, 7, 2022, 28.5), (150.5, 1000000, 2030, None),
                   (150.5, 1000000, 2030, None)]
    assert sorted(r["decode_error"] for r in bad.collect()) == [
        "change is not a number that fits", "symbol is missing", "volume is not a whole number"]


def test_observed_counts(spark):
    decoded, seen = K.observe_counts(D.decode_stock(messages(spark, VALID, VALID, "x")), "decoding")
    decoded.write.format("noop").mode("overwrite").save()
    assert seen.get == {"processed": 3, "failed": 1}
    status = {r["status"]: r["messages"] for r in K.messages_by_status(decoded, "t").collect()}
    assert status == {"success": 2, "error": 1}


def test_news_and_economic(spark):
    news = {"title": "t", "content": "c", "url": "u", "timestamp": 1640995200, "source": "s", "category": "g"}
    n = D.parse_news_json(messages(spark, json.dumps(news | {"sentiment_score": None}),
                                   json.dumps(news | {"sentiment_score": 0.5, "symbols": ["A", "B"]}))).collect()
    assert [(r["sentiment_score"], r["symbols"]) for r in n] == [(None, None), (0.5, ["A", "B"])]
    good, bad = D.quarantine(D.decode_news(messages(spark, json.dumps({k: v for k, v in news.items() if k != "url"}))))
    assert (good.count(), bad.first()["decode_error"]) == (0, "url is missing")
    e = D.parse_economic_json(messages(spark, json.dumps({
        "indicator": "GDP", "value": 2.5, "timestamp": 1640995200, "country": "US", "source": "fred", "unit": "Percent",
        "period": "quarterly"}))).first()
    assert (e["indicator"], float(e["value"]), e["timestamp"], e["period"]) == (
        "GDP", 2.5, datetime(2022, 1, 1), "quarterly")


def test_quotes(spark):
    def landed(quote):
        return ("AAPL", json.dumps(quote), datetime(2024, 1, 1))
    full = {"05. price": "175.25", "06. volume": "45234567", "09. change": "2.15", "10. change percent": "1.24%"}
    df = spark.createDataFrame([
        landed({"Global Quote": full}), landed({"Global Quote": {}}), landed({}), landed({"Global Quote": {"05. price": "3"}}),
        landed({"Global Quote": full | {"05. price": "n/a"}})], "symbol STRING, payload STRING, fetched_at TIMESTAMP_NTZ")
    got = [(r["price"], r["volume"], r["change"], r["change_percent"]) for r in PL.normalize_quote(df).collect()]
    assert got == [(175.25, 45234567, 2.15, 1.24), (3.0, 0, 0.0, 0.0)]


def test_articles(spark):
    def a(**k):
        return {"title": "t", "content": "c", "url": "u", "publishedAt": "2024-01-15T08:00:00Z", "source": {"name": "n"}} | k
    payload = json.dumps({"articles": [
        a(), a(title=""), a(content=None), a(content="x" * 1001, source={}), a(publishedAt=""),
        a(publishedAt="2024-01-15T10:00:00+02:00", url=None)]})
    got = PL.normalize_articles(spark.createDataFrame([(payload,)], "payload STRING")).collect()
    assert [(len(r["content"]), r["source"], r["url"]) for r in got] == [(1, "n", "u"), (1001, "unknown", "u"), (1, "n", "")]
    assert {r["timestamp"] for r in got} == {datetime(2024, 1, 15, 8)}


def test_observations(spark):
    def p(*obs, units="Percent"):
        return json.dumps({"units": units, "observations": [{"date": d, "value": v} for d, v in obs]})
    df = spark.createDataFrame([
        ("GDP", p(("2024-01-01", "1.5"), ("2024-02-01", "2.5"))), ("CPI", p(("2024-01-01", "1.5"), ("2024-02-01", "."))),
        ("NONE", p()), ("UNRATE", json.dumps({"observations": [{"date": "2024-01-01", "value": "4"}]}))],
        "indicator STRING, payload STRING")
    got = {r["indicator"]: (r["value"], r["timestamp"], r["unit"]) for r in PL.normalize_observations(df).collect()}
    assert got == {"GDP": (2.5, datetime(2024, 2, 1), "Percent"), "UNRATE": (4.0, datetime(2024, 1, 1), "Unknown")}


def test_avro_schema_and_header(spark):
    stock = json.loads(AV.avro_schema("stock_data"))
    assert [f["name"] for f in stock["fields"]] == [
        "symbol", "price", "volume", "timestamp", "change", "change_percent", "market_cap", "pe_ratio", "source"]
    assert stock["fields"][6] == {"name": "market_cap", "type": ["null", "double"], "default": None}
    df = spark.createDataFrame([(bytearray(AV.header(258) + b"body"),)], "value BINARY")
    assert bytes(df.select(AV.without_header(F.col("value")).alias("v")).first()["v"]) == b"body"
    assert AV.header(258) == b"\x00\x00\x00\x01\x02"
    row = spark.createDataFrame([("GDP", 1.0, 1, "US", "fred", "P", "m")], AV.record_fields("economic_data"))
    assert json.loads(bytes(row.select(AV.encode("economic_data").alias("v")).first()["v"]))["indicator"] == "GDP"


def test_broker_options():
    r = TP.kafka_read_options(TP.DATA_TOPICS, "b:9092", group="g", starting="earliest", max_offsets=500)
    assert r["subscribe"] == "stock-data,news-data,economic-data" and r["startingOffsets"] == "earliest"
    assert r["maxOffsetsPerTrigger"] == "500"
    with pytest.raises(ValueError):
        TP.kafka_read_options(["t"], "b", starting="middle")
    w = TP.kafka_write_options("b:9092")
    assert (w["kafka.acks"], w["kafka.enable.idempotence"], w["kafka.compression.type"]) == ("all", "true", "snappy")
    j = TB.jdbc_options("jdbc:postgresql://h/db", "stock_data", partition_column="id", lower=0, upper=10, partitions=4)
    assert j["numPartitions"] == "4" and j["dbtable"] == "stock_data"


def test_time_bounds_prune_days(spark, sf_dir, tmp_path):
    from quotelake.sources import adapters as A

    root = str(tmp_path)
    TB.write_table(A.ticks(spark, sf_dir), root, "stock_data", files_per_day=2)
    df = TB.read_table(spark, root, "stock_data", "2024-01-03 06:00:00", "2024-01-04 18:00:00").select("symbol", "price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "dt#" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(timestamp" in scan
    assert scan.split("ReadSchema:")[1].strip().startswith("struct<symbol:string,price:decimal(19,4),timestamp:timestamp_ntz>")
    import os
    days = os.listdir(f"{root}/stock_data")
    assert sum(d.startswith("dt=") for d in days) > 25
