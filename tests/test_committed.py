"""Shared tables and counters of streams."""

import os
import threading
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quotelake.streaming import committed as C
from quotelake.streaming.counters import StreamCounters
from quotelake.streaming.lateness import with_bounded_lateness

SCHEMA = "id BIGINT, symbol STRING, timestamp TIMESTAMP_NTZ"
NOW = {"availableNow": True}


def ticks(spark, *ids):
    return spark.createDataFrame([(i, "A", datetime(2024, 1, 1 + i // 10, i % 10)) for i in ids], SCHEMA)


def ids(spark, root, **bounds):
    return sorted(r.id for r in C.read(spark, root, "stock_data", SCHEMA, **bounds).collect())


def test_append_delete_and_compact(spark, tmp_path):
    root = str(tmp_path / "t")
    assert ids(spark, root) == [] and C.folders(spark, root) == []
    C.append(root, {"stock_data": ticks(spark, 1, 2, 11)}, "a")
    C.append(root, {"stock_data": ticks(spark, 5)}, "a")  # the same owner again: a replay
    C.append(root, {"stock_data": ticks(spark, 12, 13, 25)})
    assert ids(spark, root) == [1, 2, 11, 12, 13, 25]
    assert ids(spark, root, start=date(2024, 1, 2), end=date(2024, 1, 2)) == [11, 12, 13]
    C.compact(spark, root, "stock_data", SCHEMA)
    assert len(C.folders(spark, root)) == 3 and ids(spark, root) == [1, 2, 11, 12, 13, 25]
    C.delete_before(spark, root, "stock_data", SCHEMA, datetime(2024, 1, 2, 2))
    assert ids(spark, root) == [12, 13, 25]
    C.clean_up(spark, root)
    assert ids(spark, root) == [12, 13, 25] and len(os.listdir(f"{root}/stock_data")) == 2
    C.append(root, {"stock_data": ticks(spark)})
    assert ids(spark, root) == [12, 13, 25]


def test_a_deletion_notices_other_changes(spark, tmp_path, monkeypatch):
    root, replace, early = str(tmp_path / "t"), C._replace, []
    C.append(root, {"stock_data": ticks(spark, 11, 12, 13)}, "a")

    def late(spark, root, add, remove=()):
        if remove and not early:  # between reading the list and replacing it, a compaction takes the folder
            early.append(replace(spark, root, C._write(ticks(spark, 11, 12, 13), root, "stock_data", "c", True), remove))
        return replace(spark, root, add, remove)
    monkeypatch.setattr(C, "_replace", late)
    C.delete_before(spark, root, "stock_data", SCHEMA, datetime(2024, 1, 2, 2))
    assert ids(spark, root) == [12, 13]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    threads = [threading.Thread(target=C.append, args=(root, {"stock_data": ticks(spark, 10 * k)}, f"w{k}")) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    C.append(root, {"stock_data": ticks(spark, 7)})
    assert set(ids(spark, root)) >= {7} and len(ids(spark, root)) == len(C.folders(spark, root, "stock_data"))


def test_a_stream_goes_on_while_others_change_the_table(spark, tmp_path):
    root, cp = str(tmp_path / "t"), str(tmp_path / "cp")

    def run(*new):
        ticks(spark, *new).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        two = lambda b: {"stock_data": b, "seen": b.agg(F.count("*").alias("n"))}
        C.append_stream(stream, root, cp, two, NOW).awaitTermination()
    run(1, 11)
    C.append(root, {"stock_data": ticks(spark, 2)})
    C.compact(spark, root, "stock_data", SCHEMA)
    run(3)
    C.delete_before(spark, root, "stock_data", SCHEMA, datetime(2024, 1, 1, 2))
    run(21)
    assert ids(spark, root) == [2, 3, 11, 21]
    assert sorted(r.n for r in C.read(spark, root, "seen", "n BIGINT").collect()) == [1, 1, 2]


@pytest.mark.parametrize("batches", [105])
def test_counters_see_all_batches(spark, tmp_path, batches):
    counters = StreamCounters.watch(spark)
    spark.range(batches).select("id", F.lit("A").alias("symbol"), F.when(F.col("id") % 3 == 0, F.lit(
        datetime(2024, 1, 1))).otherwise(F.lit(datetime(2024, 6, 1))).alias("timestamp")).repartition(
        batches, "id").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = stream.observe("seen", F.count("*").alias("processed"), F.count_if(F.col("id") < 5).alias("failed"))
    windows = with_bounded_lateness(seen).groupBy(F.window("timestamp", "1 day")).count()
    try:
        with_state = {"spark.sql.shuffle.partitions": "1"}
        before = {k: spark.conf.get(k) for k in with_state}
        for k, v in with_state.items():
            spark.conf.set(k, v)
        q = windows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(**NOW).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        got = counters.totals(q)
        spark.streams.removeListener(counters)
    assert len(q.recentProgress) <= 100
    assert got["processed"] == got["rows"] == batches and got["failed"] == 5
    assert got["late"] >= batches // 3 - 5  # all early ones but those before the first late day
