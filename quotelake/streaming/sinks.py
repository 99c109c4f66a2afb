"""Where results go: topics, tables, counters, the console."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotelake import schemas as S
from quotelake.functions.timefn import moment
from quotelake.sources import topics as TP
from quotelake.sources.tables import DAY, read_table, with_day

# Topics

# Live update destinations
LIVE_STOCKS, LIVE_NEWS, LIVE_ECONOMIC = "/topic/stocks", "/topic/news", "/topic/economic"


def _camel(name):
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def json_value(df: DataFrame, camel=False) -> Column:
    return F.to_json(F.struct(*[F.col(c).alias(_camel(c) if camel else c) for c in df.columns]))


def topic_messages(df: DataFrame, topic: str, camel=True) -> DataFrame:
    """Rows as JSON messages of a topic."""
    return df.select(F.lit(topic).alias("topic"), json_value(df, camel).alias("value"))


def keyed_messages(df: DataFrame, kind: str, topic: str, at=None) -> DataFrame:
    """As `topic_messages`, with the key that places a message: the symbol,
    else the indicator, else the kind of record and the time in seconds."""
    at = F.current_timestamp() if at is None else moment(at).cast("timestamp")
    given = [F.col(c) for c in ("symbol", "indicator") if c in df.columns]
    fallback = F.concat(F.lit(f"{kind}_"), F.unix_timestamp(at).cast("string"))
    return df.select(
        F.lit(topic).alias("topic"), F.coalesce(*given, fallback).alias("key"), json_value(df).alias("value"))


def fan_out_topics(df: DataFrame, kind="stock") -> DataFrame:
    """Live updates: a tick goes to its symbol's destination and to the common one."""
    if kind == "stock":
        to = F.explode(F.array(F.concat(F.lit(LIVE_STOCKS + "/"), "symbol"), F.lit(LIVE_STOCKS)))
    else:
        to = F.lit({"news": LIVE_NEWS, "economic": LIVE_ECONOMIC}[kind])
    return df.select(json_value(df, camel=True).alias("value"), to.alias("topic"))


def publish(messages: DataFrame, servers=None, folder=None) -> None:
    """Write a batch of (topic, value) rows, with a key or without."""
    if folder is not None:
        messages.select("value", "topic").write.mode("append").partitionBy("topic").text(folder)
    else:
        messages.write.format("kafka").options(**TP.kafka_write_options(servers)).save()


def write_topic(messages: DataFrame, checkpoint: str, name: str, servers=None, folder=None, trigger=None):
    """Start a stream that writes (topic, value) rows to a broker or to folders."""
    writer = messages.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"processingTime": "60 seconds"}))
    if folder is not None:
        return writer.format("text").partitionBy("topic").start(folder)
    return writer.format("kafka").options(**TP.kafka_write_options(servers)).start()


def debug_sink(stream: DataFrame, name: str, memory=False, output_mode="append"):
    """Print a stream, or keep it in a small in-memory table. For watching only."""
    writer = stream.writeStream.queryName(name).outputMode(output_mode)
    return writer.format("memory" if memory else "console").start()


# Tables

def append_ticks(stream: DataFrame, root: str, checkpoint: str, trigger=None):
    """Start a stream that appends ticks to the day partitions of stock_data."""
    return (
        with_day(stream).writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .format("parquet").partitionBy(DAY).start(f"{root}/stock_data")
    )


_LAST = ["price", "volume"]
_FIRST = ["change_percent", "avg_price_5min", "avg_price_1h", "volume_ratio", "source"]
_WINDOWS = ["avg_price_5min", "avg_price_1h", "volume_ratio"]


def _collapse(rows, order):
    """One row per (symbol, timestamp): price and volume of the last in order,
    everything else of the first. Rows that only bring window columns come behind the ticks
    themselves, but their window columns go first."""
    first, at = [c for c in _FIRST if c in rows.columns], F.struct(*order)
    if "only_windows" not in rows.columns:
        return rows.groupBy("symbol", "timestamp").agg(
            F.min_by(F.struct(*first), at).alias("f"), F.max_by(F.struct(*_LAST), at).alias("l"),
        ).select("symbol", "l.*", "timestamp", "f.*")
    late = F.coalesce("only_windows", F.lit(False))
    merged = rows.groupBy("symbol", "timestamp").agg(
        F.min_by(F.struct(*first), F.struct(late, *order)).alias("f"),
        F.max_by(F.struct(*_LAST), F.struct(~late, *order)).alias("l"),
        F.min_by(F.struct(*_WINDOWS), F.when(late, at)).alias("w"), F.min(late).alias("only_windows"))
    return merged.select("symbol", "l.*", "timestamp", *[
        (F.when(F.col("w").isNotNull(), F.col(f"w.{c}")).otherwise(F.col(f"f.{c}")) if c in _WINDOWS
         else F.col(f"f.{c}")).alias(c) for c in first], "only_windows")


def processed_rows(ticks: DataFrame) -> DataFrame:
    """Ticks as rows to upsert, with the columns of `enrich_processed` where there are any; else the
    5-minute average is the price."""
    average = F.col("avg_price_5min" if "avg_price_5min" in ticks.columns else "price").cast("decimal(19,4)")
    more = {"avg_price_1h": "decimal(19,4)", "volume_ratio": "double", "arrival": "bigint"}
    return ticks.select(
        "symbol", "price", "volume", "timestamp", F.col("change_percent").cast("double").alias("change_percent"),
        average.alias("avg_price_5min"), "source",
        *[F.col(c).cast(kind).alias(c) for c, kind in more.items() if c in ticks.columns])


def merge_processed(old: DataFrame, new: DataFrame, arrival="arrival") -> DataFrame:
    """Upsert: an existing (symbol, timestamp) takes price and volume of the
    newest row and keeps its other columns.

    Both sides are united and aggregated: one shuffle with partial
    aggregation, and repeated keys inside ``new`` need no step of their own.
    """
    cols = ["symbol", *_LAST, "timestamp", *[c for c in _FIRST if c in old.columns and c in new.columns]]
    both = old.select(*cols, F.lit(0).alias("_gen"), F.lit(0).cast("bigint").alias("_seq")).unionByName(
        new.select(*cols, F.lit(1).alias("_gen"), F.col(arrival).cast("bigint").alias("_seq")))
    return _collapse(both, ["_gen", "_seq"])


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps as long as it keeps its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def run_folder(spark: SparkSession, root: str, run: str) -> str:
    """The folder of a stream's batches: numbered in the order in which streams first wrote here, found again by id."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    runs = [n for n in names if n.startswith("run=")]
    own = [n for n in runs if n.endswith(f"_{run}")]
    if own:
        return f"{root}/{own[0]}"
    last = int(runs[-1].removeprefix("run=").split("_")[0]) if runs else 0
    return f"{root}/run={last + 1:09d}_{run}"


def upsert_batch(batch: DataFrame, batch_id: int, root: str, arrival="arrival", run="batch") -> None:
    """Write one micro-batch of `processed_rows`.

    A batch owns the folder with its stream and number and overwrites it, so a replay
    changes nothing, and no other file is touched; a stream with a new checkpoint is another run and
    comes after those before it. Rows of different batches are merged by `read_processed`.
    """
    (
        with_day(_collapse(batch, [arrival]))
        .write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy(DAY).parquet(f"{run_folder(batch.sparkSession, root, run)}/batch={batch_id}")
    )


_PROCESSED_FILES = (
    "symbol STRING, price DECIMAL(19,4), volume BIGINT, timestamp TIMESTAMP_NTZ, change_percent DOUBLE, "
    "avg_price_5min DECIMAL(19,4), avg_price_1h DECIMAL(19,4), volume_ratio DOUBLE, source STRING, only_windows BOOLEAN, "
    "run STRING, batch BIGINT, dt DATE"
)


def _names(spark, path, start):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(n for s in (fs.listStatus(path) if fs.exists(path) else []) if (n := s.getPath().getName()).startswith(start))


def _finished(spark, root) -> tuple[str | None, list[str] | None]:
    """(newest finished generation, batches that it doesn't cover); (None, None) where there is no generation."""
    done = [g for g in _names(spark, root, "_generation-") if _names(spark, f"{root}/{g}", "covers")]
    if not done:
        return None, None
    covered = {r.value for r in spark.read.text(f"{root}/{done[-1]}/covers").collect()}
    return done[-1], [b for b in _batches(spark, root) if b not in covered]


def _batches(spark, root) -> list[str]:
    """Batches that are completely written, as run/batch."""
    return [f"{run}/{b}" for run in _names(spark, root, "run=") for b in _names(spark, f"{root}/{run}", "batch=")
            if _names(spark, f"{root}/{run}/{b}", "_SUCCESS")]


def _stored(spark, root, finished):
    generation, rest = finished
    if generation is None:
        return spark.read.schema(_PROCESSED_FILES).parquet(root)
    old = spark.read.schema(_PROCESSED_FILES).parquet(f"{root}/{generation}/rows").withColumns(
        {"run": F.lit(""), "batch": F.lit(-1).cast("bigint")})  # before all batches
    if not rest:
        return old
    return old.unionByName(spark.read.schema(_PROCESSED_FILES).option("basePath", root).parquet(*[f"{root}/{b}" for b in rest]))


def compact_in_place(spark: SparkSession, root: str) -> None:
    """Fold all finished batches into a new generation while streams go on writing theirs.

    Readers take the newest generation that is complete and the batches it doesn't name. A covered batch that is
    replayed is written again and not looked at. Covered folders and older generations may be deleted when no reader
    is left that began before.
    """
    finished, batches = _finished(spark, root), _batches(spark, root)
    rest = batches if finished[1] is None else finished[1]
    if not rest:
        return
    if finished[0] is None:
        rows = spark.read.schema(_PROCESSED_FILES).option("basePath", root).parquet(*[f"{root}/{b}" for b in rest])
    else:
        rows = _stored(spark, root, (finished[0], rest))
    last = int(finished[0].rsplit("-", 1)[1]) if finished[0] else 0
    path = f"{root}/_generation-{last + 1:09d}"
    with_day(_collapse(rows, ["run", "batch"])).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy(DAY).parquet(f"{path}/rows")
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/covers")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.covers")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray("\n".join(batches).encode()))
    out.close()
    fs.rename(draft, marker)


def read_processed(spark: SparkSession, root: str, start=None, end=None, windows=False) -> DataFrame:
    """The merged table; bounds on the time prune days before the merge. ``windows`` adds the average of the hour and the
    volume ratio, null where no enriched row has come."""
    rows = _stored(spark, root, _finished(spark, root))
    if start is not None:
        rows = rows.where((F.col("timestamp") >= moment(start)) & (F.col(DAY) >= F.to_date(moment(start))))
    if end is not None:
        rows = rows.where((F.col("timestamp") <= moment(end)) & (F.col(DAY) <= F.to_date(moment(end))))
    merged = _collapse(rows, ["run", "batch"]).drop("only_windows")
    return merged if windows else merged.drop("avg_price_1h", "volume_ratio")


def compact_processed(spark: SparkSession, root: str, out: str) -> None:
    """Write the merged table to a new folder as its oldest run."""
    with_day(read_processed(spark, root, windows=True)).write.mode("error").partitionBy(DAY).parquet(
        f"{out}/run={0:09d}_compacted/batch=0")


def window_rows(enriched: DataFrame) -> DataFrame:
    """Rows of an enriched stream for a table that already takes its ticks as they come: they bring the window
    columns of a tick, and the tick itself only where it isn't stored."""
    return processed_rows(enriched).withColumn("only_windows", F.lit(True))


def upsert_processed(stream: DataFrame, root: str, checkpoint: str, arrival="arrival", trigger=None):
    """Start a stream that upserts `processed_rows`."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .foreachBatch(lambda df, n: upsert_batch(df, n, root, arrival, query_id(df.sparkSession, checkpoint))).start()
    )


def merge_touch(table: DataFrame, updates: DataFrame, key, at) -> DataFrame:
    """Apply full-row updates by key; changed rows get ``updated_at`` = ``at``."""
    key = list(key)
    fields = [c for c in updates.columns if c not in key]
    u = updates.select(*key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    merged = table.join(u, key, "left")
    return merged.select(*[
        F.when(F.col("_hit"), moment(at)).otherwise(F.col(c)).alias(c) if c == "updated_at"
        else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields
        else F.col(c) for c in table.columns])


def append_derived(spark: SparkSession, root: str, news=None, economic=None, signals=None) -> None:
    """Append articles with their symbol rows, observations and signals."""
    if news is not None:
        parents = news.select(*[c for c in S.NEWS_DATA.fieldNames() if c in news.columns])
        parents.write.mode("append").parquet(f"{root}/news_data")
        news_symbol_rows(news).write.mode("append").parquet(f"{root}/news_symbols")
    if economic is not None:
        economic.write.mode("append").parquet(f"{root}/economic_data")
    if signals is not None:
        signals.write.mode("append").parquet(f"{root}/trading_signals")


def news_symbol_rows(news: DataFrame) -> DataFrame:
    return news.select(F.col("id").alias("news_id"), F.explode(F.array_distinct("symbols")).alias("symbol"))


# Retention

def retain_since(df: DataFrame, cutoff, ts="timestamp") -> DataFrame:
    """Rows that stay: all that are not older than ``cutoff``, those without a time included."""
    return df.where(~F.coalesce(F.col(ts) < moment(cutoff), F.lit(False)))


def expired_count(df: DataFrame, cutoff, ts="timestamp") -> DataFrame:
    """How many rows a deletion would take."""
    return df.where(F.col(ts) < moment(cutoff)).agg(F.count(F.lit(1)).alias("deleted"))


def delete_expired_days(spark: SparkSession, root: str, name: str, cutoff: datetime) -> int:
    """Delete rows of a day-partitioned table older than ``cutoff``; returns
    how many.

    Only the day of the cutoff is rewritten, next to the table and then moved
    in; older days are dropped as folders without being read.
    """
    day = cutoff.date()
    old = read_table(spark, root, name, end=cutoff)
    deleted = expired_count(old, cutoff).first()["deleted"]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    table = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = table.getFileSystem(conf)
    today = jvm.org.apache.hadoop.fs.Path(table, f"{DAY}={day}")
    staged = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}-kept-{day}")
    if not fs.exists(today) and fs.exists(jvm.org.apache.hadoop.fs.Path(staged, "_SUCCESS")):
        fs.rename(staged, today)  # an earlier run ended between the two steps below
    if fs.exists(today):
        kept = retain_since(read_table(spark, root, name).where(F.col(DAY) == F.lit(day)), cutoff)
        kept.drop(DAY).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(staged.toString())
        fs.delete(today, True)
        fs.rename(staged, today)
    for status in fs.listStatus(table):
        label = status.getPath().getName()
        if label.startswith(f"{DAY}=") and label[len(DAY) + 1:] < str(day):
            fs.delete(status.getPath(), True)
    return deleted


# Counters

def observe_counts(decoded: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows and undecodable rows while the data passes by."""
    seen = Observation(name)
    return decoded.observe(
        seen, F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("decode_error").isNotNull()).alias("failed")), seen


def points_by_source(df: DataFrame, data_type: str) -> DataFrame:
    return df.groupBy(F.lit(data_type).alias("data_type"), "source").agg(F.count(F.lit(1)).alias("points"))


def messages_by_status(decoded: DataFrame, topic: str) -> DataFrame:
    status = F.when(F.col("decode_error").isNull(), "success").otherwise("error")
    return decoded.groupBy(F.lit(topic).alias("topic"), status.alias("status")).agg(
        F.count(F.lit(1)).alias("messages"))
