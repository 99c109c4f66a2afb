"""Tables that streams, batches, deletion and compaction share.

Each writer fills folders of its own. What counts is a small list of folders; a change writes the next list and
renames it into place, so that readers see all of a change or nothing, in all tables of the root. A batch of a stream owns
its folders by the stream's id and number: once it is listed, a replay changes nothing. Two lists of one number can't
come up where a rename refuses a target that exists, as in HDFS; elsewhere one writer at a time may change a root.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.sources.tables import DAY, with_day
from quotelake.streaming.sinks import query_id, retain_since

LISTS = "_lists"


class Changed(RuntimeError):
    """Somebody else has changed the folders that a change was made from."""


def _paths(spark, root):
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm, jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(spark, root) -> tuple[int, list[str]]:
    jvm, fs = _paths(spark, root)
    folder = jvm.Path(f"{root}/{LISTS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    number = max((int(n) for n in names if n.isdigit()), default=0)
    if not number:
        return 0, []
    return number, sorted(r.value for r in spark.read.text(f"{root}/{LISTS}/{number:09d}").collect() if r.value)


def folders(spark: SparkSession, root: str, table: str | None = None) -> list[str]:
    """The folders that count now, of all tables or of one, relative to the root."""
    return [f for f in _newest(spark, root)[1] if table is None or f.startswith(f"{table}/")]


def _replace(spark, root, add, remove=()):
    """Write the next list. Another writer may be faster: then the change is made again on the list it wrote."""
    jvm, fs = _paths(spark, root)
    while True:
        number, now = _newest(spark, root)
        if not set(remove) <= set(now):
            raise Changed("folders to be replaced are gone")
        wanted = (set(now) - set(remove)) | set(add)
        if wanted == set(now):
            return
        fs.mkdirs(jvm.Path(f"{root}/{LISTS}"))
        draft, final = jvm.Path(f"{root}/{LISTS}/.{uuid.uuid4().hex}"), jvm.Path(f"{root}/{LISTS}/{number + 1:09d}")
        out = fs.create(draft, False)
        out.write(bytearray("\n".join(sorted(wanted)).encode()))
        out.close()
        if not fs.exists(final) and fs.rename(draft, final):
            return
        fs.delete(draft, False)


def _write(df, root, table, owner, days):
    """Fill the folders of one owner; returns those that have rows."""
    spark, part = df.sparkSession, f"{table}/part={owner}"
    if not days:
        df.write.mode("overwrite").parquet(f"{root}/{part}")
        return [part]
    with_day(df).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(DAY).parquet(f"{root}/{part}")
    jvm, fs = _paths(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(jvm.Path(f"{root}/{part}"))]
    return [f"{part}/{n}" for n in names if n.startswith(f"{DAY}=")]


def append(root: str, tables: dict[str, DataFrame], owner: str | None = None, days=("stock_data",)) -> None:
    """Add rows to one or more tables in one change. An owner that is listed already has been here: nothing happens.

    Tables in ``days`` are kept by day of their ``timestamp``.
    """
    owner = owner or uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    if any(f.split("/")[1] == f"part={owner}" for f in folders(spark, root)):
        return
    _replace(spark, root, [f for name, df in tables.items() for f in _write(df, root, name, owner, name in days)])


def append_stream(stream: DataFrame, root: str, checkpoint: str, to_tables=None, trigger=None, days=("stock_data",)):
    """Start a stream that appends each batch to tables in one change; ``to_tables`` maps a batch to them."""
    to_tables = to_tables or (lambda batch: {"stock_data": batch})

    def write(batch, n):
        batch.persist()  # several tables from one reading
        try:
            append(root, to_tables(batch), f"{query_id(batch.sparkSession, checkpoint)}-{n}", days)
        finally:
            batch.unpersist()
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"})).foreachBatch(write).start()
    )


def read(spark: SparkSession, root: str, table: str, schema, start=None, end=None) -> DataFrame:
    """The rows of a table as of now. Bounds (dates) leave whole days out before any file is opened."""
    def inside(folder):
        day = folder.rsplit(f"/{DAY}=", 1)[-1] if f"/{DAY}=" in folder else None
        return day is None or (start is None or day >= str(start)) and (end is None or day <= str(end))
    listed = [f"{root}/{f}" for f in folders(spark, root, table) if inside(f)]
    if not listed:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*listed)


def _day(folder):
    return folder.rsplit("=", 1)[1]


def delete_before(spark: SparkSession, root: str, table: str, schema, cutoff) -> None:
    """Delete rows older than ``cutoff``: earlier days leave the list unread, the cutoff's day is written anew.

    Rows that others append to earlier days meanwhile stay for the next deletion; a change of the same day is noticed and
    the deletion starts over.
    """
    while True:
        listed, day = folders(spark, root, table), str(cutoff.date())
        listed = [f for f in listed if f"/{DAY}=" in f and _day(f)[:1].isdigit()]
        gone, today = [f for f in listed if _day(f) < day], [f for f in listed if _day(f) == day]
        kept = []
        if today:
            rows = retain_since(spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in today]), cutoff)
            kept = _write(rows, root, table, uuid.uuid4().hex, True)
        try:
            return _replace(spark, root, kept, gone + today)
        except Changed:
            continue


def compact(spark: SparkSession, root: str, table: str, schema, days=True) -> None:
    """Put the folders of a table together, one per day, while others go on appending; their folders stay beside."""
    while True:
        listed = folders(spark, root, table)
        by_day = {}
        for f in listed:
            by_day.setdefault(_day(f) if days else "", []).append(f)
        old = [f for own in by_day.values() if len(own) > 1 for f in own]
        if not old:
            return
        rows = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in old])
        new = _write(rows, root, table, uuid.uuid4().hex, days)
        try:
            return _replace(spark, root, new, old)
        except Changed:
            continue


def clean_up(spark: SparkSession, root: str) -> None:
    """Delete folders that no list names and all lists but the newest. For times when nobody reads or writes."""
    jvm, fs = _paths(spark, root)
    number, now = _newest(spark, root)
    live = set(now)
    for table in fs.listStatus(jvm.Path(root)):
        name = table.getPath().getName()
        for entry in fs.listStatus(table.getPath()):
            own = f"{name}/{entry.getPath().getName()}"
            if name == LISTS:
                if entry.getPath().getName() != f"{number:09d}":
                    fs.delete(entry.getPath(), True)
            elif not any(f == own or f.startswith(f"{own}/") for f in live):
                fs.delete(entry.getPath(), True)
            elif own not in live:
                for day in fs.listStatus(entry.getPath()):
                    if day.isDirectory() and f"{own}/{day.getPath().getName()}" not in live:
                        fs.delete(day.getPath(), True)
