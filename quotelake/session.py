"""Session defaults and shared scratch folders."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Every timestamp in the library is UTC wall-clock time; window starts, date
# truncation and epoch conversion all read the session zone.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # window and pattern state on local disk instead of the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app="quotelake", master=None, extra=None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the time zone on a session somebody else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Where the setting is absent, a folder of the warehouse. Its default lies on the driver's disk, so on a cluster one of
    the two has to be set.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    configured = configured or spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.sparkContext.getConf().get("spark.sql.warehouse.dir", None)
    if not configured and not warehouse and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; runs never meet each other's files."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
