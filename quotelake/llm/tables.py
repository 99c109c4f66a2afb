"""Reading the driver's tables, keeping intermediate ones, and per-worker objects."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.session import scratch_path

# What counts as white space between words.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Spark's own setting: files of a query's shuffles go when the query has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps read the files, so a lost executor repeats only the step it was
    in, and ids given while writing never change. The shuffles that made the table are not needed any more and
    leave the disks.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*kept: DataFrame) -> None:
    """Delete the files of tables that `keep` has written and nothing reads any more."""
    for df in kept:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(text):
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))


def per_worker(key, make):
    """One object per Python worker process, kept over its tasks (tokenizers, memos of bounded size)."""
    shelf = sys.modules.setdefault("_quotelake_llm_shelf", types.ModuleType("_quotelake_llm_shelf")).__dict__
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]
