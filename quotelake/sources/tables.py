"""Stored tables: Parquet partitioned by day, or a live database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake import schemas as S
from quotelake.functions.timefn import moment

DAY_TABLES = {"stock_data", "stock_data_processed"}
DAY = "dt"


def read_table(spark: SparkSession, root: str, name: str, start=None, end=None) -> DataFrame:
    """A table with its fixed schema; [start, end] on ``timestamp`` prunes days.

    The bounds on the day column are implied by the time filter, and Spark
    needs them spelled out to skip partitions.
    """
    schema = S.TABLES[name]
    if name in DAY_TABLES:
        schema = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])
    df = spark.read.schema(schema).parquet(f"{root}/{name}")
    for bound, after in ((start, True), (end, False)):
        if bound is None:
            continue
        at, ts = moment(bound), F.col("timestamp")
        df = df.where(ts >= at if after else ts <= at)
        if name in DAY_TABLES:
            day = F.to_date(at)
            df = df.where(F.col(DAY) >= day if after else F.col(DAY) <= day)
    return df


def by_id(table: DataFrame, id) -> DataFrame:
    return table.where(F.col("id") == id)


def with_day(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn(DAY, F.to_date("timestamp"))


def write_table(df: DataFrame, root: str, name: str, mode="append", files_per_day=None) -> None:
    """Write a table; tick tables go into day partitions.

    ``files_per_day`` first spreads each day over that many sorted files: a
    day is the partition, symbol hashes divide it, and rows sorted by symbol
    and time let readers skip row groups.
    """
    if name not in DAY_TABLES:
        df.write.mode(mode).parquet(f"{root}/{name}")
        return
    out = with_day(df)
    if files_per_day:
        # the time goes into the hash so that a hot symbol does not fill one file
        slot = F.pmod(F.xxhash64("symbol", "timestamp"), F.lit(files_per_day))
        out = out.repartition(DAY, slot).sortWithinPartitions(DAY, "symbol", "timestamp")
    out.write.mode(mode).partitionBy(DAY).parquet(f"{root}/{name}")


def jdbc_options(url: str, table: str, user=None, password=None, driver="org.postgresql.Driver",
                 partition_column=None, lower=None, upper=None, partitions=None) -> dict[str, str]:
    opts = {"url": url, "dbtable": table, "driver": driver, "fetchsize": "10000", "batchsize": "10000"}
    if user is not None:
        opts |= {"user": user, "password": password}
    if partition_column:
        opts |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                 "numPartitions": str(partitions)}
    return opts


def read_jdbc_table(spark: SparkSession, name: str, url: str, **options) -> DataFrame:
    """A live table. Filters and columns are pushed to the database; pass a
    partition column and its bounds to read in parallel."""
    return spark.read.format("jdbc").options(**jdbc_options(url, name, **options)).load()


def _ago(span, as_of):
    """``as_of`` minus spans such as '2 hours' held in a column."""
    n, unit = F.split_part(span, F.lit(" "), F.lit(1)).cast("int"), F.split_part(span, F.lit(" "), F.lit(2))
    days = F.when(unit.startswith("day"), n).otherwise(0)
    hours = F.when(unit.startswith("hour"), n).otherwise(0)
    mins = F.when(unit.startswith("minute"), n).otherwise(0)
    return F.when(span.isNotNull(), moment(as_of) - F.make_dt_interval(days, hours, mins))


def load_seed(spark: SparkSession, fixtures: str, root: str, as_of, tables=None, mode="overwrite") -> list[str]:
    """Write ``<table>.csv`` files of a folder as tables.

    ``mode="append"`` adds the rows to tables that exist, ``mode="error"`` refuses to touch them.
    Timestamps are given as spans before ``as_of``, such as "2 hours"; empty
    cells are null.
    """
    loaded = []
    for name in tables or S.TABLES:
        schema = S.TABLES[name]
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        raw = spark.read.schema(text).csv(f"{fixtures}/{name}.csv", header=True)
        rows = raw.select(*[
            (_ago(F.col(f.name), as_of) if isinstance(f.dataType, T.TimestampNTZType)
             else F.col(f.name).cast(f.dataType)).alias(f.name)
            for f in schema])
        write_table(rows, root, name, mode=mode)
        loaded.append(name)
    return loaded
