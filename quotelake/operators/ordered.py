"""Order-dependent operators that stay parallel when one key is hot.

A window over ``partitionBy(symbol)`` puts a whole symbol in one task. The
operators here window over (key, time bucket) instead and hand what a bucket
needs from its neighbours across as one summary row per bucket:

* the large table is shuffled once, by (key, bucket); the join with the
  summaries uses that same partitioning;
* the summaries come from partial aggregates, and their length per key is
  bounded by the calendar (minutes of history), not by the row count;
* a bucket that holds very many rows nevertheless, a burst or a group of rows
  with one time, is cut further, see `split_hot`.

``keys`` must be non-null. ``order`` starts with the time column and has to be
a total order within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions.timefn import micros, time_bucket, width_micros
from quotelake.session import scratch_path

_BUCKET, _PART = "_bucket", "_part"
HOT_ROWS = 2_000_000
SAMPLES = 64  # rows of a part that its cuts are found from, about


def written(df: DataFrame, name: str) -> DataFrame:
    """A narrow table that several steps read, computed once: written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_hot(bucketed: DataFrame, keys, order, hot_rows=HOT_ROWS) -> DataFrame:
    """Add ``_part``, which cuts (key, bucket) groups of more than
    ``hot_rows`` rows into consecutive runs of about that size.

    The cuts are quantiles of the whole order key, of whatever types it has, so a burst within one instant is cut by what
    follows the time. They come from those rows of hot groups whose hash falls on one of `SAMPLES` marks per part, about.
    All other rows get part 0. There can be at most rows / ``hot_rows`` hot groups and cuts, which is what
    bounds the broadcast: with the default, one entry for every two million rows of the table.
    """
    place = F.struct(*order)
    hot = (
        bucketed.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        .withColumn("_parts", F.ceil(F.col("_n") / F.lit(hot_rows))).drop("_n")
    )
    marked = bucketed.where(F.pmod(F.xxhash64(*order), F.lit(max(1, hot_rows // SAMPLES))) == 0)
    sample = F.sort_array("_sample")
    at = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.floor(i * F.size("_sample") / F.col("_parts")))
    cuts = (
        marked.join(hot, [*keys, _BUCKET])
        .groupBy(*keys, _BUCKET, "_parts").agg(F.collect_list(place).alias("_sample"))
        .select(*keys, _BUCKET, F.transform(at, lambda i: F.get(sample, i.cast("int"))).alias("_cuts"))
    )
    part = F.size(F.filter("_cuts", lambda cut: cut <= place))
    return (
        bucketed.join(F.broadcast(cuts), [*keys, _BUCKET], "left")
        .withColumn(_PART, F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")
    )


def _neighbour(df, keys, order, cols, width, backwards, out, hot_rows):
    value, place = F.struct(*cols), F.struct(*order)
    bucketed = split_hot(df.withColumn(_BUCKET, time_bucket(F.col(order[0]), width)), keys, order, hot_rows)
    group = [*keys, _BUCKET, _PART]
    inside = Window.partitionBy(*group).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_BUCKET, _PART)
    if backwards:
        near, edge = F.lag(value).over(inside), F.max_by(value, place)
        step = F.lag("_edge").over(across)
    else:
        near, edge = F.lead(value).over(inside), F.min_by(value, place)
        step = F.lead("_edge").over(across)
    carried = (
        bucketed.groupBy(*group).agg(edge.alias("_edge"))
        .select(*group, step.alias("_carried"))
        .where(F.col("_carried").isNotNull())
    )
    return (
        bucketed.withColumn("_near", near)
        .join(carried, group, "left")
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_near", "_carried", _BUCKET, _PART)
    )


def previous_row(df: DataFrame, keys, order, cols, width="1 minute", out="previous",
                 hot_rows=HOT_ROWS) -> DataFrame:
    """Add a struct with ``cols`` of the row before, null on a key's first row."""
    return _neighbour(df, list(keys), list(order), list(cols), width, True, out, hot_rows)


def next_row(df: DataFrame, keys, order, cols, width="1 minute", out="following",
             hot_rows=HOT_ROWS) -> DataFrame:
    """Add a struct with ``cols`` of the row after, null on a key's last row."""
    return _neighbour(df, list(keys), list(order), list(cols), width, False, out, hot_rows)


def with_halo(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Send every row to its own bucket of this length and to the one before.

    Adds ``_bucket`` and ``_home``, true in the row's own bucket. Whatever
    follows a row in less than ``seconds`` is then in the row's home bucket.
    Works on streams too.
    """
    span = seconds * 1_000_000
    at = micros(F.col(ts))
    home = at - F.pmod(at, F.lit(span))
    copies = F.explode(F.array(
        F.struct(home.alias("bucket"), F.lit(True).alias("home")),
        F.struct((home - span).alias("bucket"), F.lit(False).alias("home"))))
    return df.select("*", copies.alias("_copy")).select(
        *df.columns, F.col("_copy.bucket").alias(_BUCKET), F.col("_copy.home").alias("_home"))


def next_within(df: DataFrame, keys, order, seconds: int, cols, out="following", hot_rows=HOT_ROWS) -> DataFrame:
    """Like `next_row`, but only for followers less than ``seconds`` later.

    ``df`` is computed and written once; a key that holds a large share of it is cut like any other.
    """
    at = micros(F.col(order[0]))
    rows = written(df.withColumn("_at", at), "ordered")
    near = next_row(rows, keys, order, ["_at", *cols], f"{seconds} seconds", out, hot_rows)
    close = F.col(f"{out}._at") < F.col("_at") + seconds * 1_000_000
    return near.withColumn(out, F.when(close, F.struct(*[F.col(f"{out}.{c}").alias(c) for c in cols]))).drop("_at")


def rolling_sums(df: DataFrame, keys, ts: str, values: dict[str, Column], spans: dict[str, str],
                 width="1 minute", hot_rows=HOT_ROWS) -> DataFrame:
    """Exact sums over the trailing [ts - span, ts], ties included.

    A row adds its values at ``ts`` and takes them back just after
    ``ts + span``; the answer is a running sum over those changes, which needs
    nothing from other buckets but their totals. Rows of one instant count
    together, so a hot bucket is cut between instants only. Values must be
    integers or decimals, so that taking back is exact. Adds ``{value}_{span name}``.
    """
    keys = list(keys)
    names = [(v, s) for v in values for s in spans]
    zero = {v: (values[v] - values[v]) for v in values}
    start = F.struct(
        micros(F.col(ts)).alias("at"), F.lit(0).alias("leaves"),
        *[values[v].alias(f"{v}_{s}") for v, s in names])
    stops = [
        F.struct(
            (micros(F.col(ts)) + width_micros(spans[s])).alias("at"), F.lit(1).alias("leaves"),
            *[(-values[v] if s2 == s else zero[v]).alias(f"{v}_{s2}") for v, s2 in names])
        for s in spans
    ]
    deltas = start, *stops
    # the take-back rows carry no payload, which keeps the shuffle narrow
    payload = F.struct(*[c for c in df.columns if c not in keys])
    tagged = df.select(*keys, payload.alias("_row"), F.explode(F.array(*deltas)).alias("_d")).select(
        *keys, F.when(F.col("_d.leaves") == 0, F.col("_row")).alias("_row"), "_d.*")
    bucket = F.col("at") - F.pmod(F.col("at"), F.lit(width_micros(width)))
    tagged = split_hot(tagged.withColumn(_BUCKET, bucket), keys, ["at"], hot_rows)
    group = [*keys, _BUCKET, _PART]
    running = Window.partitionBy(*group).orderBy("at", "leaves")  # default frame: ties included
    prior = Window.partitionBy(*keys).orderBy(_BUCKET, _PART).rowsBetween(Window.unboundedPreceding, -1)
    cols = [f"{v}_{s}" for v, s in names]
    totals = tagged.groupBy(*group).agg(*[F.sum(c).alias(c) for c in cols])
    totals = totals.select(*group, *[F.sum(c).over(prior).alias(f"_p_{c}") for c in cols])
    return (
        tagged.select(*group, "_row", "leaves", *[F.sum(c).over(running).alias(c) for c in cols])
        .where("leaves = 0")
        .join(totals, group, "left")
        .select(*keys, "_row.*", *[
            (F.col(c) + F.coalesce(F.col(f"_p_{c}"), F.col(c) - F.col(c))).alias(c) for c in cols])
    )
