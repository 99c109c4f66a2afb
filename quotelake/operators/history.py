"""Queries over stored ticks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions.timefn import before, micros, moment
from quotelake.operators.ordered import previous_row

_WHOLE = ("byte", "short", "integer", "long")


def position(df: DataFrame, order):
    """What rows are ordered by, of a type that aggregates by hashing where there is one.

    A time followed by a whole number becomes one decimal; anything else a struct,
    for which Spark sorts each input partition.
    """
    kinds = [df.schema[c].dataType.typeName() for c in order]
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and kinds[0].startswith("timestamp") and kinds[1] in _WHOLE:
        return place_of(F.col(order[0]), F.col(order[1]))
    return F.struct(*order)


def place_of(time, number):
    """A time and a whole number as one decimal in their order; a null number comes first at its time.

    Without a time there is no place: null.
    """
    # microseconds take 18 digits and a step of 2^65 leaves room for all longs of either sign and for null
    at = micros(time).cast("decimal(18,0)") * F.lit(Decimal(2 ** 65))
    return (at + F.coalesce(number.cast("decimal(20,0)"), F.lit(Decimal(-2 ** 63 - 1)))).cast("decimal(38,0)")


def newest_rows(df: DataFrame, keys, order) -> DataFrame:
    """Exactly one newest row per key, with all columns.

    With a time and a whole number as order their highest place is found by hashing, and only the rows at it are
    fetched; of repeated rows one stays. Rows without a time count below all others. Other orders need structs, for
    which Spark sorts each input partition.
    """
    keys, columns = list(keys), df.columns
    at = position(df, order)
    if len(order) > 1 and df.select(at.alias("at")).schema["at"].dataType.typeName() == "struct":
        rest = [c for c in columns if c not in keys]
        newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_row"))
        return newest.select(*keys, "_row.*").select(*columns)
    at = F.coalesce(at, F.lit(Decimal(-10 ** 37)).cast("decimal(38,0)")) if len(order) > 1 else at
    top = df.groupBy(*keys).agg(F.max(at).alias("_top")).select(*[F.col(c).alias(f"_{c}") for c in keys], "_top")
    same = at.eqNullSafe(F.col("_top"))
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    one = Window.partitionBy(*keys).orderBy(*keys)
    return df.join(top, same, "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select(*columns)


def filter_symbol(ticks: DataFrame, symbol: str) -> DataFrame:
    return ticks.where(F.col("symbol") == symbol)


def filter_symbols(ticks: DataFrame, symbols) -> DataFrame:
    """Rows of the listed symbols; a DataFrame of symbols joins instead. Columns keep their order."""
    if isinstance(symbols, DataFrame):
        return ticks.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select(*ticks.columns)
    return ticks.where(F.col("symbol").isin(list(symbols)))


def ticks_in(ticks: DataFrame, symbol, start, end) -> DataFrame:
    """One symbol in [start, end], both ends included."""
    return filter_symbol(ticks, symbol).where(F.col("timestamp").between(moment(start), moment(end)))


def ticks_between(ticks: DataFrame, symbol, start, end) -> DataFrame:
    """As `ticks_in`, newest first."""
    return ticks_in(ticks, symbol, start, end).orderBy(F.desc("timestamp"))


def ticks_price_between(ticks: DataFrame, symbol, low, high) -> DataFrame:
    """One symbol at prices in [low, high], both ends included, newest first."""
    return filter_symbol(ticks, symbol).where(F.col("price").between(low, high)).orderBy(F.desc("timestamp"))


def top_k(df: DataFrame, by, k: int) -> DataFrame:
    """The first ``k`` rows in the order of the list ``by``."""
    return df.orderBy(*by).limit(k)


def big_movers_since(ticks: DataFrame, threshold, as_of, n=10, span="24 hours") -> DataFrame:
    """Largest percentage moves in the span before ``as_of``."""
    pct = F.abs(F.col("change_percent"))
    recent = ticks.where((pct >= threshold) & (F.col("timestamp") >= before(as_of, span)))
    return top_k(recent, [pct.desc(), F.desc("timestamp"), "symbol"], n)


def latest_for_symbols(ticks: DataFrame, symbols=None) -> DataFrame:
    """All rows at their symbol's newest time; ties are all returned."""
    wanted = ticks if symbols is None else filter_symbols(ticks, symbols)
    # Each input split gives its own newest rows of a symbol; Spark cuts at
    # the rank before the shuffle, so little travels, and many ties of one
    # symbol stay spread over the splits they come from.
    own = Window.partitionBy("symbol", "_split").orderBy(F.desc("timestamp"))
    candidates = (
        wanted.withColumn("_split", F.spark_partition_id())
        .withColumn("_rank", F.rank().over(own)).where("_rank = 1").drop("_rank", "_split")
    )
    newest = wanted.groupBy("symbol").agg(F.max("timestamp").alias("timestamp"))
    return candidates.join(newest, ["symbol", "timestamp"], "left_semi")


def latest_tick(ticks: DataFrame, symbol=None, order=("timestamp", "id")) -> DataFrame:
    """Exactly one newest row, of one symbol or of each."""
    if symbol is not None:
        return top_k(filter_symbol(ticks, symbol), [F.desc(c) for c in order], 1)
    return newest_rows(ticks, ["symbol"], order)


def stock_statistics(ticks: DataFrame, start, end, symbol=None) -> DataFrame:
    """Average, extremes, volume and count in [start, end]."""
    rows = ticks if symbol is None else filter_symbol(ticks, symbol)
    return (
        rows.where(F.col("timestamp").between(moment(start), moment(end)))
        .groupBy("symbol")
        .agg(
            (F.sum("price").cast("double") / F.count("price")).alias("avg_price"),
            F.min("price").alias("min_price"), F.max("price").alias("max_price"),
            F.sum("volume").alias("total_volume"), F.count(F.lit(1)).alias("data_points"))
    )


def trending_by_volume(ticks: DataFrame, as_of, n=10, span="24 hours") -> DataFrame:
    recent = ticks.where(F.col("timestamp") >= before(as_of, span))
    return top_k(recent.groupBy("symbol").agg(F.sum("volume").alias("total_volume")),
                 [F.desc("total_volume"), "symbol"], n)


def count_by_symbol(ticks: DataFrame, symbol=None) -> DataFrame:
    rows = ticks if symbol is None else filter_symbol(ticks, symbol)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("tick_count"))


def distinct_symbols(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol").distinct().orderBy("symbol")


def approx_symbol_count(ticks: DataFrame, rsd=0.01) -> DataFrame:
    """Number of symbols from a sketch, for tables with very many of them."""
    return ticks.agg(F.approx_count_distinct("symbol", rsd).alias("symbols"))


def database_stats(ticks: DataFrame) -> DataFrame:
    """One row per available symbol with its records, and one ``total`` row with the number of symbols and records."""
    per_symbol = ticks.groupBy("symbol").agg(F.count(F.lit(1)).alias("records"))
    totals = per_symbol.agg(F.count("symbol").alias("symbols"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    return per_symbol.select(F.lit("symbol").alias("kind"), "symbol", F.lit(1).cast("bigint").alias("symbols"), "records"
                             ).unionByName(totals.select(F.lit("total").alias("kind"),
                                                         F.lit(None).cast("string").alias("symbol"), "symbols", "records"))


def first_last_value(ticks: DataFrame, order=("timestamp", "id")) -> DataFrame:
    """Each tick with the first and last price of its symbol's day.

    The two values are aggregates joined back, so that a day of a hot symbol
    is never sorted in one task.
    """
    at = position(ticks, order)
    dated = ticks.withColumn("date", F.to_date("timestamp"))
    ends = dated.groupBy("symbol", "date").agg(
        F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"))
    return dated.join(ends, ["symbol", "date"], "left")


def tick_returns(ticks: DataFrame, order=("timestamp", "id"), width="1 minute") -> DataFrame:
    """Fill ``change`` and ``change_percent`` from the previous tick.

    Values the feed has given are kept.
    """
    given = {c: F.col(c) for c in ("change", "change_percent") if c in ticks.columns}
    prior = F.col("_prior.price")
    delta = F.col("price") - prior
    pct = F.try_divide(delta.cast("double"), prior.cast("double")) * 100
    filled = previous_row(ticks, ["symbol"], order, ["price"], width, out="_prior")
    change, change_percent = delta.cast("decimal(19,4)"), pct
    if "change" in given:
        change = F.coalesce(given["change"], change)
    if "change_percent" in given:
        change_percent = F.coalesce(given["change_percent"].cast("double"), pct)
    return filled.withColumns({"change": change, "change_percent": change_percent}).drop("_prior")


def page_of(df: DataFrame, by, page=0, size=20) -> DataFrame:
    """Rows of a 0-based page with the page's flags and totals on each row.

    The total comes from one partial aggregate; the page itself from a top-k.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*by).offset(page * size).limit(size).withColumn("total_elements", total)
    pages = F.ceil(F.col("total_elements") / F.lit(size)).cast("bigint")
    return rows.withColumns({
        "total_pages": pages,
        "first": F.lit(page == 0),
        "last": F.lit(page + 1) >= pages,
    })


def tick_page(ticks: DataFrame, symbol, page=0, size=20) -> DataFrame:
    return page_of(filter_symbol(ticks, symbol), [F.desc("timestamp"), F.desc("id")], page, size)


def tick_page_after(ticks: DataFrame, symbol, cursor_ts=None, cursor_id=None, size=20) -> DataFrame:
    """The next ``size`` ticks older than the cursor. Deep pages cost no more
    than the first, unlike offsets."""
    rows = filter_symbol(ticks, symbol)
    if cursor_ts is not None:
        at = moment(cursor_ts)
        rows = rows.where((F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("id") < cursor_id)))
    return top_k(rows, [F.desc("timestamp"), F.desc("id")], size)
