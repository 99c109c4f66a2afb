"""Named queries over the driver's tables, with the same question in SQL.

A query is registered with `query`; its SQL may use the views in `VIEWS`,
which are put in front as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"

# Lexicons that the invented prose of the documents does hit.
POSITIVE = ["tion", "ent", "que"]
NEGATIVE = ["sch", "ung", "der"]
KEYWORDS = ["tion", "sch", "ear"]
TICKERS = ["TION", "ENT", "QUE", "SCH", "UNG", "OUN", "EAR"]


def _count(text, words):
    return " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words)


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(values, index):
    return f"{_list(values)}[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_KINDS = ["PRICE_ABOVE", "PRICE_BELOW", "VOLUME_SPIKE", "NEWS_SENTIMENT"]
_CHANNELS = ["EMAIL", "SMS", "PUSH", "IN_APP"]

_ALERTS = f"""
    SELECT c_custkey AS id, c_custkey AS user_id, {{symbol}} AS symbol, {_pick(_KINDS, "c_custkey")} AS alert_type,
           CASE WHEN {_pick(_KINDS, "c_custkey")} = 'NEWS_SENTIMENT' THEN CAST(0.5 AS DECIMAL(19,4))
                ELSE CAST(abs(c_acctbal) / 10 AS DECIMAL(19,4)) END AS threshold_value,
           c_acctbal >= 0 AS enabled, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at
    FROM customer"""

VIEWS = {
    "ticks": """
    SELECT event_id AS id, event_type AS symbol, CAST(value AS DECIMAL(19,4)) AS price,
           CAST(round(value * 100) AS BIGINT) AS volume, ts AS timestamp, 'events' AS source FROM events""",
    "user_ticks": """
    SELECT event_id AS id, 'U' || user_id AS symbol, CAST(value AS DECIMAL(19,4)) AS price,
           CAST(round(value * 100) AS BIGINT) AS volume, ts AS timestamp, 'events' AS source FROM events""",
    "quoted": """
    SELECT *, CAST(price - lag(price) OVER w AS DECIMAL(19,4)) AS change,
           CAST(price - lag(price) OVER w AS DOUBLE) / nullif(CAST(lag(price) OVER w AS DOUBLE), 0) * 100 AS change_percent
    FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, id)""",
    "user_quoted": """
    SELECT *, CAST(price - lag(price) OVER w AS DECIMAL(19,4)) AS change,
           CAST(price - lag(price) OVER w AS DOUBLE) / nullif(CAST(lag(price) OVER w AS DOUBLE), 0) * 100 AS change_percent
    FROM user_ticks WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, id)""",
    "bars": """
    SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_extendedprice AS DECIMAL(19,4)) AS price,
           CAST(l_quantity AS BIGINT) AS volume, l_shipdate AS timestamp,
           row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS id
    FROM lineitem""",
    "news": """
    SELECT doc_id AS id, source || ':' || doc_id AS title, text AS content, 'doc/' || doc_id AS url,
           TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS timestamp, source, lang AS category,
           lower(source || ':' || doc_id || ' ' || text) AS lower_text,
           upper(source || ':' || doc_id || ' ' || text) AS upper_text
    FROM documents""",
    "counted": f"""
    SELECT *, {_count("lower_text", POSITIVE)} AS pos, {_count("lower_text", NEGATIVE)} AS neg,
           list_filter({_list(TICKERS)}, lambda x: contains(upper_text, x)) AS symbols
    FROM news""",
    "scored": """
    SELECT *, CASE WHEN pos + neg = 0 THEN 0.0::DOUBLE
                   ELSE CAST(pos - neg AS DOUBLE) / (pos + neg) END AS sentiment_score
    FROM counted""",
    "users": """
    SELECT c_custkey AS id, 'user' || c_custkey AS username, 'user' || c_custkey || '@example.com' AS email,
           c_mktsegment AS first_name, c_name AS last_name, CAST(NULL AS VARCHAR) AS phone_number,
           CASE WHEN c_acctbal < 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
           c_acctbal > 1000 AS email_verified,
           CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-02-01' END AS locked_until,
           TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at
    FROM customer""",
    "roles": """
    SELECT c_custkey AS user_id, 'USER' AS role FROM customer
    UNION ALL SELECT c_custkey, 'PREMIUM_USER' FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT c_custkey, 'ADMIN' FROM customer WHERE c_mktsegment = 'FURNITURE'""",
    "watchlist": f"""
    SELECT c_custkey AS user_id, {_pick(_EVENT_TYPES, "c_custkey")} AS symbol, TIMESTAMP '2024-01-01' AS added_at
    FROM customer
    UNION ALL SELECT c_custkey, {_pick(_EVENT_TYPES, "c_custkey + 2")}, TIMESTAMP '2024-01-01' FROM customer""",
    "alerts": _ALERTS.format(symbol=_pick(_EVENT_TYPES, "c_custkey")),
    "user_alerts": _ALERTS.format(symbol="'U' || (c_custkey // 10)"),
    "notifications": f"""
    SELECT o_orderkey AS id, o_custkey AS user_id, {_pick(_CHANNELS, "o_orderkey")} AS type,
           CASE WHEN o_orderstatus = 'F' THEN 'SENT' WHEN o_orderstatus = 'P' THEN 'FAILED'
                WHEN o_orderkey % 2 = 1 THEN 'SCHEDULED' ELSE 'PENDING' END AS status,
           o_orderpriority AS subject, o_orderstatus AS content, 'to' || o_custkey AS recipient,
           {_pick(_KINDS, "o_orderkey + 1")} AS alert_type, CAST(NULL AS VARCHAR) AS error_message,
           CAST(o_orderkey % 5 AS INTEGER) AS retry_count, 3 AS max_retries,
           o_orderdate + INTERVAL 1 DAY AS scheduled_at, CAST(NULL AS TIMESTAMP) AS sent_at,
           o_orderdate AS created_at
    FROM orders""",
    "observations": """
    SELECT o_orderkey AS id, o_orderpriority AS indicator, CAST(o_totalprice AS DECIMAL(19,4)) AS value,
           o_orderdate AS timestamp FROM orders""",
}
_NEEDS = {
    "quoted": ["ticks"], "user_quoted": ["user_ticks"], "counted": ["news"], "scored": ["counted"],
}


def with_views(sql: str, names) -> str:
    order: list[str] = []

    def need(name):
        for dep in _NEEDS.get(name, []):
            need(dep)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    sql = sql.strip()
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if re.match(r"WITH\b", sql):
        return f"WITH {ctes},\n{sql[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and arrays as text: types that two engines
    print alike."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def settled(column, digits=6):
    """An average to compare between engines: the noise of summing in another
    order goes first, then exact halves round up."""
    return F.round(F.round(column, 12).cast("decimal(18,12)"), digits)


def settled_sql(value: str, digits=6) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(18,12)), {digits}) AS DOUBLE)"


def query(name: str, sql: str = None, views=()):
    """Register a query and, if there is one, its SQL."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark, sf_dir):
            use_utc(spark)
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn
    return register
