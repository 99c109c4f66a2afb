"""Users, watchlists, alerts and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import alerts as R
from quotelake.operators import notifications as N
from quotelake.operators import quality as Q
from quotelake.operators import signals as G
from quotelake.operators import users as U
from quotelake.operators.windows import volume_anomalies
from quotelake.plans.catalog import AS_OF, KEYWORDS, query
from quotelake.plans.signal_queries import (
    NEWS_ALERTS_SQL, PRICE_ALERTS_SQL, VOLUME_ALERTS_SQL, quoted, scored_news)
from quotelake.sources import adapters as A

_NOTE = """id, user_id, type, status, subject, content, recipient, alert_type, error_message, retry_count, max_retries,
       scheduled_at, sent_at, created_at"""


@query("user_profiles", """
SELECT u.id AS user_id, u.username, u.email, u.status,
       array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, symbol
FROM users u LEFT JOIN roles r ON r.user_id = u.id LEFT JOIN watchlist w ON w.user_id = u.id
GROUP BY ALL""", ["users", "roles", "watchlist"])
def _(spark, d):
    p = U.user_profiles(A.users(spark, d), A.roles(spark, d), A.watchlist(spark, d))
    return p.select("user_id", "username", "email", "status", "roles", "symbol")


@query("unlocked_users", f"""
SELECT u.id, u.username, first_name || ' ' || last_name AS full_name FROM users u
WHERE (locked_until IS NULL OR locked_until < TIMESTAMP '{AS_OF}') AND email_verified
  AND EXISTS (SELECT 1 FROM roles r WHERE r.user_id = u.id AND r.role = 'PREMIUM_USER')""", ["users", "roles"])
def _(spark, d):
    out = U.unlocked_users(A.users(spark, d), AS_OF, verified=True, role="PREMIUM_USER", roles=A.roles(spark, d))
    return out.select("id", "username", "full_name")


@query("watchlist_quotes", """
SELECT user_id, w.symbol, added_at, CAST(price AS DOUBLE) AS latest_price, CAST(change AS DOUBLE) AS change,
       change_percent
FROM watchlist w LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, id DESC) AS rn FROM quoted)
  WHERE rn = 1) q ON q.symbol = w.symbol""", ["watchlist", "quoted"])
def _(spark, d):
    return U.watchlist_quotes(A.watchlist(spark, d), quoted(spark, d))


@query("daily_digest", """
WITH bar AS (
  SELECT symbol, arg_min(price, (timestamp, id)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (timestamp, id)) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM ticks WHERE CAST(timestamp AS DATE) = DATE '2024-01-15' GROUP BY symbol)
SELECT w.user_id, u.email, u.first_name, 'Daily Market Digest - 2024-01-15' AS subject, w.symbol,
       CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low,
       CAST(close AS DOUBLE) AS close, volume,
       CAST(close - open AS DOUBLE) / nullif(CAST(open AS DOUBLE), 0) * 100 AS change_percent
FROM watchlist w JOIN bar b ON b.symbol = w.symbol JOIN users u ON u.id = w.user_id
""", ["ticks", "watchlist", "users"])
def _(spark, d):
    return U.daily_digest(A.users(spark, d), A.watchlist(spark, d), A.ticks(spark, d), "2024-01-15 00:00:00")


_SUBSCRIBED = """subscribed AS (
  SELECT a.id AS alert_id, a.user_id, a.symbol, a.alert_type, a.threshold_value, u.email
  FROM {alerts} a JOIN users u ON u.id = a.user_id WHERE a.enabled)"""


ROUTE_ALERTS_SQL = f"""
WITH {_SUBSCRIBED.format(alerts="user_alerts")}
SELECT s.user_id, s.email, s.alert_id, s.symbol, s.alert_type, CAST(s.threshold_value AS DOUBLE) AS threshold_value,
       t.id AS event_id, CAST(t.price AS DOUBLE) AS price, t.volume, CAST(NULL AS DOUBLE) AS sentiment_score,
       t.timestamp
FROM user_ticks t JOIN subscribed s ON s.symbol = t.symbol
WHERE CASE s.alert_type WHEN 'PRICE_ABOVE' THEN t.price >= s.threshold_value
                        WHEN 'PRICE_BELOW' THEN t.price <= s.threshold_value
                        WHEN 'VOLUME_SPIKE' THEN t.volume >= s.threshold_value ELSE false END
"""


@query("route_alerts", ROUTE_ALERTS_SQL, ["user_ticks", "user_alerts", "users"])
def _(spark, d):
    return R.route_alerts(A.user_ticks(spark, d), A.user_alerts(spark, d), A.users(spark, d))


@query("route_alerts_per_day", f"""
WITH {_SUBSCRIBED.format(alerts="alerts")}, day AS (
  SELECT symbol, time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, max(price) AS hi, min(price) AS lo,
         max(volume) AS vol FROM ticks GROUP BY ALL)
SELECT s.user_id, s.email, s.alert_id, s.symbol, s.alert_type, CAST(s.threshold_value AS DOUBLE) AS threshold_value,
       window_start, CAST(CASE s.alert_type WHEN 'PRICE_ABOVE' THEN hi WHEN 'PRICE_BELOW' THEN lo ELSE vol END AS DOUBLE)
           AS value
FROM day t JOIN subscribed s ON s.symbol = t.symbol
WHERE CASE s.alert_type WHEN 'PRICE_ABOVE' THEN hi >= s.threshold_value
                        WHEN 'PRICE_BELOW' THEN lo <= s.threshold_value
                        WHEN 'VOLUME_SPIKE' THEN vol >= s.threshold_value ELSE false END
""", ["ticks", "alerts", "users"])
def _(spark, d):
    return R.route_alerts_per(A.ticks(spark, d), A.alerts(spark, d), A.users(spark, d))


# Companies: five articles and seven customers each.
_COMPANY_NEWS = f"""{NEWS_ALERTS_SQL},
company_news AS (SELECT id, headline, summary, url, 'S' || (id // 5) AS symbol, sentiment_score, alert_type, timestamp
                 FROM news_alerts)"""


@query("route_news_alerts", f"""
WITH {_COMPANY_NEWS}, audience AS (
  SELECT c_custkey AS user_id, 'S' || (c_custkey // 7) AS symbol, CAST(NULL AS DOUBLE) AS needs FROM customer
  WHERE c_acctbal < 5000
  UNION ALL
  SELECT id, 'S' || (id // 7), CAST(threshold_value AS DOUBLE) FROM alerts
  WHERE enabled AND alert_type = 'NEWS_SENTIMENT'),
pairs AS (SELECT DISTINCT user_id, n.id AS news_id FROM company_news n JOIN audience a ON a.symbol = n.symbol
          WHERE needs IS NULL OR abs(sentiment_score) >= needs)
SELECT user_id, email, news_id, headline, summary, url, symbol AS affected_symbols, sentiment_score, alert_type,
       n.timestamp
FROM pairs p JOIN company_news n ON n.id = p.news_id JOIN users u ON u.id = p.user_id
""", ["scored", "alerts", "users"])
def _(spark, d):
    news = G.news_alerts(scored_news(spark, d), KEYWORDS).withColumn(
        "affected_symbols", F.array(F.concat(F.lit("S"), F.floor(F.col("id") / 5).cast("string"))))
    own = F.concat(F.lit("S"), F.floor(F.col("user_id") / 7).cast("string"))
    customers = A.table(spark, d, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("user_id"))
    return R.route_news_alerts(
        news, customers.withColumn("symbol", own), A.alerts(spark, d).withColumn("symbol", own), A.users(spark, d))


def _preferences(spark, d):
    c = A.table(spark, d, "customer")
    return c.where("c_mktsegment <> 'HOUSEHOLD'").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("email_enabled"),
        (F.col("c_acctbal") > 5000).alias("sms_enabled"), F.lit(None).cast("boolean").alias("push_enabled"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("PRICE_ABOVE"), F.lit("VOLUME_SPIKE")))
        .alias("alert_types"))


@query("apply_preferences", f"""
SELECT {", ".join("n." + c.strip() for c in _NOTE.split(","))}
FROM notifications n LEFT JOIN customer c ON c.c_custkey = n.user_id AND c.c_mktsegment <> 'HOUSEHOLD'
WHERE coalesce(CASE n.type WHEN 'EMAIL' THEN c_acctbal > 0 WHEN 'SMS' THEN c_acctbal > 5000 END, true)
  AND NOT (coalesce(c_mktsegment, '') = 'BUILDING' AND n.alert_type NOT IN ('PRICE_ABOVE', 'VOLUME_SPIKE'))
""", ["notifications"])
def _(spark, d):
    return R.apply_preferences(A.notifications(spark, d), _preferences(spark, d))


@query("news_with_symbols", """
SELECT id, title, source, s.symbol FROM counted
LEFT JOIN (SELECT id, unnest(symbols) AS symbol FROM counted) s USING (id)""", ["counted"])
def _(spark, d):
    news = scored_news(spark, d)
    child = news.select(F.col("id").alias("news_id"), F.explode("symbols").alias("symbol"))
    return U.news_with_symbols(A.news(spark, d), child).select("id", "title", "source", "symbol")


# Orders as changes to a watchlist: P removes the symbol of the order's number, the others add it, in the order of
# their days.
_WATCH_CHANGES = """changes AS (SELECT o_custkey AS user_id,
  upper(['click', 'error', 'purchase', 'signup', 'view'][CAST(o_orderkey % 5 AS INTEGER) + 1]) AS symbol,
  o_orderstatus <> 'P' AS adds, o_orderdate AS added_at, o_orderkey AS seq FROM orders),
gone AS (SELECT user_id, symbol, max((added_at, seq)) AS at FROM changes WHERE NOT adds GROUP BY user_id, symbol)"""


@query("update_watchlist", f"""
WITH {_WATCH_CHANGES}
SELECT user_id, symbol, min(added_at) AS added_at FROM (
  SELECT user_id, upper(symbol) AS symbol, added_at FROM watchlist
  WHERE (user_id, upper(symbol)) NOT IN (SELECT (user_id, symbol) FROM gone)
  UNION ALL
  SELECT c.user_id, c.symbol, added_at FROM changes c LEFT JOIN gone g ON g.user_id = c.user_id AND g.symbol = c.symbol
  WHERE adds AND (g.at IS NULL OR (added_at, seq) > g.at))
GROUP BY user_id, symbol""", ["watchlist"])
def _(spark, d):
    o = A.table(spark, d, "orders")
    changes = o.select(
        F.col("o_custkey").alias("user_id"), A.pick(A.EVENT_TYPES, F.col("o_orderkey")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "P", "R").otherwise("A").alias("op"), F.col("o_orderdate").alias("added_at"),
        F.col("o_orderkey").alias("seq"))
    return U.update_watchlist(A.watchlist(spark, d), changes)


@query("update_roles", """
WITH changes AS (
  SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ADMIN' ELSE 'PREMIUM_USER' END AS role,
         o_orderstatus <> 'P' AS adds, o_orderdate AS changed_at, o_orderkey AS seq
  FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'),
gone AS (SELECT user_id, role, max((changed_at, seq)) AS last FROM changes WHERE NOT adds GROUP BY user_id, role)
SELECT DISTINCT user_id, role FROM (
  SELECT user_id, role FROM (SELECT user_id, role FROM roles UNION ALL SELECT s_suppkey + 1000000, 'USER' FROM supplier)
  WHERE (user_id, role) NOT IN (SELECT (user_id, role) FROM gone)
  UNION ALL
  SELECT c.user_id, c.role FROM changes c LEFT JOIN gone g ON g.user_id = c.user_id AND g.role = c.role
  WHERE adds AND (g.last IS NULL OR (changed_at, seq) > g.last))
""", ["roles"])
def _(spark, d):
    removal = F.col("o_orderstatus") == "P"
    changes = A.table(spark, d, "orders").where(removal | (F.col("o_orderpriority") == "1-URGENT")).select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "ADMIN").otherwise("PREMIUM_USER").alias("role"),
        F.when(removal, "R").otherwise("A").alias("op"), F.col("o_orderdate").alias("changed_at"),
        F.col("o_orderkey").alias("seq"))
    new = A.table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"))
    return U.update_roles(A.roles(spark, d), changes, new)


# Orders as changes to alerts: F changes the threshold, O switches off, P deletes; the customer's number plus
# half the order's is the alert's id, so that some changes create.
_ALERT_CHANGES = """changes AS (
  SELECT o_custkey * 2 AS id, CASE WHEN o_orderstatus = 'P' THEN 'D' ELSE 'U' END AS op,
         o_custkey AS user_id, 'view' AS symbol, 'PRICE_ABOVE' AS alert_type,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(19,4)) END AS threshold_value,
         CASE WHEN o_orderstatus = 'O' THEN false END AS enabled, o_orderdate AS changed_at, o_orderkey AS seq
  FROM orders)"""


@query("update_alerts", f"""
WITH {_ALERT_CHANGES}, gone AS (SELECT id, max((changed_at, seq)) AS last FROM changes WHERE op = 'D' GROUP BY id),
later AS (SELECT c.* FROM changes c LEFT JOIN gone g ON g.id = c.id
          WHERE op <> 'D' AND (g.last IS NULL OR (changed_at, seq) > g.last)),
newest AS (
  SELECT id, max(changed_at) AS at, min(changed_at) AS born,
         arg_max(user_id, (changed_at, seq)) AS user_id, arg_max(symbol, (changed_at, seq)) AS symbol,
         arg_max(alert_type, (changed_at, seq)) AS alert_type,
         arg_max(threshold_value, (changed_at, seq)) FILTER (threshold_value IS NOT NULL) AS threshold_value,
         arg_max(enabled, (changed_at, seq)) FILTER (enabled IS NOT NULL) AS enabled
  FROM later GROUP BY id)
SELECT coalesce(a.id, n.id) AS id, coalesce(n.user_id, a.user_id) AS user_id, coalesce(n.symbol, a.symbol) AS symbol,
       coalesce(n.alert_type, a.alert_type) AS alert_type,
       CAST(coalesce(n.threshold_value, a.threshold_value) AS DOUBLE) AS threshold_value,
       coalesce(n.enabled, a.enabled) AS enabled, coalesce(a.created_at, n.born) AS created_at,
       coalesce(n.at, a.updated_at) AS updated_at
FROM (SELECT * FROM alerts WHERE id NOT IN (SELECT id FROM gone)) a FULL OUTER JOIN newest n ON n.id = a.id""", ["alerts"])
def _(spark, d):
    o, s = A.table(spark, d, "orders"), F.col("o_orderstatus")
    changes = o.select(
        (F.col("o_custkey") * 2).alias("id"), F.when(s == "P", "D").otherwise("U").alias("op"),
        F.col("o_custkey").alias("user_id"), F.lit("view").alias("symbol"), F.lit("PRICE_ABOVE").alias("alert_type"),
        F.when(s == "F", F.col("o_totalprice").cast("decimal(19,4)")).alias("threshold_value"),
        F.when(s == "O", F.lit(False)).alias("enabled"),
        F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("seq"))
    return U.update_alerts(A.alerts(spark, d), changes)


@query("update_profiles", """
WITH changes AS (
  SELECT o_custkey + 50 AS id, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS first_name,
         CASE WHEN o_orderstatus = 'O' THEN 'tel ' || o_orderkey END AS phone_number, o_orderdate AS moment, o_orderkey AS seq
  FROM orders),
newest AS (
  SELECT id, max(moment) AS moment, arg_max(first_name, (moment, seq)) FILTER (first_name IS NOT NULL) AS first_name,
         arg_max(phone_number, (moment, seq)) FILTER (phone_number IS NOT NULL) AS phone_number
  FROM changes GROUP BY id)
SELECT u.id, u.username, coalesce(n.first_name, u.first_name) AS first_name, u.last_name,
       coalesce(n.phone_number, u.phone_number) AS phone_number, coalesce(n.moment, u.updated_at) AS updated_at
FROM users u LEFT JOIN newest n ON n.id = u.id""", ["users"])
def _(spark, d):
    o, s = A.table(spark, d, "orders"), F.col("o_orderstatus")
    changes = o.select(
        (F.col("o_custkey") + 50).alias("id"), F.when(s != "O", F.col("o_orderpriority")).alias("first_name"),
        F.lit(None).cast("string").alias("last_name"),
        F.when(s == "O", F.concat(F.lit("tel "), F.col("o_orderkey").cast("string"))).alias("phone_number"),
        F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("seq"))
    return U.update_profiles(A.users(spark, d), changes).select(
        "id", "username", "first_name", "last_name", "phone_number", "updated_at")


@query("notifications_by", f"""
SELECT {_NOTE} FROM notifications WHERE status = 'SENT' AND type = 'EMAIL'""", ["notifications"])
def _(spark, d):
    return N.notifications_by(A.notifications(spark, d), "SENT", "EMAIL")


@query("retryable_notifications", f"""
SELECT {_NOTE} FROM notifications WHERE status = 'FAILED' AND retry_count < max_retries""", ["notifications"])
def _(spark, d):
    return N.retryable_notifications(A.notifications(spark, d))


@query("requeue_failed", f"""
SELECT * REPLACE ('PENDING' AS status, retry_count + 1 AS retry_count,
                  TIMESTAMP '{AS_OF}' + least(60 * CAST(2 ** retry_count AS BIGINT), 600) * INTERVAL 1 SECOND AS scheduled_at)
FROM (SELECT {_NOTE} FROM notifications WHERE status = 'FAILED' AND retry_count < max_retries)""", ["notifications"])
def _(spark, d):
    return N.requeue_failed(A.notifications(spark, d), AS_OF, backoff=True)


@query("due_notifications", f"""
SELECT {_NOTE} FROM notifications WHERE status = 'SCHEDULED' AND scheduled_at <= TIMESTAMP '1999-06-01'
""", ["notifications"])
def _(spark, d):
    return N.due_notifications(A.notifications(spark, d), "1999-06-01 00:00:00")


@query("release_due", f"""
SELECT * REPLACE ('PENDING' AS status) FROM (
  SELECT {_NOTE} FROM notifications WHERE status = 'SCHEDULED' AND scheduled_at <= TIMESTAMP '1999-06-01')
""", ["notifications"])
def _(spark, d):
    return N.release_due(A.notifications(spark, d), "1999-06-01 00:00:00")


@query("recent_notifications", f"""
SELECT {_NOTE} FROM notifications WHERE user_id = 7 AND created_at >= TIMESTAMP '2001-08-01' - INTERVAL 3000 DAY
ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 2""", ["notifications"])
def _(spark, d):
    page = N.recent_notifications(A.notifications(spark, d), 7, "2001-08-01 00:00:00", "3000 days", 0, 7)
    return page.offset(2)


@query("notification_page", f"""
SELECT {_NOTE}, count(*) OVER () AS total_elements, CAST(ceil(count(*) OVER () / 3.0) AS BIGINT) AS total_pages,
       true AS first, 1 >= ceil(count(*) OVER () / 3.0) AS last
FROM notifications WHERE user_id = 7 AND status = 'FAILED'
ORDER BY created_at DESC, id DESC LIMIT 3""", ["notifications"])
def _(spark, d):
    return N.notification_page(A.notifications(spark, d), 7, 0, 3, "FAILED")


@query("notification_stats", """
SELECT count(*) AS total_notifications, count(*) FILTER (status = 'SENT') AS sent_notifications,
       count(*) FILTER (status = 'FAILED') AS failed_notifications,
       count(*) FILTER (status = 'PENDING') AS pending_notifications FROM notifications""", ["notifications"])
def _(spark, d):
    return N.notification_stats(A.notifications(spark, d))


@query("count_user_status", """
SELECT user_id, status, count(*) AS notifications FROM notifications GROUP BY user_id, status""", ["notifications"])
def _(spark, d):
    return N.count_user_status(A.notifications(spark, d))


@query("route_recipient", """
SELECT id, CASE WHEN type = 'EMAIL' THEN recipient END AS recipient_email,
       CASE WHEN type = 'SMS' THEN recipient END AS recipient_phone,
       CASE WHEN type = 'PUSH' THEN recipient END AS recipient_device_token FROM notifications""", ["notifications"])
def _(spark, d):
    return N.route_recipient(A.notifications(spark, d)).select(
        "id", "recipient_email", "recipient_phone", "recipient_device_token")


# The outcome of order n is the sign of its customer's balance; customers of one segment have none yet.
@query("apply_delivery_results", f"""
SELECT n.id, n.type,
       CASE WHEN n.status <> 'PENDING' THEN n.status WHEN n.type <> 'EMAIL' THEN 'FAILED'
            WHEN o.ok THEN 'SENT' WHEN NOT o.ok THEN 'FAILED' ELSE n.status END AS status,
       CASE WHEN n.status = 'PENDING' AND n.type = 'EMAIL' AND o.ok THEN TIMESTAMP '{AS_OF}' END AS sent_at,
       CASE WHEN n.status = 'PENDING' AND n.type <> 'EMAIL' THEN 'Failed to send notification'
            WHEN n.status = 'PENDING' AND NOT o.ok THEN 'Failed to send email' END AS error_message
FROM notifications n LEFT JOIN (
  SELECT o_orderkey AS id, c_acctbal > 3000 AS ok FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE c_mktsegment <> 'AUTOMOBILE') o ON o.id = n.id AND n.type = 'EMAIL'""", ["notifications"])
def _(spark, d):
    c = A.table(spark, d, "customer").where("c_mktsegment <> 'AUTOMOBILE'")
    o = A.table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("id"), (F.col("c_acctbal") > 3000).alias("delivered"),
        F.lit(None).cast("string").alias("error"), F.lit(AS_OF).cast("timestamp_ntz").alias("finished_at"))
    n = A.notifications(spark, d)
    mails = n.where("type = 'EMAIL'").select("id")
    return N.apply_delivery_results(n, o.join(mails, "id", "left_semi")).select(
        "id", "type", "status", "sent_at", "error_message")


def _routed(spark, d):
    """Stock alerts of the busy symbols, one recipient per alert: the user who caused the event."""
    q = A.quoted(A.user_ticks(spark, d))
    both = G.all_stock_alerts(G.price_change_alerts(q), volume_anomalies(q, "1 day"))
    uid = F.regexp_replace("symbol", "^U", "").cast("bigint")
    return both.withColumns({
        "user_id": uid, "email": F.concat(F.lit("user"), uid.cast("string"), F.lit("@example.com"))})


_ROW = """CAST(substr(symbol, 2) AS BIGINT) AS user_id, 'EMAIL' AS type, 'PENDING' AS status, {subject} AS subject,
  {content} AS content, 'user' || substr(symbol, 2) || '@example.com' AS recipient_email, '{template}' AS template_name,
  0 AS retry_count, 3 AS max_retries, timestamp AS created_at"""
_USER_ALERTS_SQL = (PRICE_ALERTS_SQL + ", " + VOLUME_ALERTS_SQL).replace("FROM quoted", "FROM user_quoted").replace(
    "INTERVAL 1 HOUR", "INTERVAL 1 DAY")


@query("notify_stock_alert", f"""
WITH {_USER_ALERTS_SQL}
SELECT {_ROW.format(subject="'Stock Alert: ' || symbol || ' - ' || alert_type",
                    content="'Alert for ' || symbol || ': ' || alert_type", template="stock-alert")},
       symbol AS data_symbol, alert_type AS data_type, CAST(volume AS VARCHAR) AS data_volume
FROM (SELECT * FROM price_alerts UNION ALL SELECT * FROM volume_alerts)""", ["user_quoted"])
def _(spark, d):
    rows = N.notify_stock_alert(_routed(spark, d))
    data = F.col("template_data")
    return rows.withColumns({
        "data_symbol": F.get_json_object(data, "$.symbol"), "data_type": F.get_json_object(data, "$.alertType"),
        "data_volume": F.get_json_object(data, "$.volume")}).drop("template_data")


@query("notify_price_alert", f"""
WITH {_USER_ALERTS_SQL}
SELECT {_ROW.format(
    subject='''\'Price Alert: \' || symbol || CASE WHEN change_percent > 0 THEN \' Price Increase \' ELSE
       \' Price Decrease \' END || CAST(CAST(round(CAST(round(abs(change_percent), 4) AS DECIMAL(28,4)), 2) AS DECIMAL(18,2)) AS VARCHAR)
       || \'%\'''',
    content="'Price change alert for ' || symbol", template="price-change-alert")},
       symbol AS data_symbol FROM price_alerts""", ["user_quoted"])
def _(spark, d):
    # a percentage has four places in the feed and in the tables
    a = _routed(spark, d).where("alert_type <> 'HIGH_VOLUME'").withColumns({
        "change_percent": F.round("change_percent", 4),
        "old_price": F.col("previous_price").cast("double"), "new_price": F.col("current_price").cast("double")})
    rows = N.notify_price_alert(a)
    return rows.withColumn("data_symbol", F.get_json_object("template_data", "$.symbol")).drop("template_data")


@query("notify_volume_alert", f"""
WITH {_USER_ALERTS_SQL}, mean AS (
  SELECT symbol, CAST(sum(volume) // count(*) AS BIGINT) AS average_volume FROM user_ticks GROUP BY symbol)
SELECT {_ROW.format(
    subject='''\'Volume Alert: \' || symbol || \' - Unusual Volume (\' ||
       CAST(CAST(round(CAST(CAST(volume AS DOUBLE) / average_volume AS DECIMAL(38,16)), 1) AS DECIMAL(18,1)) AS VARCHAR)
       || \'x normal)\'''',
    content="'Volume alert for ' || symbol", template="volume-alert")}
FROM (SELECT v.*, average_volume FROM volume_alerts v JOIN mean m ON m.symbol = v.symbol)""", ["user_quoted"])
def _(spark, d):
    mean = A.user_ticks(spark, d).groupBy("symbol").agg(F.expr("sum(volume) div count(*)").alias("average_volume"))
    a = _routed(spark, d).where("alert_type = 'HIGH_VOLUME'").join(mean, "symbol")
    return N.notify_volume_alert(a).drop("template_data")


@query("notify_news_alert", f"""
WITH {NEWS_ALERTS_SQL}
SELECT id % 10 AS user_id, 'EMAIL' AS type, 'PENDING' AS status, 'News Alert: ' || headline AS subject,
       summary AS content, 'reader@example.com' AS recipient_email, 'news-alert' AS template_name,
       0 AS retry_count, 3 AS max_retries, timestamp AS created_at, url AS data_url, summary AS data_summary
FROM news_alerts""", ["scored"])
def _(spark, d):
    n = G.news_alerts(scored_news(spark, d), KEYWORDS).withColumns({
        "user_id": F.col("id") % 10, "email": F.lit("reader@example.com")})
    rows = N.notify_news_alert(n)
    return rows.withColumns({
        "data_url": F.get_json_object("template_data", "$.url"),
        "data_summary": F.get_json_object("template_data", "$.summary")}).drop("template_data")


_ACCOUNT_ROW = f"""id AS user_id, 'EMAIL' AS type, 'PENDING' AS status, '{{subject}}' AS subject,
  '{{subject}}' AS content, email AS recipient_email, '{{template}}' AS template_name, 0 AS retry_count,
  3 AS max_retries, TIMESTAMP '{AS_OF}' AS created_at, first_name AS data_name"""


@query("account_rows", f"""
SELECT {_ACCOUNT_ROW.format(subject="Welcome to Quotelake!", template="welcome")} FROM users
UNION ALL
SELECT {_ACCOUNT_ROW.format(subject="Password Reset Request", template="password-reset")} FROM users
WHERE status = 'SUSPENDED'""", ["users"])
def _(spark, d):
    u = A.users(spark, d).withColumns({
        "activation_link": F.concat(F.lit("a/"), "username"), "reset_link": F.concat(F.lit("r/"), "username")})
    rows = N.welcome_rows(u, "Quotelake", AS_OF).unionByName(
        N.password_reset_rows(u.where("status = 'SUSPENDED'"), "Quotelake", AS_OF))
    return rows.withColumn("data_name", F.get_json_object("template_data", "$.firstName")).drop("template_data")


@query("digest_rows", f"""
WITH watched AS (SELECT DISTINCT user_id, symbol FROM watchlist
                 WHERE symbol IN (SELECT symbol FROM ticks WHERE CAST(timestamp AS DATE) = DATE '2024-01-15'))
SELECT user_id, 'EMAIL' AS type, 'PENDING' AS status, 'Daily Market Digest - 2024-01-15' AS subject,
       'Daily Market Digest - 2024-01-15' AS content, email AS recipient_email, 'daily-digest' AS template_name,
       0 AS retry_count, 3 AS max_retries, TIMESTAMP '{AS_OF}' AS created_at, CAST(count(*) AS VARCHAR) AS data_lines
FROM watched w JOIN users u ON u.id = w.user_id GROUP BY user_id, email""", ["ticks", "watchlist", "users"])
def _(spark, d):
    digest = U.daily_digest(A.users(spark, d), A.watchlist(spark, d), A.ticks(spark, d), "2024-01-15 00:00:00")
    rows = N.digest_rows(digest, "Quotelake", AS_OF)
    return rows.withColumn("data_lines", F.get_json_object("template_data", "$.lines")).drop("template_data")


# Rules

@query("validate_records", """
SELECT id, concat_ws(',', CASE WHEN NOT price BETWEEN 0.01 AND 100000 THEN 'price is out of range' END,
                     CASE WHEN volume < 0 THEN 'volume is negative' END) AS violations FROM bars_ids""".replace(
    "bars_ids", """(SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(19,4)) AS price,
                    CAST(o_totalprice - 200000 AS BIGINT) AS volume FROM orders)"""))
def _(spark, d):
    o = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"),
        F.col("o_totalprice").cast("decimal(19,4)").alias("price"),
        F.round(F.col("o_totalprice") - 200000).cast("bigint").alias("volume"), F.col("o_orderdate").alias("timestamp"))
    return Q.validate_records(o, "stock").select("id", "violations")


@query("validate_news", """
SELECT id, concat_ws(',', CASE WHEN length(content) > 10000 THEN 'content is too long' END) AS violations
FROM news""", ["news"])
def _(spark, d):
    return Q.validate_records(A.news(spark, d), "news").select("id", "violations")


@query("check_constraints", """
SELECT id, CASE WHEN length(source) > 100 THEN 'source is longer than 100' ELSE '' END AS violations FROM news
UNION ALL
SELECT -id - 1, CASE WHEN status NOT IN ('PENDING', 'SENT', 'FAILED', 'CANCELLED') THEN 'status is not a known value'
                     ELSE '' END
FROM (SELECT id, CASE WHEN status = 'SCHEDULED' THEN 'LATER' ELSE status END AS status FROM notifications)
""", ["news", "notifications"])
def _(spark, d):
    n = A.notifications(spark, d)
    late = n.withColumns({
        "status": F.when(F.col("status") == "SCHEDULED", "LATER").otherwise(F.col("status")),
        **{c: F.lit(None).cast("string") for c in
           ("recipient_email", "recipient_phone", "recipient_device_token", "template_name")}})
    return Q.check_constraints(A.news(spark, d), "news_data").select("id", "violations").unionByName(
        Q.check_constraints(late, "notifications").select((-F.col("id") - 1).alias("id"), "violations"))


@query("check_unique_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, d):
    return Q.check_unique_keys(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_foreign_keys", """
SELECT o_orderkey AS id, o_custkey AS user_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    good = A.users(spark, d).where("status = 'ACTIVE'")
    return Q.check_foreign_keys(o, good, "user_id")


@query("cascade_delete", """
SELECT user_id, symbol, added_at FROM watchlist
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""", ["watchlist"])
def _(spark, d):
    return Q.cascade_delete(A.watchlist(spark, d), A.users(spark, d).where("status = 'ACTIVE'"), "user_id")
