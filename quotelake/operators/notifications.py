"""Notification rows: building, selecting, delivering, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions.timefn import before, moment
from quotelake.operators.history import page_of

MAX_RETRIES = 3
SEND_FAILED = "Failed to send notification"
EMAIL_FAILED = "Failed to send email"


def _camel(name):
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def template_json(df: DataFrame, names) -> Column:
    """The named columns as a JSON object with camelCase keys."""
    return F.to_json(F.struct(*[F.col(n).alias(_camel(n)) for n in names if n in df.columns]))


def _rows(df, subject, content, template, data, created_at=None, email="email"):
    return df.select(
        "user_id", F.lit("EMAIL").alias("type"), F.lit("PENDING").alias("status"),
        subject.alias("subject"), content.alias("content"), F.col(email).alias("recipient_email"),
        F.lit(template).alias("template_name"), data.alias("template_data"),
        F.lit(0).alias("retry_count"), F.lit(MAX_RETRIES).alias("max_retries"),
        (F.col("timestamp") if created_at is None else moment(created_at)).alias("created_at"),
    )


def notify_stock_alert(alerts: DataFrame, created_at=None) -> DataFrame:
    data = template_json(alerts, [
        "user_id", "email", "symbol", "alert_type", "event_type", "current_price", "previous_price", "price",
        "change_percent", "volume"])
    return _rows(
        alerts, F.concat(F.lit("Stock Alert: "), "symbol", F.lit(" - "), "alert_type"),
        F.concat(F.lit("Alert for "), "symbol", F.lit(": "), "alert_type"), "stock-alert", data, created_at)


def notify_price_alert(alerts: DataFrame, created_at=None) -> DataFrame:
    pct = F.col("change_percent").cast("double")
    direction = F.when(pct > 0, "Price Increase").otherwise("Price Decrease")
    data = template_json(alerts, ["user_id", "email", "symbol", "old_price", "new_price", "change_percent"])
    return _rows(
        alerts, F.format_string("Price Alert: %s %s %.2f%%", F.col("symbol"), direction, F.abs(pct)),
        F.concat(F.lit("Price change alert for "), "symbol"), "price-change-alert", data, created_at)


def notify_news_alert(alerts: DataFrame, created_at=None) -> DataFrame:
    data = template_json(alerts, ["user_id", "email", "headline", "summary", "url"])
    return _rows(alerts, F.concat(F.lit("News Alert: "), "headline"), F.col("summary"), "news-alert", data, created_at)


def notify_volume_alert(alerts: DataFrame, created_at=None) -> DataFrame:
    ratio = F.try_divide(F.col("volume").cast("double"), F.col("average_volume").cast("double"))
    a = alerts.withColumn("volume_ratio", ratio)
    data = template_json(a, ["user_id", "email", "symbol", "volume", "average_volume", "volume_ratio"])
    return _rows(
        a, F.format_string("Volume Alert: %s - Unusual Volume (%.1fx normal)", "symbol", "volume_ratio"),
        F.concat(F.lit("Volume alert for "), "symbol"), "volume-alert", data, created_at)


def _user_rows(users, subject, template, names, created_at):
    u = users.withColumnRenamed("id", "user_id")
    return _rows(u, subject, subject, template, template_json(u, names), created_at)


def welcome_rows(users: DataFrame, company: str, created_at) -> DataFrame:
    """``users`` has id, email, first_name and activation_link."""
    u = users.withColumn("company_name", F.lit(company))
    return _user_rows(u, F.format_string("Welcome to %s!", "company_name"), "welcome",
                      ["first_name", "activation_link", "company_name"], created_at)


def password_reset_rows(users: DataFrame, company: str, created_at) -> DataFrame:
    """``users`` has id, email, first_name and reset_link."""
    u = users.withColumn("company_name", F.lit(company))
    return _user_rows(u, F.lit("Password Reset Request"), "password-reset",
                      ["first_name", "reset_link", "company_name"], created_at)


def digest_rows(digest: DataFrame, company: str, created_at) -> DataFrame:
    """One notification per user of `daily_digest`; its lines stay a table."""
    heads = digest.groupBy("user_id", "email", "first_name", "subject").agg(F.count(F.lit(1)).alias("lines"))
    h = heads.withColumn("company_name", F.lit(company))
    return _rows(h, F.col("subject"), F.col("subject"), "daily-digest",
                 template_json(h, ["first_name", "lines", "company_name"]), created_at)


def route_recipient(notifications: DataFrame, recipient="recipient") -> DataFrame:
    """Put the recipient into the column of the notification's channel."""
    targets = {"recipient_email": "EMAIL", "recipient_phone": "SMS", "recipient_device_token": "PUSH"}
    return notifications.withColumns({
        column: F.when(F.col("type") == kind, F.col(recipient)) for column, kind in targets.items()})


def apply_delivery_results(notifications: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pending rows become SENT or FAILED.

    ``outcomes`` has one row (id, delivered, error, finished_at) per attempted
    e-mail. Other channels have no sender and always fail; an e-mail without
    an outcome stays pending.
    """
    o = outcomes.select("id", "delivered", "error", "finished_at")
    pending = F.col("status") == "PENDING"
    is_mail = F.col("type") == "EMAIL"
    sent = pending & is_mail & F.coalesce("delivered", F.lit(False))
    failed = pending & (~is_mail | (F.col("delivered") == False))  # noqa: E712
    failed = F.coalesce(failed, F.lit(False))
    marked = notifications.join(o, "id", "left").withColumns({"_sent": sent, "_failed": failed})
    message = F.coalesce("error", F.when(is_mail, EMAIL_FAILED).otherwise(SEND_FAILED))
    return marked.withColumns({
        "status": F.when(F.col("_sent"), "SENT").when(F.col("_failed"), "FAILED").otherwise(F.col("status")),
        "sent_at": F.when(F.col("_sent"), F.col("finished_at")).otherwise(F.col("sent_at")),
        "error_message": F.when(F.col("_failed"), message).otherwise(F.col("error_message")),
    }).select(*notifications.columns)


def notifications_by(notifications: DataFrame, status=None, type=None) -> DataFrame:
    out = notifications
    if status is not None:
        out = out.where(F.col("status") == status)
    if type is not None:
        out = out.where(F.col("type") == type)
    return out


def retryable_notifications(notifications: DataFrame) -> DataFrame:
    return notifications.where((F.col("status") == "FAILED") & (F.col("retry_count") < F.col("max_retries")))


def requeue_failed(notifications: DataFrame, as_of=None, backoff=False) -> DataFrame:
    """Failed rows with tries left, back to PENDING with one more try counted.

    With ``backoff`` a row also carries when to try: 60 s doubled with every
    try, at most 600 s after ``as_of``.
    """
    out = retryable_notifications(notifications).withColumns({
        "retry_count": F.col("retry_count") + 1, "status": F.lit("PENDING")})
    if backoff:
        wait = F.least(F.lit(60) * F.pow(F.lit(2), F.col("retry_count") - 1), F.lit(600))
        out = out.withColumn("scheduled_at", moment(as_of) + F.make_interval(secs=wait))
    return out


def due_notifications(notifications: DataFrame, as_of) -> DataFrame:
    return notifications.where((F.col("status") == "SCHEDULED") & (F.col("scheduled_at") <= moment(as_of)))


def release_due(notifications: DataFrame, as_of) -> DataFrame:
    return due_notifications(notifications, as_of).withColumn("status", F.lit("PENDING"))


def _newest_first():
    return [F.desc("created_at"), F.desc("id")]


def recent_notifications(notifications: DataFrame, user_id, as_of, span="7 days", page=0, size=20) -> DataFrame:
    rows = notifications.where((F.col("user_id") == user_id) & (F.col("created_at") >= before(as_of, span)))
    return rows.orderBy(*_newest_first()).offset(page * size).limit(size)


def notification_page(notifications: DataFrame, user_id, page=0, size=20, status=None) -> DataFrame:
    """A page of a user's notifications, newest first."""
    rows = notifications_by(notifications.where(F.col("user_id") == user_id), status)
    return page_of(rows, _newest_first(), page, size)


def notification_stats(notifications: DataFrame) -> DataFrame:
    def n(status):
        return F.count_if(F.col("status") == status)
    return notifications.agg(
        F.count(F.lit(1)).alias("total_notifications"), n("SENT").alias("sent_notifications"),
        n("FAILED").alias("failed_notifications"), n("PENDING").alias("pending_notifications"))


def count_user_status(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("notifications"))
