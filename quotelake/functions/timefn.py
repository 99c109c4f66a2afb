"""Column expressions over time. The session zone is UTC throughout."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MICROS = {
    "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000,
}


def width_micros(width: str) -> int:
    """'5 minutes' as microseconds."""
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", width)
    if not m:
        raise ValueError(f"not a fixed-length width: {width!r}")
    return int(m.group(1)) * _UNIT_MICROS[m.group(2)]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(ts: Column, width: str) -> Column:
    """Start, in epoch microseconds, of the aligned bucket that holds ``ts``."""
    at = micros(ts)
    return at - F.pmod(at, F.lit(width_micros(width)))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def moment(value) -> Column:
    """A point in time given as text, datetime or column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def before(as_of, span: str) -> Column:
    """``as_of`` minus a span such as '24 hours'."""
    return moment(as_of) - F.expr(f"INTERVAL {span}")
