"""Nanosecond time: epoch-aligned buckets, ISO text, intervals and durations."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolake.errors import BadRequest

NANOS = {"second": 10**9, "minute": 60 * 10**9, "hour": 3600 * 10**9, "day": 86400 * 10**9}
SHORT = {"ns": 1, "us": 10**3, "u": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
DAY = NANOS["day"]


def interval_ns(text: str) -> int:
    """Nanoseconds of 'N unit', with unit second, minute, hour or day, singular or plural, in any case."""
    found = re.fullmatch(r"\s*(\d+)\s+(\w+)\s*", text)
    if not found:
        raise BadRequest(f"invalid interval: {text}")
    unit = found[2].lower()
    size = NANOS.get(unit.removesuffix("s"))
    if size is None:
        raise BadRequest(f"unknown interval unit: {found[2]}")
    if not int(found[1]):
        raise BadRequest(f"invalid interval: {text}")
    return int(found[1]) * size


def duration_ns(text: str) -> int:
    """Nanoseconds of a duration such as -1h or 5m; the sign is kept."""
    found = re.fullmatch(r"([+-]?\d+)(ns|us|ms|[usmhdw])", text.strip())
    if not found:
        raise BadRequest(f"invalid duration: {text}")
    return int(found[1]) * SHORT[found[2]]


def any_interval_ns(text: str) -> int:
    """Nanoseconds of 'N unit' or of a short duration such as 5m."""
    if re.fullmatch(r"\d+(ns|us|ms|[usmhdw])", text.strip()):
        if not (found := duration_ns(text)):
            raise BadRequest(f"invalid interval: {text}")
        return found
    return interval_ns(text)


def datetime_ns(moment: datetime) -> int:
    """Nanoseconds of a datetime; without a zone it is UTC."""
    since = (moment if moment.tzinfo else moment.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
    return ((since.days * 86400 + since.seconds) * 10**6 + since.microseconds) * 1000


def bucket(time_ns: Column, size_ns: int) -> Column:
    """Start of the bucket; like integer division, it truncates towards the epoch."""
    size = F.lit(size_ns).cast("bigint")
    return F.call_function("div", time_ns, size) * size


def iso(time_ns: Column) -> Column:
    """ISO text without a zone; with nine digits of fraction unless they are all zero."""
    second = F.call_function("div", time_ns - F.pmod(time_ns, F.lit(10**9)), F.lit(10**9))
    rest = F.pmod(time_ns, F.lit(10**9))
    text = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(rest == 0, text).otherwise(F.concat(text, F.lit("."), F.lpad(rest.cast("string"), 9, "0")))


def iso_text(ns: int) -> str:
    """iso() on the driver."""
    second, rest = divmod(ns, 10**9)
    text = (datetime(1970, 1, 1) + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%S")
    return f"{text}.{rest:09d}" if rest else text


def parse_iso(text: str) -> int | None:
    """Nanoseconds of ISO text, all nine digits kept; without a zone it is UTC. None if it is no such text."""
    found = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.(\d{1,9})\d*)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?", text.strip())
    if not found:
        return None
    date, clock, fraction, zone = found.groups()
    zone = "+00:00" if zone in (None, "Z", "z") else zone
    try:
        moment = datetime.fromisoformat(f"{date}T{clock or '00:00:00'}{zone}")
    except ValueError:
        return None
    return datetime_ns(moment) + int((fraction or "0").ljust(9, "0"))


def ns_of(stamp: Column) -> Column:
    """Nanoseconds of a TIMESTAMP_NTZ or TIMESTAMP column; the session's zone is UTC."""
    return F.unix_micros(stamp.cast("timestamp")) * F.lit(1000)
