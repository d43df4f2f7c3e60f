"""Instants as nanoseconds: strict parsing, formatting, a clock that can be set."""

from __future__ import annotations

import re
import time
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

MIN_NS, MAX_NS = -(1 << 63), (1 << 63) - 1
SECOND = 1_000_000_000
#: RFC 3339 with an offset, or a date alone. Parts: date, time, fraction, offset.
STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[Tt]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]+))?([Zz]|[+-][0-9]{2}:[0-9]{2}))?$"
_STAMP = re.compile(STAMP)


def now_ns() -> int:
    return time.time_ns()


def parse_ns(text: str) -> int:
    """An RFC 3339 instant or YYYY-MM-DD (midnight UTC), clamped to 64 bits; QueryError for anything else."""
    m = _STAMP.match(text.strip())
    try:
        if not m:
            raise ValueError
        days = date.fromisoformat(m[1]).toordinal() - 719_163
        hour, minute, second = map(int, (m[2] or "00:00:00").split(":"))
        sign, offset = 1, (0, 0)
        if m[4] and m[4] not in "Zz":
            sign, offset = (-1 if m[4][0] == "-" else 1), tuple(map(int, m[4][1:].split(":")))
        if hour > 23 or minute > 59 or second > 59 or offset[0] > 23 or offset[1] > 59:
            raise ValueError
    except ValueError:
        raise QueryError(f"cannot parse timestamp {text!r}; expected RFC 3339 or YYYY-MM-DD") from None
    seconds = days * 86_400 + hour * 3600 + minute * 60 + second - sign * (offset[0] * 3600 + offset[1] * 60)
    return max(MIN_NS, min(MAX_NS, seconds * SECOND + int(((m[3] or "") + "0" * 9)[:9])))


def format_ns(ns: int) -> str:
    """RFC 3339 in UTC, the fraction without trailing zeros."""
    seconds, fraction = divmod(ns, SECOND)
    days, rest = divmod(seconds, 86_400)
    text = f"{date.fromordinal(days + 719_163).isoformat()}T{rest // 3600:02}:{rest // 60 % 60:02}:{rest % 60:02}"
    return text + (f".{fraction:09}".rstrip("0") if fraction else "") + "Z"


def parse_ns_column(text: Column) -> Column:
    """parse_ns() over a column; null where the text is no instant. Strict, unlike a cast to TIMESTAMP."""
    trimmed = F.trim(text)
    part = [F.regexp_extract(trimmed, STAMP, i) for i in range(1, 5)]
    offset = F.when((part[3] == "") | F.lower(part[3]).isin("z"), F.lit(0)).otherwise(
        F.when(F.substring(part[3], 1, 1) == "-", -1).otherwise(1) * (F.substring(part[3], 2, 2).cast("int") * 3600 + F.substring(part[3], 5, 2).cast("int") * 60)
    )
    clock = F.when(part[1] == "", F.lit("00:00:00")).otherwise(part[1])
    hms = [F.substring(clock, i, 2).cast("int") for i in (1, 4, 7)]
    day = F.try_to_date(part[0], "yyyy-MM-dd")
    fine = F.rlike(trimmed, F.lit(STAMP)) & day.isNotNull() & (hms[0] <= 23) & (hms[1] <= 59) & (hms[2] <= 59)
    seconds = F.unix_date(day).cast("long") * 86_400 + hms[0] * 3600 + hms[1] * 60 + hms[2] - offset
    fraction = F.substring(F.rpad(part[2], 9, "0"), 1, 9).cast("long")
    top, low = MAX_NS // SECOND, MIN_NS // SECOND + 1
    ns = F.when(seconds >= top, F.lit(MAX_NS)).when(seconds <= low, F.lit(MIN_NS)).otherwise(seconds * SECOND + F.coalesce(fraction, F.lit(0)))
    return F.when(fine, ns)


def format_ns_column(ns: Column) -> Column:
    """format_ns() over a column."""
    seconds = F.floor(ns / F.lit(SECOND).cast("decimal(20,0)")).cast("long")
    fraction = F.pmod(ns, F.lit(SECOND))
    stamp = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.rtrim(F.format_string(".%09d", fraction), F.lit("0"))
    return F.concat(stamp, F.when(fraction == 0, F.lit("")).otherwise(tail), F.lit("Z"))


def timestamp_ns(ts: Column) -> Column:
    """Nanoseconds of a TIMESTAMP or TIMESTAMP_NTZ column, the latter read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 1000
