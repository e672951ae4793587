"""Column expressions that operators share: relative hours, portable hashes, normal forms, unit conversion, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Signed hours from start to end, to the microsecond."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)


def plus_microseconds(t: str | Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros.cast("long"), F.col(t) if isinstance(t, str) else t)


def portable_hash(*parts: Column) -> Column:
    """A number below 2**32 that other engines compute alike: the first eight hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def normal_name(name: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def normal_code(code: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(code)), "[^A-Z0-9]", "")


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def log_loss(y: Column, p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return F.ln(q / (1 - q))


def event_time(when: Column, day: Column, mode: str) -> Column:
    """A time, or for a day alone its start ('start'), its last microsecond ('end') or nothing ('none')."""
    if mode == "none":
        return when
    alone = day.cast("timestamp_ntz")
    if mode == "end":
        alone = alone + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")
    return F.coalesce(when, alone)
