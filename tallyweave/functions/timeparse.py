"""Timestamps as nanoseconds since the epoch."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import strip

_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
_TIME = r"([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]{1,9})[0-9]*)?"
OFFSET_FORM = rf"^{_DATE}T{_TIME}(Z|[+-][0-9]{{2}}:[0-9]{{2}})$"
NAIVE_FORM = rf"^{_DATE}[T ]{_TIME}$"
DAY_FORM = rf"^{_DATE}$"


def parse_ns(text: Column, zone: str = "UTC") -> Column:
    """Nanoseconds of a timestamp text, or null.

    An explicit offset is allowed after the T form only; otherwise the text is local time in
    ``zone`` (unknown or empty: UTC), a bare date its midnight. In a gap of local time the
    clock is moved forward, in an overlap the earlier instant is taken. The session's zone must be UTC.
    """
    t = strip(text)
    known = F.lit(zone if zone in available_timezones() else "UTC")
    form = F.when(t.rlike(OFFSET_FORM), OFFSET_FORM).when(t.rlike(NAIVE_FORM), NAIVE_FORM)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group)

    def seconds(pattern: str, offset: Column | None) -> Column:
        wall = F.try_to_timestamp(F.concat(part(pattern, 1), F.lit(" "), part(pattern, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))
        if offset is None:
            return F.unix_seconds(F.to_utc_timestamp(wall, known))
        sign = F.when(offset.startswith("-"), -1).otherwise(1)
        shift = F.when(offset == "Z", 0).otherwise(sign * (F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, 5, 2).try_cast("int") * 60))
        return F.unix_seconds(wall) - shift

    nanos = lambda pattern: F.rpad(part(pattern, 3), 9, "0").try_cast("long")
    second = F.lit(1_000_000_000).cast("long")
    day = F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp(part(DAY_FORM, 1), F.lit("yyyy-MM-dd")), known))
    return (
        F.when(form == OFFSET_FORM, seconds(OFFSET_FORM, part(OFFSET_FORM, 4)) * second + nanos(OFFSET_FORM))
        .when(form == NAIVE_FORM, seconds(NAIVE_FORM, None) * second + nanos(NAIVE_FORM))
        .when(t.rlike(DAY_FORM), day * second)
    )


def render_ns(ns: Column) -> Column:
    """UTC text of nanoseconds; trailing zeros of the fraction are left out."""
    second = F.lit(1_000_000_000).cast("long")
    frac = F.regexp_replace(F.lpad(F.pmod(ns, second).cast("string"), 9, "0"), "0+$", "")
    whole = ns - F.pmod(ns, second)
    text = F.date_format(F.timestamp_micros((whole.cast("decimal(20,0)") / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(text, F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)), F.lit("Z"))


def render_duration(ns: Column) -> Column:
    """A duration like 1h2m3.5s, 250ms or 0s."""
    parts = lambda unit: F.regexp_replace(F.regexp_replace((ns.cast("decimal(20,0)") / F.lit(unit)).cast("decimal(30,9)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    second, minute, hour = 1_000_000_000, 60_000_000_000, 3_600_000_000_000
    rest = F.pmod(ns, F.lit(minute).cast("long"))
    tail = F.concat(F.regexp_replace(F.regexp_replace((rest.cast("decimal(20,0)") / F.lit(second)).cast("decimal(20,9)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lit("s"))
    minutes = F.floor(ns / minute).cast("long")
    return (
        F.when(ns == 0, "0s")
        .when(ns < 1_000, F.concat(ns.cast("string"), F.lit("ns")))
        .when(ns < 1_000_000, F.concat(parts(1_000), F.lit("µs")))
        .when(ns < second, F.concat(parts(1_000_000), F.lit("ms")))
        .when(ns < minute, tail)
        .when(ns < hour, F.concat(minutes.cast("string"), F.lit("m"), tail))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.pmod(minutes, F.lit(60)).cast("string"), F.lit("m"), tail))
    )
