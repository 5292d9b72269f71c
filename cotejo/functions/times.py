"""Dates, times and durations.  Durations are whole seconds or minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import strip

# Accepted spellings, day before month.
DAY_FIRST = (
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "d/M/yyyy",
    "yyyy-MM-dd H:mm:ss",
    "yyyy-MM-dd H:mm",
    "yyyy-MM-dd",
)
MINUTE_FORMAT = "dd/MM/yyyy HH:mm"
SECOND_FORMAT = "dd/MM/yyyy HH:mm:ss"
DURATION = r"^(?:(\d+)\s+days?,\s*)?(\d+):(\d{2})(?::\d{2})?\.?$"
DURATION_HOURS = r"^(?:(\d+)\s+days?,\s*)?(\d{1,2}):"
DATE_IN_LABEL = r"\d{1,2}/\d{1,2}/\d{4}"
NO_DATE = "N/A"


def parse(c: Column, *formats: str) -> Column:
    """First format that fits, else null.  Never raises.

    A format is tried only on text with its separator and number of colons,
    which is far cheaper than letting the parser fail.
    """
    colons = F.length(c) - F.length(F.replace(c, F.lit(":"), F.lit("")))

    def attempt(fmt: str) -> Column:
        alike = F.contains(c, F.lit("/" if "/" in fmt else "-")) if "y" in fmt else F.lit(True)
        return F.when(alike & (colons == fmt.count(":")), F.try_to_timestamp(c, F.lit(fmt)))

    return F.coalesce(*[attempt(f) for f in (formats or DAY_FIRST)]).cast("timestamp_ntz")


def parse_strict(c: Column, fmt: str) -> Column:
    """The format must fit; a value that does not fail the query."""
    return F.to_timestamp(c, fmt).cast("timestamp_ntz")


def floor_minute(c: Column) -> Column:
    return F.date_trunc("minute", c).cast("timestamp_ntz")


def minute_text(c: Column, missing: str | None = NO_DATE) -> Column:
    out = F.date_format(c, MINUTE_FORMAT)
    return out if missing is None else F.coalesce(out, F.lit(missing))


def expected_start(mass: Column, generated: Column, started: Column, ended: Column) -> Column:
    """Mass outages count from the generation time unless they ended before it."""
    return (
        F.when(mass & (ended < generated), started)
        .when(mass, generated)
        .otherwise(started)
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def two_digits(n: Column) -> Column:
    """At least two digits; longer numbers and signs are kept whole."""
    t = n.cast("string")
    return F.when(n.between(0, 9), F.concat(F.lit("0"), t)).otherwise(t)


def hhmm(seconds: Column) -> Column:
    """``HH:MM`` with floor division, so negative spans keep their sign."""
    hours = F.floor(seconds / 3600).cast("bigint")
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("bigint")
    return F.concat(two_digits(hours), F.lit(":"), two_digits(minutes))


def _whole_hours(t: Column) -> Column:
    """Hours of a text already known to fit: days before the comma, hours after it."""
    days = F.when(F.contains(t, F.lit(",")), F.regexp_extract(t, r"^\d+", 0).try_cast("bigint"))
    hours = F.split_part(strip(F.split_part(t, F.lit(","), F.lit(-1))), F.lit(":"), F.lit(1))
    return F.coalesce(days, F.lit(0)) * 24 + F.coalesce(hours.try_cast("bigint"), F.lit(0))


def duration_hhmm(c: Column) -> Column:
    """``[N day(s), ]H:MM[:SS][.]`` -> ``HH:MM``; null when it does not fit."""
    t = strip(c)
    minutes = F.substring(F.split_part(t, F.lit(":"), F.lit(2)), 1, 2)
    return F.when(t.rlike(DURATION), F.concat(two_digits(_whole_hours(t)), F.lit(":"), minutes))


def duration_hours(c: Column) -> Column:
    """Whole hours of a duration text; null when it does not fit."""
    t = strip(c)
    return F.when(t.rlike(DURATION_HOURS), _whole_hours(t))


def minutes_of(c: Column) -> Column:
    """``HH:MM`` -> minutes; null when it is not two numbers."""
    parts = F.split(c, ":")
    h = F.get(parts, F.lit(0)).try_cast("double")
    m = F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 2, h * 60 + m)


def drop_zero_seconds(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit(":00")), F.substring(c, 1, 5)).otherwise(c)


def date_in_label(c: Column) -> Column:
    return parse(F.regexp_extract(c, DATE_IN_LABEL, 0), "d/M/yyyy").cast("date")


def clock(c: Column) -> Column:
    return F.date_format(c, "HH:mm:ss")


def check_range(start, end) -> None:
    """Refuse a request whose start lies after its end."""
    if start is not None and end is not None and start > end:
        raise ValueError("the start of the range lies after its end")
