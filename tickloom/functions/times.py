"""Nanosecond timestamps as longs.  No function here depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.functions.fixed import long_parse

_EPOCH = "1970-01-01"
_DAY = 86400
_NANOS = 1_000_000_000


def nanos_parse(text: Column) -> Column:
    """Nanosecond text: a signed 64-bit number that is not negative, else NULL."""
    value = long_parse(text)
    return F.when(value >= 0, value)


_ISO = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{0,9})?"
        r"(?:[Zz]|[+-][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)\z")


def iso_parse(text: Column) -> Column:
    """ISO instant to nanoseconds since the epoch, nine digits kept; NULL when it is none.

    ``24:00:00`` is the next midnight and a leap second counts as second 59.  An instant before the
    epoch or beyond the 64-bit range is NULL as well.
    """
    def number(start: Column | int, width: int) -> Column:
        start = start if isinstance(start, Column) else F.lit(start)
        return F.substring(text, start, F.lit(width)).try_cast("bigint")

    # The pattern fixes every place, so one match and plain substrings are enough.
    size = F.length(text)
    west = F.substring(text, size - 5, F.lit(1))
    short = west.isin("+", "-")
    zone = F.when(F.lower(F.right(text, F.lit(1))) == "z", 1).when(short, 6).otherwise(9)
    sign = F.when(short, west).otherwise(F.substring(text, size - 8, F.lit(1)))
    start = size - zone + 1
    offset = (F.when(zone == 1, F.lit(0).cast("bigint"))
              .otherwise(number(start + 1, 2) * 3600 + number(start + 4, 2) * 60
                         + F.when(zone == 9, number(start + 7, 2)).otherwise(F.lit(0))))
    off_valid = ((zone == 1) | ((number(start + 4, 2) <= 59)
                                & ((zone == 6) | (number(start + 7, 2) <= 59)) & (offset <= 18 * 3600)))
    days = F.date_diff(F.substring(text, 1, 10).try_cast("date"), F.lit(_EPOCH).cast("date")).cast("bigint")
    hour, minute, second = number(12, 2), number(15, 2), number(18, 2)
    fraction = F.rpad(F.substring(text, F.lit(21), F.greatest(size - 20 - zone, F.lit(0))), 9, "0").try_cast("bigint")
    leap = (hour == 23) & (minute == 59) & (second == 60)
    midnight = (hour == 24) & (minute == 0) & (second == 0) & (fraction == 0)
    valid = midnight | ((hour <= 23) & (minute <= 59) & ((second <= 59) | leap))
    seconds = (days * _DAY + hour * 3600 + minute * 60 + F.least(second, F.lit(59).cast("bigint"))
               - F.when(sign == "-", -offset).otherwise(offset))
    nanos = F.try_add(F.try_multiply(seconds, F.lit(_NANOS).cast("bigint")), fraction)
    return F.when(text.rlike(_ISO), F.when(valid & off_valid, F.when(nanos >= 0, nanos)))


def iso_utc(nanos: Column) -> Column:
    """ISO instant text in UTC with 0, 3, 6 or 9 fraction digits."""
    seconds = F.call_function("div", nanos, F.lit(_NANOS).cast("bigint"))
    fraction = nanos % F.lit(_NANOS).cast("bigint")
    days = F.call_function("div", seconds, F.lit(_DAY).cast("bigint"))
    of_day = seconds % F.lit(_DAY).cast("bigint")

    def two(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    def digits(value: Column, width: int) -> Column:
        return F.concat(F.lit("."), F.lpad(value.cast("string"), width, "0"))

    def div(value: Column, by: int) -> Column:
        return F.call_function("div", value, F.lit(by).cast("bigint"))

    tail = (F.when(fraction == 0, F.lit(""))
            .when(fraction % 1_000_000 == 0, digits(div(fraction, 1_000_000), 3))
            .when(fraction % 1_000 == 0, digits(div(fraction, 1_000), 6))
            .otherwise(digits(fraction, 9)))
    return F.concat(
        F.date_add(F.lit(_EPOCH).cast("date"), days.cast("int")).cast("string"), F.lit("T"),
        two(div(of_day, 3600)), F.lit(":"), two(div(of_day % 3600, 60)), F.lit(":"),
        two(of_day % 60), tail, F.lit("Z"),
    )
