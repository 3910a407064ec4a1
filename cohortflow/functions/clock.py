"""Clock strings to milliseconds.

Clocks have no date, so they are plain numbers rather than timestamps. Five
dialects differ in what they accept, in whether short millisecond fields are
padded (``.5`` is 500 ms or 5 ms) and in what stands for a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip, to_number

DAY_MS = 24 * 3600 * 1000

_INT = r"\s*([+-]?\d+)\s*"


def _numbers(text: Column, pattern: str) -> tuple[Column, Column]:
    """Whole seconds in ms and the text of the last part; null without a match."""
    h, m, s = (F.regexp_extract(text, pattern, i).try_cast("bigint") for i in (1, 2, 3))
    return h * 3600000 + m * 60000 + s * 1000, F.regexp_extract(text, pattern, 4)


def _strict(col: Column) -> Column:
    hms, ms = _numbers(col, r"^\s*(\d{1,2}):(\d{1,2}):(\d{1,2})(?:[:.](\d{1,3}))?\s*$")
    return hms + F.rpad(ms, 3, "0").try_cast("bigint")


def _unpadded(col: Column) -> Column:
    hms, ms = _numbers(col, f"^{_INT}[:.]{_INT}[:.]{_INT}(?:[:.]{_INT})?$")
    return hms + F.coalesce(ms.try_cast("bigint"), F.lit(0))


def _sentinel(col: Column) -> Column:
    text = strip(col)
    hms, ms = _numbers(text, f"^{_INT}:{_INT}:{_INT}:{_INT}$")
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    h, m, s = (to_number(F.split_part(text, F.lit(":"), F.lit(i))) for i in (1, 2, 3))
    value = (
        F.when(colons == 3, (hms + ms.try_cast("bigint")).cast("double"))
        .when(colons == 2, h * 3600000 + m * 60000 + s * 1000)
        .when(colons == 0, to_number(text) * 1000)
    )
    return F.coalesce(value, F.lit(-1000.0))


def _ranged(col: Column) -> Column:
    hms, ms = _numbers(col, r"^([01]?\d|2[0-3]):([0-5]?\d):([0-5]?\d):(\d{1,6})$")
    return hms + F.rpad(ms, 6, "0").try_cast("bigint") / 1000


def clock_ms(col: Column, dialect: str = "strict") -> Column:
    """Milliseconds since midnight.

    ``strict``    ``H:M:S`` with an optional 1-3 digit part, padded; null otherwise
    ``loose``     dots count as colons, 3 or 4 integers, last one not padded
    ``sentinel``  4 integers, 3 decimals or one number; failure is -1 s
    ``ranged``    needs the 4th part, padded, with real clock ranges
    ``dotted``    colons count as dots, 3 or 4 integers, last one not padded
    """
    if dialect == "strict":
        return _strict(col)
    if dialect == "loose":
        return _unpadded(col)
    if dialect == "sentinel":
        return _sentinel(col)
    if dialect == "ranged":
        return _ranged(col)
    if dialect == "dotted":
        return _unpadded(col)
    raise ValueError(f"unknown clock dialect: {dialect}")


def parse_clock(col: Column, dialect: str = "strict") -> Column:
    """Seconds since midnight as a double."""
    return clock_ms(col, dialect) / 1000


def ms_since_start(start_ms: Column, clock: Column) -> Column:
    """Offset from the file start; a clock before the start is on the next day."""
    return F.when(clock < start_ms, clock + DAY_MS).otherwise(clock) - start_ms


def seconds_since_start(file_start: Column, clock: Column) -> Column:
    return ms_since_start(clock_ms(file_start), clock_ms(clock)) / 1000
