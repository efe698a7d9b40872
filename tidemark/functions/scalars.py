"""Scalar expressions for raw bar text: times, numbers, sessions, pips and label codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_time(text: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` from the same or from ISO text with T and zone."""
    return F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" "))


def to_time(text: Column) -> Column:
    return F.try_to_timestamp(normal_time(text), F.lit("yyyy-MM-dd HH:mm:ss"))


def parse_date(text: Column) -> Column:
    """YYYY-MM-DD or YYYYMMDD as a date; else null."""
    text = F.trim(text)
    dashed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    plain = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.coalesce(dashed, plain).cast("date")


def parse_clock(text: Column) -> Column:
    """H:MM or H:MM:SS (what follows the last space), checked and padded to HH:MM:SS; else null."""
    tail = F.element_at(F.split(F.trim(text), " "), -1)
    parts = F.split(tail, ":")
    piece = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("0"))
    good = tail.rlike(r"^\d{1,2}:\d{1,2}(:\d{1,2})?$")
    number = lambda i: F.when(good, piece(i)).cast("int")
    fits = good & number(0).between(0, 23) & number(1).between(0, 59) & number(2).between(0, 59)
    return F.when(fits, F.concat_ws(":", *(F.lpad(piece(i), 2, "0") for i in range(3))))


def on_grid(time: Column, minutes: int = 5) -> Column:
    return F.minute(time) % minutes == 0


def combine(date: Column, clock: Column, minutes: int = 5) -> Column:
    """The timestamp of a date and a clock text; null off the grid."""
    time = F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(date.isNotNull() & clock.isNotNull() & on_grid(time, minutes), time)


def safe_float(text: Column) -> Column:
    """A number with or without thousands commas; blank, nan, none, null and other text are null."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(~F.lower(bare).isin("", "nan", "none", "null"), bare.try_cast("double"))


def session_columns(time: Column) -> dict[str, Column]:
    hour = F.hour(time)
    between = lambda a, b: ((hour >= a) & (hour < b)).cast("int")
    london, york = between(7, 16), between(12, 21)
    return {
        "hour_of_day": hour,
        "day_of_week": F.weekday(time),
        "is_asian_session": between(0, 9),
        "is_london_session": london,
        "is_ny_session": york,
        "is_overlap_session": london * york,
        "session_transition": hour.isin(0, 7, 9, 12, 16, 21).cast("int"),
        "news_release_proximity": F.lit(1.0),
    }


def pip_value(symbol: Column) -> Column:
    return F.when(symbol.endswith("USDm"), 0.0001).otherwise(0.01)


def encode_label(label: Column) -> Column:
    """-1, 0, 1 to 0, 1, 2."""
    return label + 1


def decode_label(code: Column) -> Column:
    return code - 1
