"""Casts with defaults, dates, rounding and base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_string(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("unknown"))


def safe_double(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def safe_long(value: Column) -> Column:
    """Whole numbers keep all their digits; others go by way of a double, so that a fraction is cut off. What is no number
    is 0."""
    return F.coalesce(value.try_cast("long"), value.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def safe_timestamp(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")


def or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def from_form_time(text: Column) -> Column:
    """``YYYY-MM-DDTHH:MM`` to a timestamp."""
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd'T'HH:mm"))


def to_form_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm")


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def shift(moment: Column, days: Column | int = 0, hours: Column | int = 0) -> Column:
    def whole(n):
        return n.cast("int") if isinstance(n, Column) else F.lit(n)
    return moment + F.make_dt_interval(whole(days), whole(hours))


def frame_seconds(frame: Column, fps: float = 30.0) -> Column:
    return frame / F.lit(float(fps))


def encode(payload: Column) -> Column:
    """Base64 on one line; Spark may break it into lines of 76 characters."""
    return F.replace(F.base64(payload), F.lit("\r\n"), F.lit(""))


def decode(text: Column) -> Column:
    return F.unbase64(text)
