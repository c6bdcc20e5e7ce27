"""Scalar functions: texts, dates, angles and bytes of sensors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(-?\d+(?:\.\d+)?)"


def parse_orientation(comment: Column) -> Column:
    """roll, pitch and yaw of "Roll x Pitch y Yaw z"; null without a match."""
    pattern = rf"(?i)roll\s+{_NUMBER}\s+pitch\s+{_NUMBER}\s+yaw\s+{_NUMBER}"
    return F.struct(*(F.nullif(F.regexp_extract(comment, pattern, i), F.lit("")).cast("double").alias(n) for i, n in enumerate(("roll", "pitch", "yaw"), 1)))


def is_yes(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("y", "yes", "1", "true"), F.lit(False))


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def degrees_to_dms(value: Column, scale: int = 10_000) -> Column:
    """degrees, minutes and seconds (times ``scale``, rounded down) of an angle's size."""
    whole = F.floor(F.abs(value))
    minutes = (F.abs(value) - whole) * 60
    return F.struct(whole.alias("degrees"), F.floor(minutes).alias("minutes"), F.floor((minutes - F.floor(minutes)) * 60 * scale).alias("seconds"))


def wrap_360(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def wrap_180(angle: Column) -> Column:
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def signed_16(low: Column, high: Column) -> Column:
    """A signed 16-bit number from its two bytes, the low one first."""
    value = low + high * 256
    return F.when(value >= 32768, value - 65536).otherwise(value)


def status_bits(status: Column) -> Column:
    """The four two-bit states of a sensor's status byte."""
    at = lambda k: F.shiftright(status, k).bitwiseAND(F.lit(3))
    return F.struct(at(6).alias("sys"), at(4).alias("gyro"), at(2).alias("accel"), at(0).alias("mag"))


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def first_time(*texts: Column) -> Column:
    """The first of several date tags that can be read."""
    return F.coalesce(*map(exif_time, texts))


def whole_days(start_us: Column, end_us: Column) -> Column:
    return F.floor((end_us - start_us) / 86_400_000_000)


def slant(east: Column, north: Column, up: Column) -> Column:
    return F.sqrt(east * east + north * north + up * up)


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def height_colour(y: Column, lowest: Column, span: Column) -> Column:
    """Red, green and blue (0 to 1) of a height by its share of a range."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - lowest) / span))
    at_least = lambda x: F.greatest(F.lit(0.0), x)
    return F.struct(at_least(1.5 * t - 0.5).alias("r"), at_least(F.sin(F.pi() * t)).alias("g"), at_least(1 - 1.5 * t).alias("b"))
