"""Dates as cameras write them ('YYYY:MM:DD HH:MM:SS'), as seconds in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismarium.functions import col

_PLACES = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2), "minute": (15, 2), "second": (18, 2)}


def exif_fields(text: Column | str) -> Column:
    """A struct of six ints read at fixed places; null unless all six are digits. Separators and ranges are not looked at."""
    parts = {name: F.substring(col(text), at, size) for name, (at, size) in _PLACES.items()}
    good = col(text).rlike(r"(?s)^\d{4}.\d\d.\d\d.\d\d.\d\d.\d\d")
    return F.when(good, F.struct(*(p.try_cast("int").alias(name) for name, p in parts.items())))


def epoch(fields: Column) -> Column:
    """Seconds since 1970 of such a struct. Months and days beyond their range roll over; the year may be 0."""
    month, year = fields["month"].cast("long"), fields["year"].cast("long")
    early = month <= 2
    y = F.when(early, year - 1).otherwise(year)  # years that begin in March
    m = F.when(early, month + 9).otherwise(month - 3)
    leaps = F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
    days = 365 * y + leaps + F.floor((153 * m + 2) / 5) + fields["day"] - 719469
    return (days * 86400 + fields["hour"] * 3600 + fields["minute"] * 60 + fields["second"]).cast("long")


def exif_epoch(text: Column | str) -> Column:
    return epoch(exif_fields(text))


def folder(fields: Column, pattern: str) -> Column:
    """``pattern`` with %Y, %m and %d replaced; everything else stays as it is."""
    out = F.lit(pattern)
    for token, name, width in (("%Y", "year", 4), ("%m", "month", 2), ("%d", "day", 2)):
        number = fields[name].cast("string")
        out = F.replace(out, F.lit(token), F.lpad(number, width, "0"))
    return F.when(fields.isNotNull(), out)


def timestamp_text(seconds: Column | str) -> Column:
    """'YYYY-MM-DD  HH:MM:SS' in UTC, for the years 1 to 9999; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd  HH:mm:ss")


def exif_text(seconds: Column | str) -> Column:
    """Seconds as a camera writes them."""
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy:MM:dd HH:mm:ss")
