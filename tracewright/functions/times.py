"""Time columns: forensic epochs and log stamp formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds and 100-ns ticks between 1601-01-01 and 1970-01-01.
SECONDS_1601_TO_1970 = 11_644_473_600
TICKS_1601_TO_1970 = 116_444_736_000_000_000


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def micros_ts(micros: Column) -> Column:
    """Microseconds since 1970; zero or less is null."""
    return F.timestamp_micros(_positive(micros.cast("long")))


def webkit_ts(micros: Column) -> Column:
    """Microseconds since 1601; zero or less is null."""
    return F.timestamp_micros(_positive(micros.cast("long")) - F.lit(SECONDS_1601_TO_1970 * 1_000_000))


def filetime_ts(ticks: Column) -> Column:
    """100-ns ticks since 1601; zero or less is null."""
    since = _positive(ticks.cast("long")) - F.lit(TICKS_1601_TO_1970)
    return F.timestamp_micros(F.floor(since / F.lit(10)).cast("long"))


def clf_ts(text: Column) -> Column:
    """Access-log stamp such as 10/Oct/2023:13:55:36 +0000."""
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def w3c_ts(date: Column, time: Column) -> Column:
    """W3C log date and time columns, in UTC."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm:ss"))


def iso_ts(text: Column) -> Column:
    """RFC 3339 text to a timestamp, null when unreadable; digits past microseconds are cut."""
    cut = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    return cut.try_cast("timestamp")


def iso_micros(text: Column) -> Column:
    """RFC 3339 text rewritten as UTC with six fraction digits; other text is unchanged."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}")
    parsed = F.when(shaped, iso_ts(text))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), text)


def mail_instant(text: Column) -> Column:
    """Transport date ('Sat, 19 Jul 2008 18:22:45 -0700 (PDT)') or store date ('Jul 20, 2008 01:28:47.8 UTC'); else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    transport = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    stored = F.when(
        bare.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4} \d{2}:\d{2}:\d{2}(\.\d+)? UTC$"),
        F.try_to_timestamp(F.regexp_replace(bare, r"(\.\d+)? UTC$", " +0000"), F.lit("MMM d, yyyy HH:mm:ss Z")),
    )
    return F.coalesce(transport, stored)


def us(ts: Column) -> Column:
    """Timestamp to microseconds since 1970."""
    return F.unix_micros(ts.cast("timestamp"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    half = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))
