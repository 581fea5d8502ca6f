"""Time columns, all independent of the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

BUCKET = "5 minutes"
BUCKET_MICROS = 300_000_000
_HAS_ZONE = r"[T ]\d.*([Zz]|[+-]\d{2}(:?\d{2}){0,2})$"
_HAS_TIME = r"[T ]\d"


def utc(moment: datetime | str) -> datetime:
    """A Python moment as an aware UTC datetime; naive values are UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def instant(moment: datetime | str) -> Column:
    """A literal timestamp that reaches the scan as a pushed filter."""
    micros = (utc(moment) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def parse_iso_utc(text: Column | str) -> Column:
    """ISO-8601 text to a UTC instant: ``Z`` or offset honoured, no zone means UTC."""
    iso = F.trim(text)
    with_zone = (
        F.when(iso.rlike(_HAS_ZONE), iso)
        .when(iso.rlike(_HAS_TIME), F.concat(iso, F.lit("Z")))
        .otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    )
    return with_zone.try_cast("timestamp")


def bad_times(parsed: dict[str, tuple[Column, Column]]) -> Column:
    """``bad_times``: the names whose text is there (not blank) and whose parsed time is null."""
    names = [
        F.when(time.isNull() & (F.length(F.trim(text)) > 0), F.lit(name)) for name, (text, time) in parsed.items()
    ]
    return F.array_compact(F.array(*names).cast("array<string>")).alias("bad_times")


def iso_z(ts: Column | str) -> Column:
    """A UTC instant as ISO text ending in ``Z``; six decimals only when needed."""
    column = ts if isinstance(ts, Column) else F.col(ts)
    utc_clock = F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))
    whole = F.unix_micros(column) % 1_000_000 == 0
    return F.when(whole, F.date_format(utc_clock, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(utc_clock, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def floor_5m(ts: Column | str) -> Column:
    """Start of the UTC five-minute bucket."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(BUCKET_MICROS)))


def utc_date(ts: Column | str) -> Column:
    """The UTC calendar date, used as the partition column of stored tables."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))


def at_or_after(column: Column | str, start: datetime | str) -> Column:
    ts = column if isinstance(column, Column) else F.col(column)
    return ts >= instant(start)


def between(column: Column | str, start: datetime | str, end: datetime | str) -> Column:
    """Half-open range ``[start, end)``."""
    ts = column if isinstance(column, Column) else F.col(column)
    return (ts >= instant(start)) & (ts < instant(end))
