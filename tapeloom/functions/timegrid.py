"""Regular time steps on epoch seconds (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
MINUTE = 60


def step_seconds(interval_hours: float) -> int:
    """Grid step in seconds. Only positive whole minutes are allowed."""
    if interval_hours <= 0:
        raise ValueError("interval_hours must be positive")
    minutes = interval_hours * 60.0
    if abs(minutes - round(minutes)) > 1e-6:
        raise ValueError(f"interval_hours={interval_hours} is not a whole number of minutes")
    if round(minutes) < 1:
        raise ValueError("a grid step must be at least one minute")
    return round(minutes) * MINUTE


def step_label(step: int) -> str:
    """``1h``, ``30min`` and so on."""
    return f"{step // HOUR}h" if step % HOUR == 0 else f"{step // MINUTE}min"


def floor_to(seconds: Column, step: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(step))


def ceil_to(seconds: Column, step: int) -> Column:
    return seconds + F.pmod(-seconds, F.lit(step))


def floor_second(ts: Column) -> Column:
    return F.unix_seconds(ts)


def ceil_second(ts: Column) -> Column:
    micros = F.unix_micros(ts)
    spare = F.pmod(-micros, F.lit(1_000_000))
    return ((micros + spare) / 1_000_000).cast("bigint")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def iso_of_seconds(seconds: Column) -> Column:
    return iso_utc(F.timestamp_seconds(seconds))
