"""Scalar functions over dates, speeds and targets (columns in, columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds between 1970-01-01 and 2001-01-01, the two epochs of stored times.
REFERENCE_EPOCH = 978307200


def statistics_date(ts: Column, reset_minutes: int = 0, zone: str = "UTC") -> Column:
    """The day a moment counts for: the reset time is taken off on the instant line, before the zone applies (session zone UTC)."""
    return F.to_date(F.from_utc_timestamp(ts - F.make_dt_interval(mins=F.lit(reset_minutes)), zone))


def valid_date(key: Column) -> Column:
    """A strict ISO date, else null."""
    return F.when(key.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(key, "yyyy-MM-dd"))


def week_start(day: Column, first_day: int = 0) -> Column:
    """The first day of the week of day; first_day 0 is Monday."""
    return F.date_sub(day, F.pmod(F.weekday(day) - first_day, F.lit(7)).cast("int"))


def period_start(day: Column, mode: str, first_day: int = 0) -> Column:
    """Start of the week, month or year of day."""
    return week_start(day, first_day) if mode == "week" else F.trunc(day, mode).cast("date")


def period_end(start: Column, mode: str) -> Column:
    """Last day of the period that starts at start."""
    return {"week": F.date_add(start, 6), "month": F.last_day(start), "year": F.date_sub(F.add_months(start, 12), 1)}[mode]


def shift_period(start: Column, mode: str, offset: int) -> Column:
    return F.date_add(start, 7 * offset) if mode == "week" else F.add_months(start, offset * (12 if mode == "year" else 1))


def months_apart(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def page_count(mode: str, first: Column, today: Column) -> Column:
    """Pages of a pager over periods from first to today, one at least."""
    n = {"week": (F.datediff(week_start(today), week_start(first)) / 7).cast("int") + 1, "month": months_apart(first, today) + 1, "year": F.year(today) - F.year(first) + 1}[mode]
    return F.greatest(n, F.lit(1))


def speed(characters: Column, seconds: Column) -> Column:
    """Characters an hour, rounded half up; 0 without time."""
    return F.when(seconds > 0, F.floor(characters / seconds * 3600.0 + 0.5)).otherwise(0).cast("bigint")


def speed_truncated(characters: Column, seconds: Column) -> Column:
    """Characters an hour, truncated; 0 without time."""
    return F.when(seconds > 0, (characters / seconds * 3600.0).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def target_ratio(characters: Column, seconds: Column, kind: str, target: int) -> Column:
    """Share of the daily target: characters, or minutes for kind 'duration'; 0 where there is no target."""
    if target <= 0:
        return F.lit(0.0)
    return characters / F.lit(float(target)) if kind == "characters" else seconds / F.lit(target * 60.0)


def snap_setting(value: Column, least: int, most: int, step: int) -> Column:
    """A setting held to least + k * step, half up, within its range."""
    held = F.least(F.greatest(value, F.lit(least)), F.lit(most))
    return (F.lit(least) + F.floor((held - least) / step + 0.5) * step).cast("int")


def updated_speeds(characters: Column, seconds: Column, least: Column, most: Column) -> tuple[Column, Column, Column]:
    """Speed after an edit, and the least and most speeds widened by it (0 means none yet)."""
    now = speed_truncated(characters, seconds)
    return now, F.when((least > 0) & (now > 0), F.least(least, now)).when(least > 0, least).otherwise(now), F.greatest(most, now)


def to_reference_seconds(ms: Column) -> Column:
    return ms / 1000.0 - REFERENCE_EPOCH


def to_unix_ms(seconds: Column) -> Column:
    return F.floor((seconds + REFERENCE_EPOCH) * 1000.0 + 0.5).cast("bigint")


def display_units(characters: Column, language: Column) -> Column:
    """Words (five characters each, rounded up) for English, characters for other languages."""
    return F.when(F.lower(F.split(language, "[-_]")[0]) == "en", F.ceil(characters / 5.0)).otherwise(characters).cast("bigint")


def percent_text(part: Column) -> Column:
    return F.format_string("%.2f%%", part * 100.0)


def character_at(start: Column, count: Column, progress: Column) -> Column:
    """The character that a part of a chapter reaches, truncated and held inside it."""
    return F.greatest(start, F.least(start + (progress * count).cast("int"), start + count)).cast("int")
