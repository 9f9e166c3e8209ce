"""Schedules in cron notation as conditions over timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _values(field: str, low: int, high: int) -> list[int]:
    """The numbers that a field of a schedule allows: lists of ``*``, numbers and ranges, each with a step."""
    found: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
        if not low <= first <= last <= high:
            raise ValueError(f"{field!r} is not within {low} to {high}")
        found.update(range(first, last + 1, int(step or 1)))
    return sorted(found)


def cron_matches(expression: str, at: Column) -> Column:
    """Whether a minute is one of ``minute hour day month weekday`` (Sunday is 0). Where both days are limited, either suffices."""
    minute, hour, day, month, weekday = expression.split()
    week = {x % 7 for x in _values(weekday, 0, 7)}
    on_day = F.dayofmonth(at).isin(_values(day, 1, 31))
    on_weekday = (F.dayofweek(at) - 1).isin(sorted(week))
    days = on_weekday if day == "*" else on_day if weekday == "*" else on_day | on_weekday
    return F.minute(at).isin(_values(minute, 0, 59)) & F.hour(at).isin(_values(hour, 0, 23)) & F.month(at).isin(_values(month, 1, 12)) & days


def next_run(expression: str, at: Column, days: int = 32) -> Column:
    """The first matching minute after ``at`` within so many days, null if there is none."""
    start = F.date_trunc("minute", at).cast("timestamp_ntz")
    minutes = F.sequence(start + F.expr("INTERVAL 1 MINUTE"), start + F.expr(f"INTERVAL {days * 1440 - 1} MINUTES"), F.expr("INTERVAL 1 MINUTE"))
    return F.array_min(F.filter(minutes, lambda m: cron_matches(expression, m)))
