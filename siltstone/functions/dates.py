"""Date windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_window(day: Column, start: str | None = None, end: str | None = None, days: int = 90) -> Column:
    """Whether a day lies in a window: both ends given, or the last ``days`` days up to ``end`` (today)."""
    if start and not end:
        raise ValueError("start and end must be given together")
    last = F.to_date(F.lit(end)) if end else F.current_date()
    first = F.to_date(F.lit(start)) if start else F.date_sub(last, days)
    return day.between(first, last)
