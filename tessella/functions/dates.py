"""Date expressions. Time is always an argument: no expression reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def monday_of(date: Column) -> Column:
    return F.date_trunc("week", date).cast("date")


def sunday_of(date: Column) -> Column:
    """The Sunday that begins the date's week."""
    return F.date_sub(date, F.dayofweek(date) - 1)


def stitching_date(ts: Column, day_end_hour: int = 0) -> Column:
    """Times before day_end_hour belong to the day before."""
    return (ts - F.expr(f"INTERVAL {day_end_hour} HOURS")).cast("date")


def duration_label(seconds: Column) -> Column:
    """<1m, Xm, Xh or Xh Ym."""
    minutes = F.floor(seconds / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(minutes < 1, "<1m").when(hours < 1, F.concat(minutes.cast("string"), F.lit("m"))).when(rest == 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))


def relative_label(days: Column) -> Column:
    """Today, Yesterday, N days ago or N weeks ago."""
    weeks = F.floor(days / 7)
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).when(weeks == 1, "1 week ago").otherwise(F.concat(weeks.cast("string"), F.lit(" weeks ago")))
