"""The per-project session dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.operators import sessions as op


def dashboard(sessions: DataFrame, targets: DataFrame, as_of: str) -> DataFrame:
    """Overview and streaks of every project, one row each."""
    streaks = op.daily_streaks(sessions, as_of).withColumnsRenamed({"current": "current_streak", "longest": "longest_streak"})
    overview = op.overview(sessions, targets, as_of).select("project_id", "net", "per_hour", "active_days", "percent", "days_left")
    return overview.join(streaks, "project_id")
