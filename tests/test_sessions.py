import datetime

import pytest

from tessella.operators import sessions as op

COLUMNS = "project_id long, session_id long, date date, start_time timestamp_ntz, net_stitches long, duration_seconds long, colours_worked array<string>, ord long"


def rows(spark, *days):
    data = []
    for i, (day, net) in enumerate(days):
        d = datetime.date.fromisoformat(day)
        data.append((1, i, d, datetime.datetime.combine(d, datetime.time(19)), net, 3600, ["310"], i))
    return spark.createDataFrame(data, COLUMNS)


@pytest.mark.parametrize(
    ("days", "current", "longest"),
    [
        (["2024-01-28", "2024-01-29", "2024-01-30"], 3, 3),
        (["2024-01-24", "2024-01-25", "2024-01-26", "2024-01-28"], 0, 3),
        (["2024-01-29"], 1, 1),
        (["2024-01-30", "2024-01-30"], 1, 1),
    ],
)
def test_streaks(spark, days, current, longest):
    r = op.daily_streaks(rows(spark, *((d, 5) for d in days)), "2024-01-30").first()
    assert (r.current, r.longest) == (current, longest)


def test_no_sessions(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert op.daily_streaks(empty, "2024-01-30").count() == 0
    assert op.cumulative_progress(empty).count() == 0


def test_weighted_pace(spark):
    assert op.weighted_pace(rows(spark, ("2024-01-01", 10), ("2024-01-02", 20), ("2024-01-03", 30))).first().pace == 23


def test_gaps_are_filled_forward(spark):
    got = op.cumulative_progress(rows(spark, ("2024-01-01", 5), ("2024-01-03", 4))).orderBy("date").collect()
    assert [r.total for r in got] == [5, 5, 9]


def test_no_stitches_count_as_one_in_the_rhythm(spark):
    r = op.rhythm(rows(spark, ("2024-01-29", 0))).first()
    assert (r.weekday, r.hour, r.stitches) == (0, 19, 1)


def test_a_missing_week_is_forgiven_once(spark):
    got = op.weekly_streaks(rows(spark, ("2024-01-15", 1), ("2024-01-22", 1)), "2024-01-30").first()
    assert (got.current, got.longest) == (2, 2)
    assert op.weekly_streaks(rows(spark, ("2024-01-15", 1)), "2024-01-30").first().current == 0
