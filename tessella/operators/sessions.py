"""Session statistics. Sessions have project_id, session_id, date, start_time, net_stitches, duration_seconds, colours_worked and ord.

Every function works for all projects at once; as_of is the day on which it asks.
Groups are projects and days, so nothing is gathered in one place but totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.dates import day, monday_of, sunday_of
from tessella.functions.numbers import js_round, or_one, ratio, tenth

PER_HOUR = 3600.0


def net():
    return F.col("net_stitches")


def secs():
    return F.col("duration_seconds")


def whole(x):
    return x.cast("long")


def speed(stitches, seconds):
    """Stitches per hour as a whole number, 0 without time."""
    return whole(F.coalesce(js_round(ratio(stitches, seconds / PER_HOUR)), F.lit(0)))


def daily(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project_id", "date").agg(F.sum(net()).alias("stitches"), F.sum(secs()).alias("seconds"), F.count(F.lit(1)).alias("n_sessions"))


def date_totals(sessions: DataFrame, as_of: str) -> DataFrame:
    """Stitches of the day, of its week from Monday and of its month; seconds of the day."""
    d = day(as_of)
    upto = F.col("date") <= d
    return sessions.groupBy("project_id").agg(
        F.coalesce(F.sum(F.when(F.col("date") == d, net())), F.lit(0)).alias("today"),
        F.coalesce(F.sum(F.when(upto & (F.col("date") >= monday_of(d)), net())), F.lit(0)).alias("week"),
        F.coalesce(F.sum(F.when(upto & (F.col("date") >= F.trunc(d, "month")), net())), F.lit(0)).alias("month"),
        F.coalesce(F.sum(F.when(F.col("date") == d, secs())), F.lit(0)).alias("seconds_today"),
    )


def project_meta(sessions: DataFrame, as_of: str) -> DataFrame:
    """The row that project lists show; the last session is the last in input order."""
    d = day(as_of)
    out = sessions.groupBy("project_id").agg(
        F.sum(secs()).alias("seconds"),
        F.sum(net()).alias("net"),
        F.count_distinct("date").alias("active_days"),
        F.count(F.lit(1)).alias("n_sessions"),
        F.max_by("date", "ord").alias("last_date"),
        F.max_by("net_stitches", "ord").alias("last_net"),
        F.coalesce(F.sum(F.when(F.col("date") > F.date_sub(d, 7), net())), F.lit(0)).alias("last_week"),
        F.coalesce(F.sum(F.when(F.col("date") > F.date_sub(d, 30), net())), F.lit(0)).alias("last_month"),
    )
    return out.withColumns({"minutes": whole(js_round(F.col("seconds") / 60)), "per_hour": speed(F.col("net"), F.col("seconds"))})


def lifetime(sessions: DataFrame) -> DataFrame:
    """One row over all projects."""
    return sessions.agg(F.sum(net()).alias("stitches"), F.sum(secs()).alias("seconds"), F.count(F.lit(1)).alias("n_sessions"), F.count_distinct("project_id").alias("n_projects"), F.count_distinct("date").alias("active_days"))


def daily_totals(sessions: DataFrame, as_of: str, days: int) -> DataFrame:
    d = day(as_of)
    return sessions.where((F.col("date") > F.date_sub(d, days)) & (F.col("date") <= d)).groupBy("date").agg(F.sum(net()).alias("stitches"))


def weighted_pace(sessions: DataFrame, days: int = 14) -> DataFrame:
    """Of the last distinct days, the newest weighing most."""
    per_day = daily(sessions)
    newest = Window.partitionBy("project_id").orderBy(F.desc("date"))
    ranked = per_day.withColumn("j", F.row_number().over(newest)).where(F.col("j") <= days)
    weight = F.count(F.lit(1)).over(Window.partitionBy("project_id")) - F.col("j") + 1
    return ranked.withColumn("w", weight).groupBy("project_id").agg(whole(js_round(F.sum(F.col("stitches") * F.col("w")) / F.sum("w"))).alias("pace"), F.count(F.lit(1)).alias("n_days"))


def overview(sessions: DataFrame, targets: DataFrame, as_of: str) -> DataFrame:
    """Speed, paces, and what is left at the recent pace; targets have project_id, done and total."""
    d = day(as_of)
    base = sessions.groupBy("project_id").agg(F.sum(secs()).alias("seconds"), F.sum(net()).alias("net"), F.count_distinct("date").alias("active_days"), F.min("date").alias("first_date"))
    joined = base.join(weighted_pace(sessions).select("project_id", "pace"), "project_id").join(targets, "project_id")
    elapsed = F.greatest(F.lit(1), F.date_diff(d, "first_date"))
    left = F.col("total") - F.col("done")
    per_active = whole(js_round(F.col("net") / F.col("active_days")))
    pace = F.when(F.col("pace") != 0, F.col("pace")).otherwise(per_active)
    days_left = F.when(pace > 0, whole(F.ceil(left / pace)))
    per_hour = speed(F.col("net"), F.col("seconds"))
    return joined.select(
        "project_id",
        "seconds",
        "net",
        "active_days",
        whole(elapsed).alias("elapsed_days"),
        per_hour.alias("per_hour"),
        per_active.alias("per_active_day"),
        whole(js_round(F.col("net") / elapsed)).alias("per_calendar_day"),
        F.col("pace").alias("recent_pace"),
        left.alias("remaining"),
        days_left.alias("days_left"),
        F.date_add(d, days_left.cast("int")).alias("done_on"),
        F.when((per_hour > 0) & (left > 0), left / per_hour).alias("hours_left"),
        F.when(F.col("total") > 0, tenth(F.col("done") / F.col("total") * 100)).otherwise(0.0).alias("percent"),
    )


def sessions_by_date(sessions: DataFrame) -> DataFrame:
    """The sessions of each day of a project, in input order."""
    return sessions.groupBy("project_id", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "session_id"))), lambda s: s["session_id"]).alias("sessions"))


def best_day(sessions: DataFrame) -> DataFrame:
    """The day with most stitches, the earlier of equal ones; none if no day has any."""
    best = daily(sessions).where(F.col("stitches") > 0).groupBy("project_id").agg(F.max_by(F.struct("date", "stitches"), F.struct("stitches", -F.unix_date("date"))).alias("b"))
    return best.select("project_id", "b.date", "b.stitches")


def colour_timeline(sessions: DataFrame) -> DataFrame:
    """First and last day, sessions and days of each colour of a project."""
    worked = sessions.select("project_id", "date", "ord", F.explode("colours_worked").alias("colour"))
    return worked.groupBy("project_id", "colour").agg(F.min_by("date", "ord").alias("first_date"), F.max_by("date", "ord").alias("last_date"), F.count(F.lit(1)).alias("n_sessions"), F.count_distinct("date").alias("n_days"))


def recent_pace(sessions: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Active days, speed and stitches per active day of the last days."""
    recent = sessions.where((F.col("date") > F.date_sub(day(as_of), days)) & (F.col("date") <= day(as_of)))
    out = recent.groupBy("project_id").agg(F.count_distinct("date").alias("active_days"), F.sum(net()).alias("stitches"), F.sum(secs()).alias("seconds"))
    return out.select("project_id", "active_days", speed(F.col("stitches"), F.col("seconds")).alias("per_hour"), (F.col("stitches") / F.col("active_days")).alias("per_day"))


def projections(sessions: DataFrame, targets: DataFrame, as_of: str) -> DataFrame:
    """complete, paused (fewer than three recent days) or projected, with the day it ends."""
    joined = targets.join(recent_pace(sessions, as_of), "project_id", "left").fillna({"active_days": 0, "per_hour": 0, "per_day": 0.0})
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    status = F.when((F.col("total") > 0) & (F.col("done") >= F.col("total")), "complete").when((F.col("active_days") < 3) | (F.col("per_day") <= 0), "paused").otherwise("projected")
    days_left = F.when(F.col("status") == "projected", whole(F.ceil(F.col("remaining") / (F.col("per_day") * (F.col("active_days") / 14)))))
    out = joined.withColumns({"remaining": left, "status": status}).withColumn("days_left", days_left)
    return out.select("project_id", "status", "remaining", "days_left", F.date_add(day(as_of), F.col("days_left").cast("int")).alias("done_on"), whole(js_round(F.col("per_day"))).alias("recent_per_day"))


def rhythm(sessions: DataFrame) -> DataFrame:
    """Stitches by weekday, Monday first, and hour; a session without stitches counts as one."""
    return sessions.groupBy(F.weekday("start_time").alias("weekday"), F.hour("start_time").alias("hour")).agg(F.sum(or_one(net())).alias("stitches"), F.count(F.lit(1)).alias("n_sessions"))


def peak_hour(sessions: DataFrame) -> DataFrame:
    """The hour with most sessions of each project, the earliest of equal ones."""
    hours = sessions.groupBy("project_id", F.hour("start_time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("project_id").agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("hour"), F.max("n").alias("n_sessions"))


def peak_cell(sessions: DataFrame) -> DataFrame:
    """The busiest cell of the rhythm, the first in row order of equal ones."""
    return rhythm(sessions).agg(F.max_by(F.struct("weekday", "hour", "stitches"), F.struct("stitches", -(F.col("weekday") * 24 + F.col("hour")))).alias("c")).select("c.*")


def week_comparison(sessions: DataFrame, as_of: str) -> DataFrame:
    """This week from Monday against the seven days before it."""
    start = monday_of(day(as_of))
    week = F.when(F.col("date") >= start, "this").when(F.col("date") >= F.date_sub(start, 7), "last")
    out = sessions.withColumn("week", week).where("week is not null").groupBy("project_id", "week").agg(F.sum(net()).alias("stitches"), F.sum(secs()).alias("seconds"), F.count_distinct("date").alias("active_days"))
    return out.withColumn("speed", speed(F.col("stitches"), F.col("seconds")))


def percent_change(now, before):
    """100 or 0 where there was nothing before."""
    return F.when(before == 0, F.when(now > 0, 100).otherwise(0)).otherwise(js_round((now - before) / before * 100)).cast("long")


def week_deltas(sessions: DataFrame, as_of: str) -> DataFrame:
    """Changes of the week comparison in per cent."""
    w = week_comparison(sessions, as_of)
    pick = lambda c, k: F.coalesce(F.sum(F.when(F.col("week") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}")
    both = w.groupBy("project_id").agg(*(pick(c, k) for c in ("stitches", "seconds", "speed") for k in ("this", "last")))
    return both.select("project_id", *(percent_change(F.col(f"{c}_this"), F.col(f"{c}_last")).alias(f"{c}_change") for c in ("stitches", "seconds", "speed")))


def day_grid(sessions: DataFrame) -> DataFrame:
    """Load of each day over all projects, with the stitches of each project."""
    per = daily(sessions)
    grid = per.groupBy("date").agg(F.sum("stitches").alias("stitches"), F.sum("seconds").alias("seconds"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("project_id", "stitches")))).alias("by_project"))
    return grid


def weekday_share(sessions: DataFrame) -> DataFrame:
    """Stitches by weekday, Sunday first, and their share; only for projects with three active days."""
    d = daily(sessions)
    own = Window.partitionBy("project_id")
    days = d.withColumns({"n_days": F.count(F.lit(1)).over(own), "all": F.sum("stitches").over(own)}).where("n_days >= 3")
    out = days.groupBy("project_id", (F.dayofweek("date") - 1).alias("weekday")).agg(F.sum("stitches").alias("stitches"), F.max("all").alias("all"))
    return out.select("project_id", "weekday", "stitches", F.coalesce(ratio(F.col("stitches"), F.col("all")), F.lit(0.0)).alias("share"))


def busiest(sessions: DataFrame, unit: str, n: int = 5) -> DataFrame:
    """The n weeks (from Sunday) or months with most stitches."""
    period = sunday_of(F.col("date")) if unit == "week" else F.trunc("date", "month")
    return sessions.groupBy(period.alias("period")).agg(F.sum(net()).alias("stitches")).orderBy(F.desc("stitches"), "period").limit(n)


def period_pace(sessions: DataFrame, start: str, stop: str) -> DataFrame:
    """Stitches, stitches per session day and hours between two days."""
    within = sessions.where(F.col("date").between(day(start), day(stop)))
    out = within.groupBy("project_id").agg(F.sum(net()).alias("stitches"), F.count_distinct("date").alias("session_days"), F.sum(secs()).alias("seconds"))
    return out.select("project_id", "stitches", whole(js_round(F.col("stitches") / F.col("session_days"))).alias("per_session_day"), tenth(F.col("seconds") / PER_HOUR).alias("hours"))


def islands(days: DataFrame, by: list[str], date: str = "date", step: int = 1) -> DataFrame:
    """Runs of dates step days apart: first, last and n of each."""
    order = Window.partitionBy(*by).orderBy(date)
    rank = F.row_number().over(order)
    return days.withColumn("island", F.expr(f"unix_date({date})") - rank * step).groupBy(*by, "island").agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count(F.lit(1)).alias("n"))


def daily_streaks(sessions: DataFrame, as_of: str) -> DataFrame:
    """Longest run of days, and the current one if it ends today or yesterday."""
    runs = islands(sessions.select("project_id", "date").where("date is not null").distinct(), ["project_id"])
    current = F.col("last").between(F.date_sub(day(as_of), 1), day(as_of))
    return runs.groupBy("project_id").agg(F.coalesce(F.max(F.when(current, F.col("n"))), F.lit(0)).alias("current"), F.max("n").alias("longest"))


def weekly_streaks(sessions: DataFrame, as_of: str) -> DataFrame:
    """Runs of Monday weeks; the current one may lack this week."""
    weeks = sessions.select("project_id", monday_of(F.col("date")).alias("date")).where("date is not null").distinct()
    monday = monday_of(day(as_of))
    runs = islands(weeks, ["project_id"], step=7)
    current = F.col("last").between(F.date_sub(monday, 7), monday)
    out = runs.groupBy("project_id").agg(F.coalesce(F.max(F.when(current, F.col("n"))), F.lit(0)).alias("current"), F.max("n").alias("longest"))
    return out.withColumn("longest", F.greatest("longest", "current"))


def with_totals(sessions: DataFrame) -> DataFrame:
    """sessions with total_at_end, the running sum in time order, not below 0."""
    order = Window.partitionBy("project_id").orderBy("start_time", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return sessions.withColumn("total_at_end", F.greatest(F.lit(0), F.sum(net()).over(order)))


def cumulative_progress(sessions: DataFrame) -> DataFrame:
    """The last total of every calendar day between a project's first and last, filled forward."""
    last = with_totals(sessions).groupBy("project_id", "date").agg(F.max_by("total_at_end", F.struct("start_time", "ord")).alias("total"))
    span = last.groupBy("project_id").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    order = Window.partitionBy("project_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return span.join(last, ["project_id", "date"], "left").withColumn("total", F.coalesce(F.last("total", ignorenulls=True).over(order), F.lit(0)))


def dense_series(sessions: DataFrame, as_of: str, days: int) -> DataFrame:
    """The last days of every project, with 0 where nothing was done."""
    d = day(as_of)
    spine = sessions.select("project_id").distinct().select("project_id", F.explode(F.sequence(F.date_sub(d, days - 1), d)).alias("date"))
    out = spine.join(daily(sessions).select("project_id", "date", "stitches"), ["project_id", "date"], "left")
    return out.select("project_id", "date", F.coalesce("stitches", F.lit(0)).alias("stitches"), (F.col("date") == d).alias("is_today"))


def rolling_mean(sessions: DataFrame, n: int = 7) -> DataFrame:
    """Mean stitches of a session and the n - 1 before it, as a whole number."""
    order = Window.partitionBy("project_id").orderBy("start_time", "ord").rowsBetween(-(n - 1), 0)
    return sessions.select("project_id", "session_id", whole(js_round(F.avg(net()).over(order))).alias("mean"))


def speed_trend(sessions: DataFrame) -> DataFrame:
    """Speed of every session of at least ten minutes with stitches, and its place in time."""
    fit = sessions.where((secs() >= 600) & (net() > 0))
    order = Window.partitionBy("project_id").orderBy("start_time", "ord")
    return fit.select("project_id", "session_id", F.row_number().over(order).alias("position"), speed(net(), secs()).alias("per_hour"))


def backfilled_totals(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """Running totals clamped to the project's total."""
    joined = with_totals(sessions).join(targets.select("project_id", "total"), "project_id")
    return joined.select("project_id", "session_id", F.least("total_at_end", "total").alias("total_at_end"))


PERCENTS = (10, 25, 50, 75, 100)


def milestones(sessions: DataFrame, targets: DataFrame, as_of: str, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """For each threshold, the day it was reached or is expected, and whether it comes next."""
    per_day = sessions.groupBy("project_id").agg(whole(js_round(F.sum(net()) / F.count_distinct("date"))).alias("per_day"))
    wanted = targets.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("threshold", whole(F.floor(F.col("total") * F.col("percent") / 100)))
    met = with_totals(sessions).select("project_id", "date", "start_time", "ord", "total_at_end")
    first = wanted.join(met, "project_id").where("total_at_end >= threshold and done >= threshold").groupBy("project_id", "percent").agg(F.min_by("date", F.struct("start_time", "ord")).alias("achieved_on"))
    achieved = (F.col("done") >= F.col("threshold")) & (F.col("total") > 0)
    out = wanted.join(first, ["project_id", "percent"], "left").join(per_day, "project_id", "left").withColumn("achieved", achieved)
    expected = F.when(~achieved & (F.col("per_day") > 0), F.date_add(day(as_of), F.ceil((F.col("threshold") - F.col("done")) / F.col("per_day")).cast("int")))
    next_one = F.min(F.when(~F.col("achieved"), F.col("percent"))).over(Window.partitionBy("project_id"))
    return out.select("project_id", "percent", "threshold", "achieved", "achieved_on", expected.alias("expected_on"), F.coalesce(~F.col("achieved") & (F.col("percent") == next_one), F.lit(False)).alias("is_next"))


CROSSINGS = (10, 25, 50, 75, 90, 100)


def crossings(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """Thresholds and thousands that each session passed."""
    order = Window.partitionBy("project_id").orderBy("start_time", "ord")
    s = with_totals(sessions).withColumn("before", F.coalesce(F.lag("total_at_end").over(order), F.lit(0))).join(targets.select("project_id", "total"), "project_id")
    share = s.withColumn("percent", F.explode(F.array(*map(F.lit, CROSSINGS)))).withColumn("threshold", F.floor(F.col("total") * F.col("percent") / 100))
    passed = share.where("before < threshold and total_at_end >= threshold").select("project_id", "session_id", F.concat(F.col("percent").cast("string"), F.lit("%")).alias("label"))
    now, then = F.floor(F.col("total_at_end") / 1000), F.floor(F.col("before") / 1000)
    return passed.unionByName(s.where(now > then).select("project_id", "session_id", F.concat((now * 1000).cast("string"), F.lit(" stitches")).alias("label")))


def first_and_last_speed(sessions: DataFrame, n: int = 5, least: int = 10) -> DataFrame:
    """Speed of the first n against the last n sessions: faster above +10 %, slower below -15 %."""
    w = Window.partitionBy("project_id")
    ranked = sessions.withColumns({"up": F.row_number().over(w.orderBy("start_time", "ord")), "down": F.row_number().over(w.orderBy(F.desc("start_time"), F.desc("ord"))), "all": F.count(F.lit(1)).over(w)}).where(F.col("all") >= least)
    part = lambda rank: (F.sum(F.when(F.col(rank) <= n, net())) / (F.sum(F.when(F.col(rank) <= n, secs())) / PER_HOUR))
    out = ranked.groupBy("project_id").agg(part("up").alias("first_speed"), part("down").alias("last_speed"))
    return out.withColumn("trend", F.when(F.col("last_speed") > F.col("first_speed") * 1.1, "faster").when(F.col("last_speed") < F.col("first_speed") * 0.85, "slower").otherwise("steady"))


def last_against_prior(sessions: DataFrame, least: int = 4) -> DataFrame:
    """The last session and the mean of those before it, with at least that many sessions."""
    w = Window.partitionBy("project_id")
    ranked = sessions.withColumns({"down": F.row_number().over(w.orderBy(F.desc("start_time"), F.desc("ord"))), "all": F.count(F.lit(1)).over(w)}).where(F.col("all") >= least)
    return ranked.groupBy("project_id").agg(F.max(F.when(F.col("down") == 1, net())).alias("last"), F.avg(F.when(F.col("down") > 1, net())).alias("prior_mean"))


def percentile_bins(sessions: DataFrame) -> DataFrame:
    """Days of a project in bins by the elements at a quarter, half and three quarters of its sorted non-zero days."""
    d = daily(sessions).select("project_id", "date", "stitches")
    rank = Window.partitionBy("project_id").orderBy("stitches", "date")
    full = d.where("stitches > 0").withColumns({"i": F.row_number().over(rank) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("project_id"))})
    at = lambda p: F.max(F.when(F.col("i") == F.floor(F.col("n") * p), F.col("stitches")))
    marks = full.groupBy("project_id").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    bin_ = F.when(F.col("stitches") <= 0, 0).when(F.col("stitches") <= F.col("p25"), 1).when(F.col("stitches") <= F.col("p50"), 2).when(F.col("stitches") <= F.col("p75"), 3).otherwise(4)
    return d.join(marks, "project_id", "left").select("project_id", "date", "stitches", bin_.alias("bin"))


def timeline(sessions: DataFrame, dates: int = 10) -> DataFrame:
    """Sessions of the newest dates of each project, numbered newest first."""
    w = Window.partitionBy("project_id")
    ranked = sessions.withColumn("date_rank", F.dense_rank().over(w.orderBy(F.desc("date")))).where(F.col("date_rank") <= dates)
    return ranked.select("project_id", "session_id", "date", "date_rank", F.row_number().over(w.orderBy("date_rank", F.desc("start_time"), F.desc("ord"))).alias("position"))


def goal_progress(sessions: DataFrame, as_of: str, daily_goal: int, weekly_goal: int, monthly_goal: int) -> DataFrame:
    """Share of each goal, at most 100, whether it is met, and what is left a day of the month."""
    t = date_totals(sessions, as_of)
    goals = {"today": daily_goal, "week": weekly_goal, "month": monthly_goal}
    share = {f"{k}_percent": F.least(F.lit(100), whole(js_round(F.col(k) / g * 100))) for k, g in goals.items()}
    days_left = F.date_diff(F.last_day(day(as_of)), day(as_of)) + 1
    need = F.when(F.col("month") < monthly_goal, whole(F.ceil((monthly_goal - F.col("month")) / days_left))).otherwise(0)
    return t.select("project_id", *(e.alias(n) for n, e in share.items()), *((F.col(k) >= g).alias(f"{k}_met") for k, g in goals.items()), need.alias("needed_per_day"))


def what_if(sessions: DataFrame, targets: DataFrame, as_of: str, per_day: int) -> DataFrame:
    """The day a project ends at another pace."""
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    last = sessions.groupBy("project_id").agg(F.max("date").alias("last_date"))
    return targets.join(last, "project_id").select("project_id", left.alias("remaining"), F.date_add("last_date", F.ceil(left / per_day).cast("int")).alias("done_on"))


def month_calendar(sessions: DataFrame, month: str) -> DataFrame:
    """Every day of the month with its stitches, and its column in a week from Monday."""
    first = day(f"{month}-01")
    spine = sessions.select("project_id").distinct().select("project_id", F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    joined = spine.join(daily(sessions).select("project_id", "date", "stitches"), ["project_id", "date"], "left")
    return joined.select("project_id", "date", F.coalesce("stitches", F.lit(0)).alias("stitches"), F.weekday("date").alias("column"))


def mean_session(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project_id").agg(whole(js_round(F.avg(secs()))).alias("mean_seconds"))


def heat_bins(sessions: DataFrame) -> DataFrame:
    """Days by their share of the project's greatest day: 0, up to a quarter, half, three quarters, all."""
    d = daily(sessions)
    top = F.max("stitches").over(Window.partitionBy("project_id"))
    r = F.coalesce(ratio(F.col("stitches"), F.col("top")), F.lit(0.0))
    return d.withColumn("top", top).select("project_id", "date", F.when(r <= 0, 0).when(r < 0.25, 1).when(r < 0.5, 2).when(r < 0.75, 3).otherwise(4).alias("bin"))
