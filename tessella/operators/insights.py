"""Rule-based text: each rule is a table of project_id, kind, value and text, and reports are unions of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.dates import day, relative_label
from tessella.functions.numbers import js_round
from tessella.operators import sessions as s

#: Fixed value: metres of thread for a stitch.
METRES_PER_STITCH = 0.022
#: Wordings by kind of week; %n stands for this week's stitches, %p for the change in per cent, %l for last week's, %s and %o for the speeds, %d for active days.
WEEKS = {
    "none": ("No stitches so far this week.", "A quiet week up to now.", "Nothing logged this week yet."),
    "back": ("Back again with %n stitches after a quiet week.", "%n stitches this week, after none the week before."),
    "up": ("%n stitches this week, %p% more than last week.", "Up %p% on last week: %n stitches.", "On a roll with %n stitches (+%p%)."),
    "down": ("%n stitches this week, fewer than last week's %l.", "A lighter week of %n stitches after %l."),
    "same": ("%n stitches, just as many as last week.", "Steady: %n stitches in both weeks."),
}
FASTER = ("Faster at %s an hour, after %o.", "The pace went up to %s an hour from %o.")
SLOWER = ("Slower at %s an hour.", "A calmer pace of %s an hour.")
ACTIVE = ("%d active days.", "Stitched on %d days.")


def variant(options: tuple[str, ...], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(seed, F.lit(len(options))) + 1).cast("int"))


def weekly_summary(sessions: DataFrame, as_of: str) -> DataFrame:
    """One sentence on the week's volume, with more on speed and active days where they are worth a word."""
    w = s.week_comparison(sessions, as_of)
    pick = lambda c, k: F.coalesce(F.max(F.when(F.col("week") == k, F.col(c))), F.lit(0)).cast("long").alias(f"{c}_{k}")
    both = w.groupBy("project_id").agg(*(pick(c, k) for c in ("stitches", "speed", "active_days") for k in ("this", "last")))
    now, last, fast, slow = (F.col(c) for c in ("stitches_this", "stitches_last", "speed_this", "speed_last"))
    kind = F.when(now == 0, "none").when((last == 0) & (now > 0), "back").when(now > last, "up").when(now < last, "down").otherwise("same")
    seed = F.col("project_id")
    text = reduce(lambda out, k: F.when(F.col("kind") == k, variant(WEEKS[k], seed)).otherwise(out), WEEKS, F.lit(""))
    percent = js_round((now - last) / F.greatest(F.lit(1), last) * 100).cast("long")
    fill = lambda t, **marks: reduce(lambda out, m: F.replace(out, F.lit(f"%{m}"), marks[m].cast("string")), marks, t)
    paced = (fast > 0) & (slow > 0)
    speed = F.when(paced & (fast - slow > 10), fill(variant(FASTER, seed), s=fast, o=slow)).when(paced & (fast - slow < -10), fill(variant(SLOWER, seed), s=fast))
    active = F.when(F.col("active_days_this") >= 5, fill(variant(ACTIVE, seed), d=F.col("active_days_this")))
    return both.withColumn("kind", kind).select("project_id", "kind", F.concat_ws(" ", fill(text, n=now, p=percent, l=last), speed, active).alias("summary"))


def cards(sessions: DataFrame, as_of: str, dismissed: DataFrame | None = None) -> DataFrame:
    """The cards of each project, in rule order; dismissed kinds (project_id, kind) stay away.

    Weeks in a row from 2, 4 and 8 on; the last five sessions 10 % faster or 15 %
    slower than the first five, of ten or more; a busiest hour two or more hours
    from that of the 30 days before, with 20 sessions or more; 14 days without a
    session; 20 % more than last week. A project without any of these
    has the length of thread it used, from a metre on.
    """
    d = day(as_of)
    card = lambda df, n, kind, value: df.select("project_id", F.lit(n).alias("ord"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), value.cast("long").alias("value"))
    n = F.col("current")
    streak = card(s.weekly_streaks(sessions, as_of).where("current >= 2"), 1, F.when(n >= 8, "streak_long").when(n >= 4, "streak_mid").otherwise("streak_short"), n)
    change = (F.col("last_speed") - F.col("first_speed")) / F.col("first_speed")
    paced = s.first_and_last_speed(sessions).where("first_speed > 0 and last_speed > 0").withColumn("change", change).where("change >= 0.1 or change <= -0.15")
    speed = card(paced, 2, F.when(F.col("change") > 0, "speed_up").otherwise("speed_down"), js_round(F.abs("change") * 100))
    start = F.col("start_time").cast("date")
    many = sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 20").select("project_id")
    recent = s.peak_hour(sessions.where((start > F.date_sub(d, 30)) & (start <= d))).select("project_id", F.col("hour").alias("now"))
    before = s.peak_hour(sessions.where((start > F.date_sub(d, 60)) & (start <= F.date_sub(d, 30)))).select("project_id", F.col("hour").alias("was"))
    shift = card(many.join(recent, "project_id").join(before, "project_id").where("abs(now - was) >= 2"), 3, "peak_shift", F.col("now") - F.col("was"))
    idle = card(sessions.groupBy("project_id").agg(F.date_diff(d, F.max("date")).alias("days")).where("days >= 14"), 4, "neglected", F.col("days"))
    w = s.week_comparison(sessions, as_of).groupBy("project_id").agg(*(F.coalesce(F.max(F.when(F.col("week") == k, F.col("stitches"))), F.lit(0)).alias(k) for k in ("this", "last")))
    more = w.where("last > 0").withColumn("p", js_round((F.col("this") - F.col("last")) / F.col("last") * 100))
    up = card(more.where("this > last and p >= 20"), 5, "wow_up", F.col("p"))
    found = reduce(DataFrame.unionByName, (streak, speed, shift, idle, up))
    if dismissed is not None:
        found = found.join(dismissed, ["project_id", "kind"], "left_anti")
    metres = js_round(F.sum("net_stitches") * METRES_PER_STITCH)
    rest = sessions.groupBy("project_id").agg(metres.alias("m")).where("m >= 1").join(found.select("project_id"), "project_id", "left_anti")
    found = found.unionByName(card(rest, 6, "fun_thread", F.col("m")))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("ord"))
    return found.select("project_id", "kind", "value", rank.alias("position"))


def share_text(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """A line to share for every project."""
    percent = js_round(F.col("done") / F.greatest(F.col("total"), F.lit(1)) * 100).cast("long")
    hours = sessions.groupBy("project_id").agg(js_round(F.sum("duration_seconds") / 3600).cast("long").alias("hours"))
    return targets.join(hours, "project_id").select("project_id", F.format_string("%d of %d stitches (%d%%) in %d hours", "done", "total", percent, "hours").alias("text"))


def last_seen(sessions: DataFrame, as_of: str) -> DataFrame:
    days = sessions.groupBy("project_id").agg(F.date_diff(day(as_of), F.max("date")).alias("days"))
    return days.select("project_id", relative_label(F.col("days")).alias("label"))


def live_sessions(activity: DataFrame, gap_minutes: int = 10) -> DataFrame:
    """Sessions from single activities (project_id, ts, completed, undone): a gap of so many minutes ends one.

    The end is the last activity and the duration at least a second; sessions
    without any stitch are dropped. The streaming job gives the same rows.
    """
    order = Window.partitionBy("project_id").orderBy("ts")
    opens = F.coalesce(F.col("ts") >= F.lag("ts").over(order) + F.expr(f"INTERVAL {gap_minutes} MINUTES"), F.lit(True))
    numbered = activity.withColumn("opens", opens).withColumn("k", F.sum(F.col("opens").cast("int")).over(order.rangeBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("project_id", "k").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.sum("completed").alias("completed"), F.sum("undone").alias("undone"))
    return out.where("completed + undone > 0").select("project_id", "start_time", "end_time", (F.col("completed") - F.col("undone")).alias("net"), F.greatest(F.lit(1), F.unix_seconds(F.col("end_time").cast("timestamp")) - F.unix_seconds(F.col("start_time").cast("timestamp"))).alias("seconds"))
