"""Queries over work sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import AS_OF, sessions, sql, targets
from tessella.operators import sessions as op
from tessella.plans import dashboard as plan
from tessella.registry import query

DAY = f"DATE '{AS_OF}'"
DAILY = "daily AS (SELECT project_id, date, CAST(sum(net_stitches) AS BIGINT) AS stitches, CAST(sum(duration_seconds) AS BIGINT) AS seconds FROM sessions GROUP BY ALL)"
TOTALS = "totals AS (SELECT *, CAST(greatest(0, sum(net_stitches) OVER (PARTITION BY project_id ORDER BY start_time, ord)) AS BIGINT) AS total_at_end FROM sessions)"
SPEED = "CAST(coalesce(CASE WHEN sum(duration_seconds) > 0 THEN floor(sum(net_stitches) / (sum(duration_seconds) / 3600.0) + 0.5) END, 0) AS BIGINT)"
PACE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date DESC) AS j FROM daily QUALIFY j <= 14),
    pace AS (SELECT project_id, CAST(floor(sum(stitches * (n - j + 1))::DOUBLE / sum(n - j + 1) + 0.5) AS BIGINT) AS pace, count(*) AS n_days FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS n FROM ranked) GROUP BY project_id)"""


@query(sql("sessions", f"SELECT project_id, CAST(coalesce(sum(net_stitches) FILTER (date = {DAY}), 0) AS BIGINT) AS today, CAST(coalesce(sum(net_stitches) FILTER (date BETWEEN date_trunc('week', {DAY}) AND {DAY}), 0) AS BIGINT) AS week, CAST(coalesce(sum(net_stitches) FILTER (date BETWEEN date_trunc('month', {DAY}) AND {DAY}), 0) AS BIGINT) AS month, CAST(coalesce(sum(duration_seconds) FILTER (date = {DAY}), 0) AS BIGINT) AS seconds_today FROM sessions GROUP BY 1"))
def session_date_totals(spark, d):
    return op.date_totals(sessions(spark, d), AS_OF)


@query(sql("sessions", f"SELECT project_id, CAST(sum(duration_seconds) AS BIGINT) AS seconds, CAST(sum(net_stitches) AS BIGINT) AS net, count(DISTINCT date) AS active_days, count(*) AS n_sessions, arg_max(date, ord) AS last_date, arg_max(net_stitches, ord) AS last_net, CAST(coalesce(sum(net_stitches) FILTER (date > {DAY} - 7), 0) AS BIGINT) AS last_week, CAST(coalesce(sum(net_stitches) FILTER (date > {DAY} - 30), 0) AS BIGINT) AS last_month, CAST(floor(sum(duration_seconds) / 60.0 + 0.5) AS BIGINT) AS minutes, {SPEED} AS per_hour FROM sessions GROUP BY 1"))
def session_project_meta(spark, d):
    return op.project_meta(sessions(spark, d), AS_OF)


@query(sql("sessions", "SELECT CAST(sum(net_stitches) AS BIGINT) AS stitches, CAST(sum(duration_seconds) AS BIGINT) AS seconds, count(*) AS n_sessions, count(DISTINCT project_id) AS n_projects, count(DISTINCT date) AS active_days FROM sessions"))
def session_lifetime(spark, d):
    return op.lifetime(sessions(spark, d))


@query(sql("sessions", f"SELECT date, CAST(sum(net_stitches) AS BIGINT) AS stitches FROM sessions WHERE date > {DAY} - 21 AND date <= {DAY} GROUP BY 1"))
def session_daily_totals(spark, d):
    return op.daily_totals(sessions(spark, d), AS_OF, 21)


@query(sql("sessions", f", {DAILY}, {PACE} SELECT * FROM pace"))
def session_weighted_pace(spark, d):
    return op.weighted_pace(sessions(spark, d))


OVERVIEW = f"""base AS (SELECT project_id, CAST(sum(duration_seconds) AS BIGINT) AS seconds, CAST(sum(net_stitches) AS BIGINT) AS net, count(DISTINCT date) AS active_days, min(date) AS first_date, {SPEED} AS per_hour FROM sessions GROUP BY 1),
    joined AS (SELECT *, CAST(greatest(1, date_diff('day', first_date, {DAY})) AS BIGINT) AS elapsed_days, total - done AS remaining, CAST(floor(net / active_days::DOUBLE + 0.5) AS BIGINT) AS per_active_day FROM base JOIN pace USING (project_id) JOIN targets USING (project_id)),
    est AS (SELECT *, CASE WHEN pace <> 0 THEN pace ELSE per_active_day END AS p FROM joined),
    overview AS (SELECT project_id, seconds, net, active_days, elapsed_days, per_hour, per_active_day, CAST(floor(net / elapsed_days::DOUBLE + 0.5) AS BIGINT) AS per_calendar_day, pace AS recent_pace, remaining, CASE WHEN p > 0 THEN CAST(ceil(remaining / p::DOUBLE) AS BIGINT) END AS days_left,
        CASE WHEN p > 0 THEN {DAY} + CAST(ceil(remaining / p::DOUBLE) AS INTEGER) END AS done_on, CASE WHEN per_hour > 0 AND remaining > 0 THEN remaining / per_hour::DOUBLE END AS hours_left, CASE WHEN total > 0 THEN floor(done / total::DOUBLE * 100 * 10 + 0.5) / 10 ELSE 0.0 END AS percent FROM est)"""


@query(sql("sessions targets", f", {DAILY}, {PACE}, {OVERVIEW} SELECT * FROM overview"))
def session_overview(spark, d):
    return op.overview(sessions(spark, d), targets(spark, d), AS_OF)


@query(sql("sessions", "SELECT project_id, date, array_to_string(list(session_id ORDER BY ord), ',') AS sessions FROM sessions GROUP BY 1, 2"))
def session_groups_by_date(spark, d):
    return op.sessions_by_date(sessions(spark, d)).withColumn("sessions", F.array_join(F.col("sessions").cast("array<string>"), ","))


@query(sql("sessions", f", {DAILY} SELECT project_id, date, stitches FROM daily WHERE stitches > 0 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY stitches DESC, date) = 1"))
def session_best_day(spark, d):
    return op.best_day(sessions(spark, d))


@query(sql("sessions", "SELECT project_id, colour, arg_min(date, ord) AS first_date, arg_max(date, ord) AS last_date, count(*) AS n_sessions, count(DISTINCT date) AS n_days FROM sessions GROUP BY 1, 2"))
def session_colour_timeline(spark, d):
    return op.colour_timeline(sessions(spark, d))


RECENT = f"recent AS (SELECT project_id, count(DISTINCT date) AS active_days, {SPEED} AS per_hour, sum(net_stitches)::DOUBLE / count(DISTINCT date) AS per_day FROM sessions WHERE date > {DAY} - 14 AND date <= {DAY} GROUP BY 1)"


@query(sql("sessions", f", {RECENT} SELECT project_id, active_days, per_hour, round(per_day, 6) AS per_day FROM recent"))
def session_recent_pace(spark, d):
    return op.recent_pace(sessions(spark, d), AS_OF).withColumn("per_day", F.round("per_day", 6))


@query(sql("sessions targets", f""", {RECENT}, joined AS (SELECT project_id, total, done, coalesce(active_days, 0) AS active_days, coalesce(per_day, 0) AS per_day FROM targets LEFT JOIN recent USING (project_id)),
    s AS (SELECT *, greatest(0, total - done) AS remaining, CASE WHEN total > 0 AND done >= total THEN 'complete' WHEN active_days < 3 OR per_day <= 0 THEN 'paused' ELSE 'projected' END AS status FROM joined),
    t AS (SELECT *, CASE WHEN status = 'projected' THEN CAST(ceil(remaining / (per_day * (active_days / 14.0::DOUBLE))) AS BIGINT) END AS days_left FROM s)
    SELECT project_id, status, remaining, days_left, {DAY} + CAST(days_left AS INTEGER) AS done_on, CAST(floor(per_day + 0.5) AS BIGINT) AS recent_per_day FROM t"""))
def session_projections(spark, d):
    return op.projections(sessions(spark, d), targets(spark, d), AS_OF)


RHYTHM = "rhythm AS (SELECT CAST(isodow(start_time) - 1 AS INTEGER) AS weekday, CAST(hour(start_time) AS INTEGER) AS hour, CAST(sum(CASE WHEN net_stitches = 0 THEN 1 ELSE net_stitches END) AS BIGINT) AS stitches, count(*) AS n_sessions FROM sessions GROUP BY 1, 2)"


@query(sql("sessions", f", {RHYTHM} SELECT * FROM rhythm"))
def session_rhythm(spark, d):
    return op.rhythm(sessions(spark, d))


@query(sql("sessions", "SELECT * FROM (SELECT project_id, CAST(hour(start_time) AS INTEGER) AS hour, count(*) AS n_sessions FROM sessions GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n_sessions DESC, hour) = 1"))
def session_peak_hour(spark, d):
    return op.peak_hour(sessions(spark, d))


@query(sql("sessions", f", {RHYTHM} SELECT weekday, hour, stitches FROM rhythm ORDER BY stitches DESC, weekday, hour LIMIT 1"))
def session_peak_cell(spark, d):
    return op.peak_cell(sessions(spark, d))


WEEKS = f"weeks AS (SELECT project_id, CASE WHEN date >= date_trunc('week', {DAY}) THEN 'this' ELSE 'last' END AS week, CAST(sum(net_stitches) AS BIGINT) AS stitches, CAST(sum(duration_seconds) AS BIGINT) AS seconds, count(DISTINCT date) AS active_days, {SPEED} AS speed FROM sessions WHERE date >= CAST(date_trunc('week', {DAY}) AS DATE) - 7 GROUP BY 1, 2)"


@query(sql("sessions", f", {WEEKS} SELECT * FROM weeks"))
def session_week_comparison(spark, d):
    return op.week_comparison(sessions(spark, d), AS_OF)


def _delta(c: str) -> str:
    now, before = (f"coalesce(sum({c}) FILTER (week = '{w}'), 0)" for w in ("this", "last"))
    return f"CAST(CASE WHEN {before} = 0 THEN CASE WHEN {now} > 0 THEN 100 ELSE 0 END ELSE floor(({now} - {before}) / {before}::DOUBLE * 100 + 0.5) END AS BIGINT) AS {c}_change"


@query(sql("sessions", f", {WEEKS} SELECT project_id, {_delta('stitches')}, {_delta('seconds')}, {_delta('speed')} FROM weeks GROUP BY 1"))
def session_week_deltas(spark, d):
    return op.week_deltas(sessions(spark, d), AS_OF)


@query(sql("sessions", f", {DAILY} SELECT date, CAST(sum(stitches) AS BIGINT) AS stitches, CAST(sum(seconds) AS BIGINT) AS seconds, string_agg(project_id || ':' || stitches, ',' ORDER BY project_id) AS by_project FROM daily GROUP BY 1"))
def session_day_grid(spark, d):
    grid = op.day_grid(sessions(spark, d))
    pairs = F.transform(F.map_entries("by_project"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return grid.withColumn("by_project", F.array_join(pairs, ","))


@query(sql("sessions", f", {DAILY}, days AS (SELECT *, count(*) OVER (PARTITION BY project_id) AS n_days, sum(stitches) OVER (PARTITION BY project_id) AS all_stitches FROM daily) SELECT project_id, CAST(dayofweek(date) AS INTEGER) AS weekday, CAST(sum(stitches) AS BIGINT) AS stitches, round(coalesce(CASE WHEN max(all_stitches) > 0 THEN sum(stitches)::DOUBLE / max(all_stitches) END, 0), 6) AS share FROM days WHERE n_days >= 3 GROUP BY 1, 2"))
def session_weekday_share(spark, d):
    return op.weekday_share(sessions(spark, d)).withColumn("share", F.round("share", 6))


@query(sql("sessions", "SELECT CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS period, CAST(sum(net_stitches) AS BIGINT) AS stitches FROM sessions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def session_busiest_weeks(spark, d):
    return op.busiest(sessions(spark, d), "week")


@query(sql("sessions", "SELECT CAST(date_trunc('month', date) AS DATE) AS period, CAST(sum(net_stitches) AS BIGINT) AS stitches FROM sessions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def session_busiest_months(spark, d):
    return op.busiest(sessions(spark, d), "month")


@query(sql("sessions", "SELECT project_id, CAST(sum(net_stitches) AS BIGINT) AS stitches, CAST(floor(sum(net_stitches)::DOUBLE / count(DISTINCT date) + 0.5) AS BIGINT) AS per_session_day, floor(sum(duration_seconds) / 3600.0 * 10 + 0.5) / 10 AS hours FROM sessions WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY 1"))
def session_period_pace(spark, d):
    return op.period_pace(sessions(spark, d), "2024-01-08", "2024-01-21")


STREAKS = f"""days AS (SELECT DISTINCT project_id, date FROM sessions WHERE date IS NOT NULL),
    runs AS (SELECT project_id, min(date) AS first, max(date) AS last, count(*) AS n FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY project_id ORDER BY date) AS INTEGER) AS island FROM days) GROUP BY project_id, island),
    streaks AS (SELECT project_id, coalesce(max(n) FILTER (last BETWEEN {DAY} - 1 AND {DAY}), 0) AS current, max(n) AS longest FROM runs GROUP BY 1)"""


@query(sql("sessions", f", {STREAKS} SELECT * FROM streaks"))
def session_daily_streaks(spark, d):
    return op.daily_streaks(sessions(spark, d), AS_OF)


@query(sql("sessions", f""", weeks AS (SELECT DISTINCT project_id, CAST(date_trunc('week', date) AS DATE) AS w FROM sessions),
    runs AS (SELECT project_id, max(w) AS last, count(*) AS n FROM (SELECT *, w - 7 * CAST(row_number() OVER (PARTITION BY project_id ORDER BY w) AS INTEGER) AS island FROM weeks) GROUP BY project_id, island)
    SELECT project_id, coalesce(max(n) FILTER (last BETWEEN CAST(date_trunc('week', {DAY}) AS DATE) - 7 AND date_trunc('week', {DAY})), 0) AS current, max(n) AS longest FROM runs GROUP BY 1"""))
def session_weekly_streaks(spark, d):
    return op.weekly_streaks(sessions(spark, d), AS_OF)


@query(sql("sessions", f""", {TOTALS}, last AS (SELECT project_id, date, total_at_end FROM totals QUALIFY row_number() OVER (PARTITION BY project_id, date ORDER BY start_time DESC, ord DESC) = 1),
    span AS (SELECT project_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM last GROUP BY 1)
    SELECT s.project_id, s.date, coalesce(last_value(l.total_at_end IGNORE NULLS) OVER (PARTITION BY s.project_id ORDER BY s.date), 0) AS total FROM span s LEFT JOIN last l ON s.project_id = l.project_id AND s.date = l.date"""))
def session_cumulative_progress(spark, d):
    return op.cumulative_progress(sessions(spark, d))


@query(sql("sessions", f", {DAILY}, spine AS (SELECT project_id, CAST(unnest(generate_series({DAY} - 13, {DAY}, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT project_id FROM sessions)) SELECT s.project_id, s.date, coalesce(stitches, 0) AS stitches, s.date = {DAY} AS is_today FROM spine s LEFT JOIN daily d ON s.project_id = d.project_id AND s.date = d.date"))
def session_dense_series(spark, d):
    return op.dense_series(sessions(spark, d), AS_OF, 14)


@query(sql("sessions", "SELECT project_id, session_id, CAST(floor(avg(net_stitches) OVER (PARTITION BY project_id ORDER BY start_time, ord ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 0.5) AS BIGINT) AS mean FROM sessions"))
def session_rolling_mean(spark, d):
    return op.rolling_mean(sessions(spark, d))


@query(sql("sessions", "SELECT project_id, session_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY start_time, ord) AS INTEGER) AS position, CAST(floor(net_stitches / (duration_seconds / 3600.0) + 0.5) AS BIGINT) AS per_hour FROM sessions WHERE duration_seconds >= 600 AND net_stitches > 0"))
def session_speed_trend(spark, d):
    return op.speed_trend(sessions(spark, d))


@query(sql("sessions targets", f", {TOTALS} SELECT t.project_id, session_id, least(total_at_end, total) AS total_at_end FROM totals t JOIN targets USING (project_id)"))
def session_backfilled_totals(spark, d):
    return op.backfilled_totals(sessions(spark, d), targets(spark, d))


@query(sql("sessions targets", f""", {TOTALS}, per AS (SELECT project_id, CAST(floor(sum(net_stitches)::DOUBLE / count(DISTINCT date) + 0.5) AS BIGINT) AS per_day FROM sessions GROUP BY 1),
    wanted AS (SELECT *, CAST(floor(total * percent / 100.0) AS BIGINT) AS threshold FROM targets, (SELECT unnest([10, 25, 50, 75, 100]) AS percent)),
    first AS (SELECT w.project_id, percent, arg_min(date, struct_pack(a := start_time, b := ord)) AS achieved_on FROM wanted w JOIN totals t USING (project_id) WHERE total_at_end >= threshold AND done >= threshold GROUP BY 1, 2),
    j AS (SELECT w.project_id, w.percent, threshold, done >= threshold AND total > 0 AS achieved, achieved_on, done, per_day FROM wanted w LEFT JOIN first f ON w.project_id = f.project_id AND w.percent = f.percent LEFT JOIN per p ON w.project_id = p.project_id)
    SELECT project_id, percent, threshold, achieved, achieved_on, CASE WHEN NOT achieved AND per_day > 0 THEN {DAY} + CAST(ceil((threshold - done) / per_day::DOUBLE) AS INTEGER) END AS expected_on, coalesce(NOT achieved AND percent = min(percent) FILTER (NOT achieved) OVER (PARTITION BY project_id), FALSE) AS is_next FROM j"""))
def session_milestones(spark, d):
    return op.milestones(sessions(spark, d), targets(spark, d), AS_OF)


@query(sql("sessions targets", f""", {TOTALS}, s AS (SELECT t.*, total, coalesce(lag(total_at_end) OVER (PARTITION BY t.project_id ORDER BY start_time, ord), 0) AS before FROM totals t JOIN targets USING (project_id))
    SELECT project_id, session_id, percent || '%' AS label FROM s, (SELECT unnest([10, 25, 50, 75, 90, 100]) AS percent) WHERE before < floor(total * percent / 100.0) AND total_at_end >= floor(total * percent / 100.0)
    UNION ALL SELECT project_id, session_id, (total_at_end // 1000 * 1000) || ' stitches' FROM s WHERE total_at_end // 1000 > before // 1000"""))
def session_crossings(spark, d):
    return op.crossings(sessions(spark, d), targets(spark, d))


@query(sql("sessions", """, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_time, ord) AS up, row_number() OVER (PARTITION BY project_id ORDER BY start_time DESC, ord DESC) AS down, count(*) OVER (PARTITION BY project_id) AS n FROM sessions),
    s AS (SELECT project_id, sum(net_stitches) FILTER (up <= 5) / (sum(duration_seconds) FILTER (up <= 5) / 3600.0::DOUBLE) AS first_speed, sum(net_stitches) FILTER (down <= 5) / (sum(duration_seconds) FILTER (down <= 5) / 3600.0::DOUBLE) AS last_speed FROM r WHERE n >= 10 GROUP BY 1)
    SELECT project_id, round(first_speed, 6) AS first_speed, round(last_speed, 6) AS last_speed, CASE WHEN last_speed > first_speed * 1.1 THEN 'faster' WHEN last_speed < first_speed * 0.85 THEN 'slower' ELSE 'steady' END AS trend FROM s"""))
def session_first_and_last_speed(spark, d):
    return op.first_and_last_speed(sessions(spark, d)).withColumns({c: F.round(c, 6) for c in ("first_speed", "last_speed")})


@query(sql("sessions", ", r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_time DESC, ord DESC) AS down, count(*) OVER (PARTITION BY project_id) AS n FROM sessions) SELECT project_id, max(net_stitches) FILTER (down = 1) AS last, round(avg(net_stitches) FILTER (down > 1), 6) AS prior_mean FROM r WHERE n >= 4 GROUP BY 1"))
def session_last_against_prior(spark, d):
    return op.last_against_prior(sessions(spark, d)).withColumn("prior_mean", F.round("prior_mean", 6))


@query(sql("sessions", f""", {DAILY}, f AS (SELECT project_id, list(stitches ORDER BY stitches) AS v FROM daily WHERE stitches > 0 GROUP BY 1)
    SELECT d.project_id, date, stitches, CAST(CASE WHEN stitches <= 0 THEN 0 WHEN stitches <= v[CAST(floor(len(v) * 0.25) AS INTEGER) + 1] THEN 1 WHEN stitches <= v[CAST(floor(len(v) * 0.5) AS INTEGER) + 1] THEN 2 WHEN stitches <= v[CAST(floor(len(v) * 0.75) AS INTEGER) + 1] THEN 3 ELSE 4 END AS INTEGER) AS bin FROM daily d LEFT JOIN f USING (project_id)"""))
def session_percentile_bins(spark, d):
    return op.percentile_bins(sessions(spark, d))


@query(sql("sessions", ", r AS (SELECT *, dense_rank() OVER (PARTITION BY project_id ORDER BY date DESC) AS k FROM sessions QUALIFY k <= 10) SELECT project_id, session_id, date, CAST(k AS INTEGER) AS date_rank, CAST(row_number() OVER (PARTITION BY project_id ORDER BY k, start_time DESC, ord DESC) AS INTEGER) AS position FROM r"))
def session_timeline(spark, d):
    return op.timeline(sessions(spark, d))


@query(sql("sessions", f""", t AS (SELECT project_id, coalesce(sum(net_stitches) FILTER (date = {DAY}), 0) AS today, coalesce(sum(net_stitches) FILTER (date BETWEEN date_trunc('week', {DAY}) AND {DAY}), 0) AS week, coalesce(sum(net_stitches) FILTER (date BETWEEN date_trunc('month', {DAY}) AND {DAY}), 0) AS month FROM sessions GROUP BY 1)
    SELECT project_id, CAST(least(100, floor(today / 50.0 * 100 + 0.5)) AS BIGINT) AS today_percent, CAST(least(100, floor(week / 400.0 * 100 + 0.5)) AS BIGINT) AS week_percent, CAST(least(100, floor(month / 2000.0 * 100 + 0.5)) AS BIGINT) AS month_percent, today >= 50 AS today_met, week >= 400 AS week_met, month >= 2000 AS month_met, CAST(CASE WHEN month < 2000 THEN ceil((2000 - month) / (date_diff('day', {DAY}, last_day({DAY})) + 1)::DOUBLE) ELSE 0 END AS BIGINT) AS needed_per_day FROM t"""))
def session_goal_progress(spark, d):
    return op.goal_progress(sessions(spark, d), AS_OF, 50, 400, 2000)


@query(sql("sessions targets", "SELECT project_id, greatest(0, total - done) AS remaining, max(date) + CAST(ceil(greatest(0, total - done) / 30.0) AS INTEGER) AS done_on FROM targets JOIN sessions USING (project_id) GROUP BY project_id, total, done"))
def session_what_if(spark, d):
    return op.what_if(sessions(spark, d), targets(spark, d), AS_OF, 30)


@query(sql("sessions", f", {DAILY}, spine AS (SELECT project_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT project_id FROM sessions)) SELECT s.project_id, s.date, coalesce(stitches, 0) AS stitches, CAST(isodow(s.date) - 1 AS INTEGER) AS column FROM spine s LEFT JOIN daily d ON s.project_id = d.project_id AND s.date = d.date").replace("AS column", 'AS "column"'))
def session_month_calendar(spark, d):
    return op.month_calendar(sessions(spark, d), "2024-01")


@query(sql("sessions", "SELECT project_id, CAST(floor(avg(duration_seconds) + 0.5) AS BIGINT) AS mean_seconds FROM sessions GROUP BY 1"))
def session_mean_seconds(spark, d):
    return op.mean_session(sessions(spark, d))


@query(sql("sessions", f", {DAILY}, r AS (SELECT *, stitches::DOUBLE / nullif(max(stitches) OVER (PARTITION BY project_id), 0) AS r FROM daily) SELECT project_id, date, CAST(CASE WHEN coalesce(r, 0) <= 0 THEN 0 WHEN r < 0.25 THEN 1 WHEN r < 0.5 THEN 2 WHEN r < 0.75 THEN 3 ELSE 4 END AS INTEGER) AS bin FROM r"))
def session_heat_bins(spark, d):
    return op.heat_bins(sessions(spark, d))


@query(sql("sessions targets", f", {DAILY}, {PACE}, {OVERVIEW}, {STREAKS} SELECT o.project_id, net, per_hour, o.active_days, percent, days_left, current AS current_streak, longest AS longest_streak FROM overview o JOIN streaks USING (project_id)"))
def dashboard(spark, d):
    return plan.dashboard(sessions(spark, d), targets(spark, d), AS_OF)
