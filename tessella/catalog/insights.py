"""Queries that give text, and live sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import AS_OF, sessions, sql, table, targets
from tessella.catalog.sessions import DAY, WEEKS
from tessella.operators import insights as op
from tessella.registry import query


def _pick(options: tuple[str, ...]) -> str:
    listed = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"[{listed}][project_id % {len(options)} + 1]"


def _fill(text: str, **marks: str) -> str:
    for mark, value in marks.items():
        text = f"replace({text}, '%{mark}', CAST({value} AS VARCHAR))"
    return text


@query(sql("sessions", f""", {WEEKS}, b AS (SELECT project_id, {', '.join(f"CAST(coalesce(max({c}) FILTER (week = '{k}'), 0) AS BIGINT) AS {c}_{k}" for c in ('stitches', 'speed', 'active_days') for k in ('this', 'last'))} FROM weeks GROUP BY 1),
    k AS (SELECT *, CASE WHEN stitches_this = 0 THEN 'none' WHEN stitches_last = 0 AND stitches_this > 0 THEN 'back' WHEN stitches_this > stitches_last THEN 'up' WHEN stitches_this < stitches_last THEN 'down' ELSE 'same' END AS kind FROM b),
    t AS (SELECT *, {_fill('CASE kind ' + ' '.join(f"WHEN '{k}' THEN {_pick(v)}" for k, v in op.WEEKS.items()) + ' END', n='stitches_this', p='CAST(floor((stitches_this - stitches_last) / greatest(1, stitches_last)::DOUBLE * 100 + 0.5) AS BIGINT)', l='stitches_last')} AS volume, speed_this > 0 AND speed_last > 0 AS paced FROM k)
    SELECT project_id, kind, concat_ws(' ', volume, CASE WHEN paced AND speed_this - speed_last > 10 THEN {_fill(_pick(op.FASTER), s='speed_this', o='speed_last')} WHEN paced AND speed_this - speed_last < -10 THEN {_fill(_pick(op.SLOWER), s='speed_this')} END, CASE WHEN active_days_this >= 5 THEN {_fill(_pick(op.ACTIVE), d='active_days_this')} END) AS summary FROM t"""))
def insight_weekly_summary(spark, d):
    return op.weekly_summary(sessions(spark, d), AS_OF)


PEAK = "(SELECT project_id, CAST(hour(start_time) AS BIGINT) AS hour, count(*) AS n FROM sessions WHERE CAST(start_time AS DATE) > {a} AND CAST(start_time AS DATE) <= {b} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, hour) = 1)"


@query(sql("sessions", f""", {WEEKS}, wk AS (SELECT DISTINCT project_id, CAST(date_trunc('week', date) AS DATE) AS m FROM sessions), isl AS (SELECT project_id, m, m - CAST(7 * row_number() OVER (PARTITION BY project_id ORDER BY m) AS INTEGER) AS g FROM wk), cur AS (SELECT project_id, count(*) AS n FROM isl GROUP BY project_id, g HAVING max(m) >= CAST(date_trunc('week', {DAY}) AS DATE) - 7 AND max(m) <= CAST(date_trunc('week', {DAY}) AS DATE)),
    r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_time, ord) AS up, row_number() OVER (PARTITION BY project_id ORDER BY start_time DESC, ord DESC) AS down, count(*) OVER (PARTITION BY project_id) AS n FROM sessions),
    sp AS (SELECT project_id, sum(net_stitches) FILTER (up <= 5) / (sum(duration_seconds) FILTER (up <= 5) / 3600.0::DOUBLE) AS a, sum(net_stitches) FILTER (down <= 5) / (sum(duration_seconds) FILTER (down <= 5) / 3600.0::DOUBLE) AS b FROM r WHERE n >= 10 GROUP BY 1), ch AS (SELECT project_id, (b - a) / a AS c FROM sp WHERE a > 0 AND b > 0),
    ww AS (SELECT project_id, coalesce(max(stitches) FILTER (week = 'this'), 0) AS t, coalesce(max(stitches) FILTER (week = 'last'), 0) AS l FROM weeks GROUP BY 1),
    f AS (SELECT project_id, 1 AS o, CASE WHEN n >= 8 THEN 'streak_long' WHEN n >= 4 THEN 'streak_mid' ELSE 'streak_short' END AS kind, CAST(n AS BIGINT) AS value FROM cur WHERE n >= 2
        UNION ALL SELECT project_id, 2, CASE WHEN c > 0 THEN 'speed_up' ELSE 'speed_down' END, CAST(floor(abs(c) * 100 + 0.5) AS BIGINT) FROM ch WHERE c >= 0.1 OR c <= -0.15
        UNION ALL SELECT x.project_id, 3, 'peak_shift', x.hour - y.hour FROM {PEAK.format(a=DAY + ' - 30', b=DAY)} x JOIN {PEAK.format(a=DAY + ' - 60', b=DAY + ' - 30')} y ON x.project_id = y.project_id WHERE abs(x.hour - y.hour) >= 2 AND x.project_id IN (SELECT project_id FROM sessions GROUP BY 1 HAVING count(*) >= 20)
        UNION ALL SELECT project_id, 4, 'neglected', CAST({DAY} - max(date) AS BIGINT) FROM sessions GROUP BY 1 HAVING {DAY} - max(date) >= 14
        UNION ALL SELECT project_id, 5, 'wow_up', CAST(floor((t - l) / l::DOUBLE * 100 + 0.5) AS BIGINT) FROM ww WHERE l > 0 AND t > l AND floor((t - l) / l::DOUBLE * 100 + 0.5) >= 20),
    g AS (SELECT * FROM f WHERE NOT (kind = 'speed_up' AND project_id % 4 = 0)), h AS (SELECT * FROM g UNION ALL SELECT project_id, 6, 'fun_thread', CAST(floor(sum(net_stitches) * 0.022::DOUBLE + 0.5) AS BIGINT) FROM sessions WHERE project_id NOT IN (SELECT project_id FROM g) GROUP BY 1 HAVING floor(sum(net_stitches) * 0.022::DOUBLE + 0.5) >= 1)
    SELECT project_id, kind, value, CAST(row_number() OVER (PARTITION BY project_id ORDER BY o) AS INTEGER) AS position FROM h"""))
def insight_cards(spark, d):
    s = sessions(spark, d)
    dismissed = s.where("project_id % 4 = 0").select("project_id", F.lit("speed_up").alias("kind")).distinct()
    return op.cards(s, AS_OF, dismissed)


@query(sql("sessions targets", "SELECT t.project_id, printf('%d of %d stitches (%d%%) in %d hours', done, total, CAST(floor(done / greatest(total, 1)::DOUBLE * 100 + 0.5) AS BIGINT), CAST(floor(sum(duration_seconds) / 3600.0::DOUBLE + 0.5) AS BIGINT)) AS text FROM targets t JOIN sessions s ON s.project_id = t.project_id GROUP BY t.project_id, done, total"))
def insight_share_text(spark, d):
    return op.share_text(sessions(spark, d), targets(spark, d))


@query(sql("sessions", f", d AS (SELECT project_id, {DAY} - max(date) AS k FROM sessions GROUP BY 1) SELECT project_id, CASE WHEN k <= 0 THEN 'Today' WHEN k = 1 THEN 'Yesterday' WHEN k < 7 THEN k || ' days ago' WHEN k // 7 = 1 THEN '1 week ago' ELSE (k // 7) || ' weeks ago' END AS label FROM d"))
def insight_last_seen(spark, d):
    return op.last_seen(sessions(spark, d), AS_OF)


@query("""WITH a AS (SELECT user_id AS project_id, ts, CAST(floor(value) AS BIGINT) % 50 AS completed, event_id % 5 AS undone FROM events), o AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOURS, TRUE) AS opens FROM a WINDOW w AS (PARTITION BY project_id ORDER BY ts)),
    k AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY project_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o) SELECT project_id, min(ts) AS start_time, max(ts) AS end_time, CAST(sum(completed) - sum(undone) AS BIGINT) AS net, CAST(greatest(1, floor(epoch(max(ts))) - floor(epoch(min(ts)))) AS BIGINT) AS seconds FROM k GROUP BY project_id, k HAVING sum(completed) + sum(undone) > 0""")
def live_session_windows(spark, d):
    a = table(spark, d, "events").select(F.col("user_id").alias("project_id"), "ts", (F.floor("value").cast("long") % 50).alias("completed"), (F.col("event_id") % 5).alias("undone"))
    return op.live_sessions(a, 360)
