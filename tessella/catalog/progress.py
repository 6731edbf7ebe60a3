"""Queries over progress inside and across projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, library, sessions, sql, targets
from tessella.catalog.browse import PROJECTS, projects
from tessella.catalog.grid import IMPACT, LIVE, PARTS, REGIONS
from tessella.operators import grid as grid_op
from tessella.operators import progress as op
from tessella.operators import sessions as session_op
from tessella.registry import query

HALVES = "halves AS (SELECT project_id, idx, thread_id, CAST(idx % 7 = 0 AS INTEGER) AS fwd, CAST(idx % 11 = 0 AS INTEGER) AS bck, CAST(idx % 14 = 0 AS INTEGER) AS fwd_done, CAST(idx % 33 = 0 AS INTEGER) AS bck_done FROM cells WHERE idx % 7 = 0 OR idx % 11 = 0)"
MARKERS = "markers AS (SELECT project_id, x, y, CASE WHEN idx % 34 <> 0 THEN thread_id END AS colour FROM cells WHERE idx % 17 = 0)"
PROGRESS = f"{PARTS}, progress AS (SELECT project_id, thread, count(*) AS total, CAST(sum(done) AS BIGINT) AS done, CAST(count(*) - sum(done) AS BIGINT) AS remaining, CAST(floor(sum(done) / count(*)::DOUBLE * 100 + 0.5) AS BIGINT) AS percent FROM parts GROUP BY 1, 2)"


def halves(spark, d):
    i = F.col("idx")
    bit = lambda n: (i % n == 0).cast("int")
    return cells(spark, d).where("idx % 7 = 0 or idx % 11 = 0").select("project_id", "idx", "thread_id", bit(7).alias("fwd"), bit(11).alias("bck"), bit(14).alias("fwd_done"), bit(33).alias("bck_done"))


def markers(spark, d):
    return cells(spark, d).where("idx % 17 = 0").select("project_id", "x", "y", F.when(F.col("idx") % 34 != 0, F.col("thread_id")).alias("colour"))


@query(sql("cells", f", {HALVES} SELECT project_id, CAST(sum(fwd + bck) AS BIGINT) AS total, CAST(sum(fwd_done + bck_done) AS BIGINT) AS done FROM halves GROUP BY 1"))
def progress_half_stitches(spark, d):
    return op.half_counts(halves(spark, d))


@query(sql("cells", f", {HALVES}, {LIVE}, h AS (SELECT project_id, sum(fwd + bck) AS t, sum(fwd_done + bck_done) AS k FROM halves GROUP BY 1), w AS (SELECT project_id, count(*) AS n, sum(done) AS d FROM live GROUP BY 1), c AS (SELECT project_id, n + 0.5::DOUBLE * coalesce(t, 0) AS total, d + 0.5::DOUBLE * coalesce(k, 0) AS done FROM w LEFT JOIN h USING (project_id)) SELECT *, CASE WHEN total > 0 THEN floor(done * 100 / total * 10 + 0.5) / 10 ELSE 0 END AS percent FROM c"))
def progress_combined(spark, d):
    return op.combined(cells(spark, d), halves(spark, d))


@query(sql("cells", f", {MARKERS} SELECT project_id, colour, count(*) AS n FROM markers WHERE colour IS NOT NULL GROUP BY 1, 2"))
def progress_parked(spark, d):
    return op.parked(markers(spark, d))


@query(sql("cells", f", {PROGRESS}, s AS (SELECT *, bool_or(done > 0) OVER (PARTITION BY project_id) AS a FROM progress), t AS (SELECT * FROM s WHERE done > 0 OR NOT a), u AS (SELECT *, bool_or(done < total) OVER (PARTITION BY project_id) AS b FROM t) SELECT project_id, thread, total, done, remaining, percent FROM u WHERE done < total OR NOT b"))
def progress_focusable(spark, d):
    return op.focusable(grid_op.colour_progress(cells(spark, d)))


@query(sql("cells", f", {MARKERS}, p AS (SELECT DISTINCT project_id, x, y FROM markers), j AS (SELECT c.*, p.x IS NOT NULL AS parked, thread_id NOT IN ('__skip__', '__empty__') AS live FROM cells c LEFT JOIN p ON p.project_id = c.project_id AND p.x = c.x AND p.y = c.y) SELECT project_id, x // 10 AS bx, y // 10 AS by, count(*) FILTER (live) AS n, count(*) FILTER (live AND done = 0 AND NOT parked) = 0 AS complete FROM j GROUP BY 1, 2, 3"))
def progress_blocks(spark, d):
    return op.blocks(cells(spark, d), markers(spark, d))


@query(sql("cells", """, z AS (SELECT project_id, (max(x) + 10) // 10 AS cols, (max(y) + 10) // 10 AS rows FROM cells GROUP BY 1), a AS (SELECT *, unnest(range(0, rows)) AS v FROM z), b AS (SELECT *, unnest(range(0, cols)) AS u FROM a)
    SELECT project_id, u AS bx, v AS "by", lead(u) OVER w AS next_x, lead(v) OVER w AS next_y, least(cols - 1, u + 1) AS step_x, least(rows - 1, v + 1) AS step_y, u = cols - 1 AND v = 0 AS "first" FROM b WINDOW w AS (PARTITION BY project_id ORDER BY v, u)"""))
def progress_block_order(spark, d):
    size = cells(spark, d).groupBy("project_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return op.block_order(size, corner="TR")


@query(sql("sessions", """, e AS (SELECT project_id, session_id // 10 AS session, session_id % 4 AS u, session_id % 3 AS v, start_time AS t FROM sessions), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, session ORDER BY t, v, u) AS INTEGER) AS sequence, row_number() OVER (PARTITION BY project_id ORDER BY t DESC, session DESC, v DESC, u DESC) AS back FROM e)
    SELECT project_id, session, u AS bx, v AS "by", t AS "at", sequence FROM s WHERE back <= 5"""))
def progress_completion_log(spark, d):
    k = F.col("session_id")
    return op.completion_log(sessions(spark, d).select("project_id", F.floor(k / 10).alias("session"), (k % 4).alias("bx"), (k % 3).alias("by"), F.col("start_time").alias("at")), 5)


@query(sql("sessions", ", g AS (SELECT project_id, colour, arg_min(date, ord) AS first_date, arg_max(date, ord) AS last_date, count(*) AS n_sessions FROM sessions GROUP BY 1, 2), p AS (SELECT *, unnest(['view', 'click', 'purchase', 'none']) AS c FROM (SELECT DISTINCT project_id FROM sessions)), q AS (SELECT project_id, c AS colour, project_id % 9 AS total, least(project_id % 9, len(c)) AS done FROM p) SELECT q.project_id, q.colour, first_date, last_date, coalesce(n_sessions, 0) AS n_sessions, CAST(CASE WHEN total > 0 THEN floor(done * 100 / total::DOUBLE + 0.5) ELSE 0 END AS BIGINT) AS percent, total > 0 AND done >= total AS complete FROM q LEFT JOIN g ON g.project_id = q.project_id AND g.colour = q.colour"))
def progress_colour_timeline(spark, d):
    s = sessions(spark, d)
    names = s.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, ("view", "click", "purchase", "none")))).alias("thread"))
    counts = names.select("project_id", "thread", (F.col("project_id") % 9).alias("total"), F.least(F.col("project_id") % 9, F.length("thread").cast("long")).alias("done"))
    return op.timeline_with_completion(session_op.colour_timeline(s), counts)


WORK = "work AS (SELECT t.project_id, t.done, t.total, CAST(sum(duration_seconds) AS BIGINT) AS seconds, count(DISTINCT date) AS days FROM targets t JOIN sessions s ON s.project_id = t.project_id GROUP BY 1, 2, 3)"


def work(spark, d):
    return targets(spark, d).join(sessions(spark, d).groupBy("project_id").agg(F.sum("duration_seconds").alias("seconds"), F.count_distinct("date").alias("days")), "project_id")


@query(sql("sessions targets", f", {WORK} SELECT project_id, CAST(floor(total / 40.0::DOUBLE * 3600 + 0.5) AS BIGINT) AS all_seconds, greatest(0, CAST(floor((total - done) / 40.0::DOUBLE * 3600 + 0.5) AS BIGINT)) AS left_seconds, CAST(CASE WHEN seconds > 0 AND done > 0 THEN floor(done / (seconds / 3600.0::DOUBLE) + 0.5) END AS BIGINT) AS per_hour FROM work"))
def progress_time_estimates(spark, d):
    return op.time_estimates(work(spark, d))


@query(sql("sessions targets", f", {WORK} SELECT project_id, round(greatest(0, total - done) / CASE WHEN project_id % 3 <> 0 THEN 60 + project_id % 50 ELSE 100 END::DOUBLE, 6) AS hours FROM work"))
def progress_hours_left(spark, d):
    return op.hours_left(work(spark, d).withColumn("per_hour", F.when(F.col("project_id") % 3 != 0, 60 + F.col("project_id") % 50))).withColumn("hours", F.round("hours", 6))


@query(sql("sessions targets", f", {PROJECTS}, {WORK}, k AS (SELECT p.project_id, p.done, p.total, seconds, days, p.project_id % 10 AS owner FROM p JOIN work USING (project_id)), s AS (SELECT *, CASE WHEN total > 0 THEN done / total::DOUBLE ELSE 0 END AS share FROM k) SELECT owner, project_id, round(share, 6) AS share, {', '.join(f'CAST(rank() OVER (PARTITION BY owner ORDER BY {c} DESC, project_id) AS INTEGER) AS by_{c}' for c in ('total', 'seconds', 'days', 'share'))} FROM s"))
def progress_comparison(spark, d):
    both = projects(spark, d).join(work(spark, d).select("project_id", "seconds", "days"), "project_id").withColumn("owner", F.col("project_id") % 10)
    return op.comparison(both, ("total", "seconds", "days")).withColumn("share", F.round("share", 6))


@query(sql("sessions targets", f", {PROJECTS} SELECT project_id, CASE WHEN total > 0 THEN round(done / total::DOUBLE, 6) ELSE 0 END AS share FROM p ORDER BY CASE WHEN total > 0 THEN done / total::DOUBLE ELSE 0 END DESC, project_id LIMIT 6"))
def progress_top_by_share(spark, d):
    return op.top_by_share(projects(spark, d)).withColumn("share", F.round("share", 6))


@query(sql("cells", f", {PROGRESS}, {REGIONS} {IMPACT.replace('SELECT project_id, rx, ry, round(', ', i AS (SELECT project_id, rx, ry, (').replace(', 6) AS score FROM k', ') AS score FROM k)')}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY round(score, 9) DESC, ry, rx) AS INTEGER) AS rank FROM i WHERE score >= 0 AND NOT (rx = 0 AND ry = 1)), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY remaining, thread) AS INTEGER) AS rank FROM progress WHERE done < total) SELECT project_id, 'region' AS kind, rank, rx || ',' || ry AS what FROM r WHERE rank <= 3 UNION ALL SELECT project_id, 'colour', rank, thread FROM c WHERE rank <= 3"))
def progress_recommendations(spark, d):
    c = cells(spark, d)
    dismissed = c.select("project_id").distinct().select("project_id", F.lit(0).cast("long").alias("rx"), F.lit(1).cast("long").alias("ry"))
    return op.recommendations(grid_op.impact(c), grid_op.colour_progress(c), dismissed)


@query(sql("sessions targets", "SELECT project_id, CASE WHEN project_id % 20 < 2 THEN 'Excellent' WHEN project_id % 20 < 5 THEN 'Good' WHEN project_id % 20 < 8 THEN 'Moderate' WHEN project_id % 20 < 15 THEN 'Challenging' ELSE 'High confetti' END AS tier, floor(total * 0.004::DOUBLE / 1000 * 10 + 0.5) / 10 AS kilometres FROM targets"))
def progress_tiers(spark, d):
    return targets(spark, d).select("project_id", op.confetti_tier(F.col("project_id") % 20).alias("tier"), op.thread_kilometres(F.col("total")).alias("kilometres"))


@query(sql("sessions", "SELECT project_id, CAST(sum(net_stitches) AS BIGINT) AS stitches, 'sessions' AS source FROM sessions WHERE project_id % 2 = 1 GROUP BY 1 UNION ALL SELECT project_id, CAST(sum(net_stitches + 1) AS BIGINT), 'log' FROM sessions WHERE project_id % 2 = 0 GROUP BY 1"))
def progress_lifetime(spark, d):
    s = sessions(spark, d)
    return op.lifetime(s.where("project_id % 2 = 0").select("project_id", (F.col("net_stitches") + 1).alias("count")), s)


@query(sql("library", "SELECT count(*) FILTER (status = 'inprogress') AS active, count(*) FILTER (status = 'completed' AND completed_at >= DATE '1997-01-01') AS finished FROM library"))
def progress_state_counts(spark, d):
    return op.state_counts(library(spark, d), "1997-01-01")


@query(sql("library", ", e AS (SELECT pattern_id, CASE WHEN status = 'wishlist' THEN 'planned' WHEN status = 'inprogress' THEN 'active' ELSE status END AS s, ['stitch', 'finish', 'abandon', 'view'][pattern_id % 4 + 1] AS e, pattern_id % 3 AS n FROM library) SELECT pattern_id, CASE WHEN e = 'finish' THEN 'completed' WHEN e = 'abandon' THEN 'UFO' WHEN e = 'stitch' AND s = 'planned' AND n > 0 THEN 'active' ELSE s END AS state FROM e"))
def progress_states(spark, d):
    k = F.col("pattern_id")
    status = F.when(F.col("status") == "wishlist", "planned").when(F.col("status") == "inprogress", "active").otherwise(F.col("status"))
    event = F.element_at(F.array(*map(F.lit, ("stitch", "finish", "abandon", "view"))), (k % 4 + 1).cast("int"))
    return library(spark, d).select("pattern_id", op.after_event(status, event, k % 3).alias("state"))


@query(sql("sessions", "SELECT project_id, session_id FROM sessions WHERE session_id % 5 IN (0, 2, 4)"))
def progress_valid_sessions(spark, d):
    """A readable start, an unreadable one, a date alone, an unreadable date, neither."""
    k = F.col("session_id") % 5
    s = sessions(spark, d).select("project_id", "session_id", F.when(k == 0, "2024-01-05T10:00:00").when(k == 1, "soon").alias("start_text"), F.when(k == 2, "2024-01-05").when(k == 3, "05/2024").alias("date_text"))
    return op.valid_sessions(s).select("project_id", "session_id")


@query(sql("sessions", """, c AS (SELECT project_id, date AS period, start_time AS t, ord, net_stitches - session_id % 3 * 40 AS net FROM sessions), s AS (SELECT *, sum(net) OVER w AS total FROM c WINDOW w AS (PARTITION BY project_id, period ORDER BY t, ord ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, coalesce(lag(total) OVER (PARTITION BY project_id, period ORDER BY t, ord), 0) AS before FROM s) SELECT project_id, period, t AS "at", CAST(total AS BIGINT) AS total FROM b WHERE total >= 30 AND before < 30"""))
def progress_goal_crossings(spark, d):
    return op.goal_crossings(sessions(spark, d).select("project_id", F.col("date").alias("period"), F.col("start_time").alias("at"), "ord", (F.col("net_stitches") - F.col("session_id") % 3 * 40).alias("net")), 30)


PARTIALS = "parts4 AS (SELECT project_id, idx, thread_id AS base, CASE WHEN idx % 2 = 0 THEN 'a' END AS TL, CASE WHEN idx % 3 = 0 THEN 'a' WHEN idx % 5 = 0 THEN 'b' END AS TR, CASE WHEN idx % 7 < 3 THEN 'b' END AS BL, CASE WHEN idx % 11 < 4 THEN 'a' END AS BR FROM cells WHERE idx % 2 = 0 OR idx % 3 = 0)"


@query(sql("cells", f""", {PARTIALS}, e AS (SELECT project_id, idx, unnest([{{'k': 0, 'c': 'TL', 'v': TL}}, {{'k': 1, 'c': 'TR', 'v': TR}}, {{'k': 2, 'c': 'BL', 'v': BL}}, {{'k': 3, 'c': 'BR', 'v': BR}}]) AS z, CASE WHEN base NOT IN ('__skip__', '__empty__') THEN base END AS base FROM parts4), f AS (SELECT project_id, idx, z.k AS k, z.c AS corner, z.v IS NOT NULL AS own, coalesce(z.v, base) AS thread FROM e WHERE coalesce(z.v, base) IS NOT NULL),
    g AS (SELECT project_id, idx, thread, string_agg(corner, ',' ORDER BY k) AS corners, count(*) AS n, list(corner) FILTER (own) AS own FROM f GROUP BY 1, 2, 3), h AS (SELECT *, CASE WHEN n = 3 THEN 'three-quarter' WHEN corners IN ('TR,BL', 'TL,BR') THEN 'half' END AS kind FROM g)
    SELECT project_id, idx, thread, kind, CASE WHEN corners = 'TR,BL' THEN 'fwd' WHEN corners = 'TL,BR' THEN 'bck' WHEN NOT contains(corners, 'TL') THEN 'TL' WHEN NOT contains(corners, 'TR') THEN 'TR' WHEN NOT contains(corners, 'BL') THEN 'BL' ELSE 'BR' END AS place FROM h WHERE kind IS NOT NULL UNION ALL SELECT project_id, idx, thread, 'quarter', unnest(own) FROM h WHERE kind IS NULL AND own IS NOT NULL"""))
def progress_partial_stitches(spark, d):
    i, t = F.col("idx"), F.lit
    c = cells(spark, d).where("idx % 2 = 0 or idx % 3 = 0")
    corner = {"TL": F.when(i % 2 == 0, t("a")), "TR": F.when(i % 3 == 0, t("a")).when(i % 5 == 0, t("b")), "BL": F.when(i % 7 < 3, t("b")), "BR": F.when(i % 11 < 4, t("a"))}
    return op.partial_stitches(c.select("project_id", "idx", F.col("thread_id").alias("base"), *(v.alias(k) for k, v in corner.items())))


@query(sql("sessions", """, g AS (SELECT project_id, start_time AS t, CASE WHEN start_time < lag(start_time) OVER (PARTITION BY project_id ORDER BY start_time) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM sessions), r AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT project_id, max(t) + INTERVAL 6 HOUR AS export_at, count(*) AS n_changes FROM r GROUP BY project_id, run"""))
def progress_paused_exports(spark, d):
    return op.paused_exports(sessions(spark, d).select("project_id", F.col("start_time").alias("at")), 6 * 3600)
