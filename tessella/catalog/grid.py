"""Queries over charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, sql
from tessella.operators import grid as op
from tessella.registry import query

LIVE = "live AS (SELECT * FROM cells WHERE thread_id NOT IN ('__skip__', '__empty__'))"
PARTS = f"{LIVE}, parts AS (SELECT *, trim(unnest(string_split(thread_id, '+'))) AS thread, 1.0::DOUBLE / len(string_split(thread_id, '+')) AS share FROM live)"
REGIONS = """per AS (SELECT project_id, x // 10 AS rx, y // 10 AS ry, thread_id, count(*) AS n, CAST(sum(done) AS BIGINT) AS done FROM live GROUP BY ALL),
    regions AS (SELECT project_id, rx, ry, CAST(sum(n) AS BIGINT) AS total, CAST(sum(done) AS BIGINT) AS done, count(*) AS n_ids, max(n) AS top_n, arg_min(thread_id, struct_pack(a := -n, b := thread_id)) AS top_id FROM per GROUP BY 1, 2, 3)"""
IMPACT = """, z AS (SELECT project_id, max(x) + 1 AS w, max(y) + 1 AS h FROM cells GROUP BY 1), q AS (SELECT r.*, w, h, (w + 9) // 10 AS cols, (h + 9) // 10 AS rows, done / total::DOUBLE AS p FROM regions r JOIN z ON z.project_id = r.project_id),
    n AS (SELECT a.project_id, a.rx, a.ry, sum(b.p) AS s FROM q a JOIN q b ON a.project_id = b.project_id AND abs(a.rx - b.rx) + abs(a.ry - b.ry) = 1 GROUP BY 1, 2, 3),
    k AS (SELECT q.*, coalesce(s, 0) AS s, CAST(q.rx > 0 AS INTEGER) + CAST(q.ry > 0 AS INTEGER) + CAST(q.rx < cols - 1 AS INTEGER) + CAST(q.ry < rows - 1 AS INTEGER) AS c FROM q LEFT JOIN n ON n.project_id = q.project_id AND n.rx = q.rx AND n.ry = q.ry)
    SELECT project_id, rx, ry, round(CASE WHEN p >= 1 THEN -1 ELSE 0.30::DOUBLE * CASE WHEN c > 0 THEN s / c ELSE 0 END + 0.20::DOUBLE * (top_n / total::DOUBLE) + 0.25::DOUBLE * p * p + 0.10::DOUBLE * (1 - 0.3::DOUBLE * sqrt(pow((rx + 0.5) * 10 - w / 2.0::DOUBLE, 2) + pow((ry + 0.5) * 10 - h / 2.0::DOUBLE, 2)) / sqrt(pow(w / 2.0::DOUBLE, 2) + pow(h / 2.0::DOUBLE, 2))) + 0.15::DOUBLE / (1 + (total - done) / 20.0::DOUBLE) END, 6) AS score FROM k"""
#: Connected cells by a recursive walk from every cell to lower labels; a small chart is enough of a limit for it.
WALK = f"""{LIVE}, e AS (SELECT a.project_id, a.idx AS i, b.idx AS j FROM live a JOIN live b ON a.project_id = b.project_id AND a.thread_id = b.thread_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
    reach(project_id, i, j) AS (SELECT project_id, idx, idx FROM live UNION SELECT r.project_id, r.i, e.j FROM reach r JOIN e ON e.project_id = r.project_id AND e.i = r.j),
    labels AS (SELECT project_id, i AS idx, min(j) AS label FROM reach GROUP BY 1, 2)"""


def walk(body: str) -> str:
    return sql("cells", f", {WALK} {body}").replace("WITH cells", "WITH RECURSIVE cells", 1)


@query(sql("cells", f", {PARTS}, t AS (SELECT project_id, count(DISTINCT thread) AS n_threads FROM parts GROUP BY 1) SELECT project_id, count(*) AS total, CAST(sum(done) AS BIGINT) AS done, n_threads, sum(done) >= count(*) AS complete FROM live JOIN t USING (project_id) GROUP BY project_id, n_threads"))
def grid_summary(spark, d):
    return op.summary(cells(spark, d))


@query(sql("cells", f", {LIVE}, h AS (SELECT project_id, thread_id, count(*) AS n, min(idx) AS first_idx FROM live GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY n DESC, first_idx) AS INTEGER) AS rank FROM h) SELECT *, CAST((rank - 1) % 24 AS INTEGER) AS symbol FROM r"))
def grid_histogram(spark, d):
    return op.histogram(cells(spark, d))


@query(sql("cells", f", {PARTS} SELECT project_id, thread, count(*) AS total, CAST(sum(done) AS BIGINT) AS done, CAST(count(*) - sum(done) AS BIGINT) AS remaining, CAST(floor(sum(done) / count(*)::DOUBLE * 100 + 0.5) AS BIGINT) AS percent FROM parts GROUP BY 1, 2"))
def grid_colour_progress(spark, d):
    return op.colour_progress(cells(spark, d))


@query(sql("cells", f", {PARTS}, u AS (SELECT thread, sum(share) AS stitches FROM parts GROUP BY 1) SELECT thread, stitches, floor(stitches / (SELECT sum(stitches) FROM u) * 100 * 10 + 0.5) / 10 AS percent FROM u ORDER BY stitches DESC, thread LIMIT 10"))
def grid_most_used(spark, d):
    return op.most_used(cells(spark, d))


@query(sql("cells", ", s AS (SELECT project_id, x // 10 AS tx, y // 10 AS ty, count(*) FILTER (thread_id NOT IN ('__skip__', '__empty__')) AS total, CAST(coalesce(sum(done) FILTER (thread_id NOT IN ('__skip__', '__empty__')), 0) AS BIGINT) AS done FROM cells GROUP BY 1, 2, 3) SELECT *, CAST(CASE WHEN total > 0 THEN floor(done * 100 / total::DOUBLE + 0.5) ELSE 100 END AS BIGINT) AS percent, total > 0 AND done >= total AS is_done FROM s"))
def grid_sections(spark, d):
    return op.sections(cells(spark, d))


@query(sql("cells", f", {PARTS} SELECT project_id, x // 10 AS tx, y // 10 AS ty, thread, count(*) AS total, CAST(sum(done) AS BIGINT) AS done FROM parts GROUP BY 1, 2, 3, 4"))
def grid_section_threads(spark, d):
    return op.section_threads(cells(spark, d))


@query(sql("cells", f", {LIVE}, s AS (SELECT a.project_id, a.idx, count(*) AS n FROM live a JOIN live b ON a.project_id = b.project_id AND a.thread_id = b.thread_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.idx <> b.idx GROUP BY 1, 2) SELECT l.project_id, l.idx, coalesce(n, 0) AS n, n IS NULL AS confetti FROM live l LEFT JOIN s ON l.project_id = s.project_id AND l.idx = s.idx"))
def grid_like_neighbours(spark, d):
    return op.like_neighbours(cells(spark, d))


@query(sql("cells", f""", {LIVE}, n AS (SELECT a.project_id, a.idx, a.thread_id = b.thread_id AS same, b.x > a.x OR b.y > a.y AS ahead FROM live a JOIN live b ON a.project_id = b.project_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
    s AS (SELECT DISTINCT project_id, idx FROM n WHERE same), t AS (SELECT project_id, count(*) AS total FROM live GROUP BY 1), k AS (SELECT project_id, count(*) AS n_like FROM s GROUP BY 1), c AS (SELECT project_id, count(*) FILTER (NOT same) / count(*)::DOUBLE AS rate FROM n WHERE ahead GROUP BY 1)
    SELECT t.project_id, round((total - coalesce(n_like, 0)) / total::DOUBLE, 6) AS isolation, round(coalesce(rate, 0), 6) AS change_rate FROM t LEFT JOIN k USING (project_id) LEFT JOIN c USING (project_id)"""))
def grid_change_metrics(spark, d):
    return op.change_metrics(cells(spark, d)).withColumns({c: F.round(c, 6) for c in ("isolation", "change_rate")})


@query(walk("SELECT * FROM labels"))
def grid_components(spark, d):
    return op.components(cells(spark, d))


@query(walk(", s AS (SELECT project_id, label, count(*) AS n FROM labels GROUP BY 1, 2), c AS (SELECT project_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singles, CAST(coalesce(sum(n) FILTER (n IN (2, 3)), 0) AS BIGINT) AS small_cluster_cells FROM s GROUP BY 1) SELECT *, floor((singles + small_cluster_cells) / total::DOUBLE * 100 * 10 + 0.5) / 10 AS percent FROM c"))
def grid_confetti(spark, d):
    c = cells(spark, d)
    return op.confetti(c, op.components(c))


@query(walk(", s AS (SELECT project_id, label, count(*) AS n FROM labels GROUP BY 1, 2) SELECT project_id, CASE WHEN n = 1 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 20 THEN '5-19' ELSE '20+' END AS band, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_cells FROM s GROUP BY 1, 2"))
def grid_cluster_bands(spark, d):
    return op.cluster_bands(op.components(cells(spark, d)))


@query(walk(", s AS (SELECT l.project_id, thread_id, label, count(*) AS n, sum(done) AS done, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM labels JOIN live l ON l.project_id = labels.project_id AND l.idx = labels.idx GROUP BY 1, 2, 3) SELECT project_id, thread_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(done) AS BIGINT) AS done, count(*) AS n_clusters, max(n) AS largest, min(a) AS min_x, max(b) AS max_x, min(c) AS min_y, max(d) AS max_y FROM s GROUP BY 1, 2"))
def grid_colour_metrics(spark, d):
    c = cells(spark, d)
    return op.colour_metrics(c, op.components(c))


@query(sql("cells", f""", {LIVE}, p AS (SELECT a.project_id, a.idx, b.x - a.x AS dx, b.y - a.y AS dy FROM live a JOIN live b ON a.project_id = b.project_id AND a.thread_id = b.thread_id AND a.idx <> b.idx WHERE greatest(abs(b.x - a.x), abs(b.y - a.y)) <= 20),
    m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY project_id, idx ORDER BY greatest(abs(dx), abs(dy)), dy, dx) = 1) SELECT l.project_id, l.idx, round(coalesce(sqrt(dx * dx + dy * dy), 999), 6) AS distance FROM live l LEFT JOIN m ON l.project_id = m.project_id AND l.idx = m.idx"""))
def grid_nearest_like(spark, d):
    return op.nearest_like(cells(spark, d)).withColumn("distance", F.round("distance", 6))


@query(sql("cells", f", {LIVE}, {REGIONS} SELECT *, CAST(floor(done / total::DOUBLE * 100 + 0.5) AS BIGINT) AS percent FROM regions"))
def grid_regions(spark, d):
    return op.regions(cells(spark, d))


@query(sql("cells", f", {LIVE}, {REGIONS} {IMPACT}"))
def grid_impact(spark, d):
    return op.impact(cells(spark, d)).withColumn("score", F.round("score", 6))


@query(sql("cells", ", m AS (SELECT project_id, x, y FROM cells WHERE thread_id = 't3'), s AS (SELECT unnest([{'dir': 0, 'dx': 0, 'dy': -1}, {'dir': 1, 'dx': 1, 'dy': 0}, {'dir': 2, 'dx': 0, 'dy': 1}, {'dir': 3, 'dx': -1, 'dy': 0}]) AS s) SELECT a.project_id, a.x, a.y, s.dir FROM m a, s WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.project_id = a.project_id AND b.x = a.x + s.dx AND b.y = a.y + s.dy)"))
def grid_outline(spark, d):
    return op.outline(cells(spark, d), "t3")


@query(sql("cells", "SELECT project_id, CASE WHEN thread_id = 't3' THEN 't4' ELSE thread_id END AS thread_id, count(*) AS n FROM cells GROUP BY 1, 2"))
def grid_replaced(spark, d):
    return op.replaced(cells(spark, d), "t3", "t4")


@query(sql("cells", "SELECT project_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells WHERE thread_id <> '__skip__' GROUP BY 1"))
def grid_crop(spark, d):
    return op.crop(cells(spark, d))


@query(sql("cells", f", {PARTS} SELECT project_id, idx < 150 AS wrapped, idx FROM parts WHERE thread = 't2' AND done = 0 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY idx < 150, idx) = 1"))
def grid_next_open(spark, d):
    return op.next_open(cells(spark, d), "t2", 150)


@query(sql("cells", f""", {LIVE}, z AS (SELECT project_id, max(x) + 1 AS w, max(y) + 1 AS h FROM cells GROUP BY 1), a AS (SELECT project_id, h, unnest(range(0, CAST(greatest(0, ceil((w - 8) / 6.0)) AS BIGINT) + 1)) AS px FROM z), b AS (SELECT project_id, px, unnest(range(0, CAST(greatest(0, ceil((h - 12) / 10.0)) AS BIGINT) + 1)) AS py FROM a)
    SELECT l.project_id, px, py, count(*) AS n, count(DISTINCT thread_id) AS n_ids FROM live l JOIN b ON l.project_id = b.project_id AND x >= px * 6 AND x < px * 6 + 8 AND y >= py * 10 AND y < py * 10 + 12 GROUP BY 1, 2, 3"""))
def grid_pages(spark, d):
    return op.pages(cells(spark, d))


@query(sql("cells", f", {LIVE} SELECT project_id, thread_id, count(*) AS n FROM live WHERE x + 0.5 + y + 0.5 >= 8 AND y + 0.5 < 20 AND x + 0.5 < 14 AND y + 0.5 - (x + 0.5) <= 12 AND x + 0.5 >= 0 GROUP BY 1, 2"))
def grid_polygon(spark, d):
    return op.inside_polygon(cells(spark, d), [(0.0, 8.0), (8.0, 0.0), (14.0, 0.0), (14.0, 20.0), (8.0, 20.0), (0.0, 12.0)])
