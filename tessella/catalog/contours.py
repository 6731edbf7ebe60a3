"""Queries over the rings around regions of charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, sql
from tessella.operators import contours as op
from tessella.registry import query

RINGS = """m AS (SELECT project_id, x, y FROM cells WHERE thread_id = 't3'), s AS (SELECT unnest([{'dir': 0, 'dx': 0, 'dy': -1}, {'dir': 1, 'dx': 1, 'dy': 0}, {'dir': 2, 'dx': 0, 'dy': 1}, {'dir': 3, 'dx': -1, 'dy': 0}]) AS s),
    o AS (SELECT a.project_id, a.x, a.y, s.dir AS dir FROM m a, s WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.project_id = a.project_id AND b.x = a.x + s.dx AND b.y = a.y + s.dy)),
    e AS (SELECT project_id, dir, y * 4294967296 + x * 4 + dir AS edge, x + [0, 1, 1, 0][dir + 1] AS x0, y + [0, 0, 1, 1][dir + 1] AS y0, x + [1, 1, 0, 0][dir + 1] AS x1, y + [0, 1, 1, 0][dir + 1] AS y1 FROM o),
    n AS (SELECT a.project_id, a.edge, arg_min(b.edge, (a.dir + 5 - b.dir) % 4) AS next FROM e a JOIN e b ON b.project_id = a.project_id AND b.x0 = a.x1 AND b.y0 = a.y1 GROUP BY 1, 2),
    w(project_id, ring, edge, pos) AS (SELECT project_id, edge, edge, 0 FROM n UNION ALL SELECT w.project_id, w.ring, n.next, w.pos + 1 FROM w JOIN n ON n.project_id = w.project_id AND n.edge = w.edge WHERE n.next > w.ring),
    whole AS (SELECT w.project_id, w.ring FROM w JOIN n ON n.project_id = w.project_id AND n.edge = w.edge AND n.next = w.ring),
    rings AS (SELECT w.project_id, w.ring, CAST(w.pos AS BIGINT) AS pos, CAST(e.x0 AS BIGINT) AS x, CAST(e.y0 AS BIGINT) AS y FROM w JOIN whole USING (project_id, ring) JOIN e ON e.project_id = w.project_id AND e.edge = w.edge)"""
#: Places on closed rings, by remainder.
NEAR = "z AS (SELECT *, count(*) OVER (PARTITION BY project_id, ring) AS n FROM {}), near AS (SELECT z.*, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, r.x AS rx, r.y AS ry FROM z JOIN z p ON p.project_id = z.project_id AND p.ring = z.ring AND p.pos = (z.pos + z.n - 1) % z.n JOIN z q ON q.project_id = z.project_id AND q.ring = z.ring AND q.pos = (z.pos + 1) % z.n JOIN z r ON r.project_id = z.project_id AND r.ring = z.ring AND r.pos = (z.pos + 2) % z.n)"
TURNS = f"{RINGS}, {NEAR.format('rings')}, turns AS (SELECT project_id, ring, row_number() OVER (PARTITION BY project_id, ring ORDER BY pos) - 1 AS pos, x, y FROM near WHERE (x - px) * (qy - y) - (y - py) * (qx - x) <> 0)"


def recursive(views: str, body: str) -> str:
    return sql(views, body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive("cells", f", {RINGS} SELECT * FROM rings"))
def contour_rings(spark, d):
    return op.rings(cells(spark, d), "t3")


@query(recursive("cells", f", {TURNS} SELECT * FROM turns"))
def contour_corners(spark, d):
    return op.corners(op.rings(cells(spark, d), "t3"))


def _curve(v: str) -> str:
    return f"round(0.5::DOUBLE * (2 * {v} + (q{v} - p{v}) * f + (2 * p{v} - 5 * {v} + 4 * q{v} - r{v}) * f * f + (3 * {v} - p{v} - 3 * q{v} + r{v}) * f * f * f), 6) AS {v}"


@query(recursive("cells", f", {TURNS}, {NEAR.format('turns').replace('z AS', 'z2 AS', 1).replace('near AS', 'near2 AS').replace('FROM z JOIN', 'FROM z2 z JOIN').replace('JOIN z ', 'JOIN z2 ')}, g AS (SELECT *, unnest(range(0, 4)) AS s FROM near2), h AS (SELECT *, s / 4.0::DOUBLE AS f FROM g) SELECT project_id, ring, pos * 4 + s AS pos, {_curve('x')}, {_curve('y')} FROM h"))
def contour_smoothed(spark, d):
    """Every ring has four corners at least."""
    return op.smoothed(op.corners(op.rings(cells(spark, d), "t3"))).withColumns({v: F.round(v, 6) for v in "xy"})
