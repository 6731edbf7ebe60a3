"""Queries over the edges of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalog.colour import lab_sql
from tessella.catalog.image import PADDED, PIXELS, pixels
from tessella.operators import edges as op
from tessella.operators.image import SOBEL_X, SOBEL_Y
from tessella.registry import query

STEPS = "steps AS (SELECT dx, dy, (dy + 1) * 3 + dx + 1 AS k FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))"


def _sum(weights, v: str) -> str:
    return f"sum({v} * [{', '.join(map(str, weights))}][k + 1])"


LAB_SUMS = ", ".join(f"{_sum(w, f'q.lab_{v}')} AS g{v}{axis}" for v in "lab" for w, axis in ((SOBEL_X, "x"), (SOBEL_Y, "y")))
SQUARES = " + ".join(f"g{v}{axis} * g{v}{axis}" for v in "lab" for axis in "xy")


@query(f"""{PIXELS}, {PADDED}, {lab_sql('full_', 'image_id, idx, x, y', 'z')}, {STEPS}, g AS (SELECT p.image_id, p.idx, count(*) AS n, {LAB_SUMS} FROM z p, steps s, z q WHERE q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2)
    SELECT image_id, idx, CASE WHEN n = 9 THEN round(sqrt({SQUARES}), 5) ELSE 0 END AS magnitude FROM pixels JOIN g USING (image_id, idx)""")
def image_lab_sobel(spark, d):
    return op.lab_sobel(pixels(spark, d)).withColumn("magnitude", F.round("magnitude", 5))


TAPS = f"taps AS (SELECT t, exp(-(t * t) / {2 * op.SIGMA * op.SIGMA!r}::DOUBLE) AS e FROM (SELECT unnest(range(-5, 6)) AS t)), kern AS (SELECT t, e / (SELECT sum(e) FROM taps) AS e FROM taps)"
CANNY = f"""{PIXELS.replace('WITH raw', 'WITH RECURSIVE raw')}, {PADDED}, size AS (SELECT image_id, max(x) AS w, max(y) AS h FROM full_ GROUP BY 1), {STEPS}, {TAPS},
    a AS (SELECT image_id, x, y, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS v FROM full_),
    b AS (SELECT a.image_id, a.x, a.y, sum(q.v * e) AS v FROM a JOIN size z USING (image_id), kern, a q WHERE q.image_id = a.image_id AND q.y = a.y AND q.x = greatest(0, least(z.w, a.x + t)) GROUP BY 1, 2, 3),
    c AS (SELECT b.image_id, b.x, b.y, sum(q.v * e) AS v FROM b JOIN size z USING (image_id), kern, b q WHERE q.image_id = b.image_id AND q.x = b.x AND q.y = greatest(0, least(z.h, b.y + t)) GROUP BY 1, 2, 3),
    g AS (SELECT p.image_id, p.x, p.y, {_sum(SOBEL_X, 'q.v')} AS gx, {_sum(SOBEL_Y, 'q.v')} AS gy FROM c p, steps s, c q WHERE q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2, 3 HAVING count(*) = 9),
    m AS (SELECT image_id, x, y, round(sqrt(gx * gx + gy * gy), 6) AS m, abs(degrees(atan2(gy, gx))) AS angle FROM g),
    o AS (SELECT *, CASE WHEN angle < 22.5 OR angle >= 157.5 THEN 1 WHEN angle < 67.5 THEN 1 WHEN angle < 112.5 THEN 0 ELSE 1 END AS ox, CASE WHEN angle < 22.5 OR angle >= 157.5 THEN 0 WHEN angle < 67.5 THEN -1 ELSE 1 END AS oy FROM m WHERE m > 0),
    nms AS (SELECT o.image_id, o.x, o.y, o.m FROM o LEFT JOIN m p ON p.image_id = o.image_id AND p.x = o.x + ox AND p.y = o.y + oy LEFT JOIN m q ON q.image_id = o.image_id AND q.x = o.x - ox AND q.y = o.y - oy WHERE o.m >= coalesce(p.m, 0) AND o.m >= coalesce(q.m, 0)),
    weak AS (SELECT * FROM nms WHERE m >= 30), reach(image_id, x, y) AS (SELECT image_id, x, y FROM weak WHERE m >= 80 UNION SELECT w.image_id, w.x, w.y FROM reach r JOIN weak w ON w.image_id = r.image_id AND abs(w.x - r.x) <= 1 AND abs(w.y - r.y) <= 1)"""


@query(f"{CANNY} SELECT image_id, x, y FROM reach")
def image_canny(spark, d):
    return op.canny(pixels(spark, d))


@query(f"{CANNY}, near AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM reach, steps) SELECT p.image_id, idx, n.x IS NOT NULL AS edge FROM pixels p LEFT JOIN near n ON n.image_id = p.image_id AND n.x = p.x AND n.y = p.y")
def image_edge_map(spark, d):
    return op.edge_map(pixels(spark, d))
