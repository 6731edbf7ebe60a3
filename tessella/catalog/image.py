"""Queries over images: one for each supplier, 20 pixels wide; the last row is padded with the last pixel."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.adapters import SQL, cells, sql, table, threads
from tessella.catalog.colour import CATALOGUE, lab_sql
from tessella.operators import colour as colour_op
from tessella.operators import grid as grid_op
from tessella.operators import image as op
from tessella.operators import palette as palette_op
from tessella.registry import query


def pixels(spark, d):
    li = table(spark, d, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    k = F.col("l_partkey")
    n = li.select(F.col("l_suppkey").alias("image_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")).alias("n"), (k * 37 % 256).cast("int").alias("r"), (k * 91 % 256).cast("int").alias("g"), (k * 151 % 256).cast("int").alias("b"))
    return n.select("image_id", "idx", (F.col("idx") % 20).alias("x"), F.floor(F.col("idx") / 20).alias("y"), "r", "g", "b")


PIXELS = """WITH raw AS (SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS idx, count(*) OVER (PARTITION BY l_suppkey) AS n, CAST(l_partkey * 37 % 256 AS INTEGER) AS r, CAST(l_partkey * 91 % 256 AS INTEGER) AS g, CAST(l_partkey * 151 % 256 AS INTEGER) AS b FROM lineitem),
    pixels AS (SELECT image_id, idx, idx % 20 AS x, idx // 20 AS y, r, g, b FROM raw)"""
#: The last row goes on with its last pixel.
PADDED = """ends AS (SELECT image_id, max(x) AS w, arg_max(struct_pack(idx := idx, x := x, y := y, r := r, g := g, b := b), idx) AS e FROM pixels GROUP BY 1), full_ AS (SELECT image_id, idx, x, y, r, g, b FROM pixels UNION ALL SELECT image_id, e.idx + t, e.x + t, e.y, e.r, e.g, e.b FROM (SELECT *, unnest(range(1, w - e.x + 1)) AS t FROM ends))"""
AROUND = f"""{PADDED}, size AS (SELECT image_id, max(x) AS w, max(y) AS h FROM pixels GROUP BY 1), steps AS (SELECT dx, dy, (dy + 1) * 3 + dx + 1 AS k FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
    near AS (SELECT p.image_id, p.idx, k, q.r, q.g, q.b, 0.299::DOUBLE * q.r + 0.587::DOUBLE * q.g + 0.114::DOUBLE * q.b AS v FROM full_ p JOIN size USING (image_id), steps s, full_ q WHERE q.image_id = p.image_id AND q.x = greatest(0, least(w, p.x + dx)) AND q.y = greatest(0, least(h, p.y + dy)))"""


def _sum(weights, v: str) -> str:
    return f"sum({v} * [{', '.join(map(str, weights))}][k + 1])"


SOBEL = f"g AS (SELECT image_id, idx, {_sum(op.SOBEL_X, 'v')} AS gx, {_sum(op.SOBEL_Y, 'v')} AS gy FROM near GROUP BY 1, 2), sobel AS (SELECT image_id, idx, sqrt(gx * gx + gy * gy) AS magnitude FROM g)"


@query(f"{PIXELS}, {AROUND} SELECT image_id, idx, {', '.join(f'{_sum(op.GAUSSIAN, v)} / 16.0::DOUBLE AS {v}' for v in 'rgb')} FROM near GROUP BY 1, 2")
def image_gaussian(spark, d):
    return op.gaussian(pixels(spark, d))


@query(f"{PIXELS}, {AROUND} SELECT image_id, idx, {', '.join(f'list_sort(list({v}))[5] AS {v}' for v in 'rgb')} FROM near GROUP BY 1, 2")
def image_median(spark, d):
    return op.median(pixels(spark, d))


@query(f"{PIXELS}, {AROUND}, {SOBEL} SELECT image_id, idx, round(magnitude, 5) AS magnitude FROM sobel")
def image_sobel(spark, d):
    return op.sobel(pixels(spark, d)).withColumn("magnitude", F.round("magnitude", 5))


SCALE = "CASE WHEN max({v}) OVER w > min({v}) OVER w THEN ({v} - min({v}) OVER w) / (max({v}) OVER w - min({v}) OVER w) ELSE 0 END"


@query(f"""{PIXELS}, {AROUND}, {SOBEL}, a AS (SELECT p.image_id, p.idx, p.x, p.y, {SCALE.format(v='magnitude')} AS v FROM sobel s JOIN pixels p ON p.image_id = s.image_id AND p.idx = s.idx WINDOW w AS (PARTITION BY p.image_id)), taps AS (SELECT t, exp(-(t * t) / 18.0::DOUBLE) AS e FROM (SELECT unnest(range(-9, 10)) AS t)), k AS (SELECT t, e / (SELECT sum(e) FROM taps) AS e FROM taps),
    b AS (SELECT a.image_id, a.idx, a.x, a.y, sum(q.v * e) AS v FROM a JOIN size z USING (image_id), k, a q WHERE q.image_id = a.image_id AND q.y = a.y AND q.x = greatest(0, least(z.w, a.x + t)) GROUP BY 1, 2, 3, 4), c AS (SELECT b.image_id, b.idx, sum(q.v * e) AS v FROM b JOIN size z USING (image_id), k, b q WHERE q.image_id = b.image_id AND q.x = b.x AND q.y = greatest(0, least(z.h, b.y + t)) GROUP BY 1, 2)
    SELECT image_id, idx, round({SCALE.format(v='v')}, 5) AS saliency FROM c WINDOW w AS (PARTITION BY image_id)""")
def image_saliency(spark, d):
    return op.saliency(pixels(spark, d)).withColumn("saliency", F.round("saliency", 5))


@query(f"""{PIXELS}, {PADDED}, size AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM full_ GROUP BY 1), mask AS (SELECT image_id, x, y FROM full_ WHERE r + g + b > 250), steps AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
    holes AS (SELECT DISTINCT p.image_id, p.x + dx AS x, p.y + dy AS y FROM full_ p, steps WHERE r + g + b <= 250), eroded AS (SELECT m.* FROM mask m WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE h.image_id = m.image_id AND h.x = m.x AND h.y = m.y))
    SELECT DISTINCT e.image_id, e.x + dx AS x, e.y + dy AS y FROM eroded e JOIN size USING (image_id), steps WHERE e.x + dx BETWEEN 0 AND w - 1 AND e.y + dy BETWEEN 0 AND h - 1""")
def image_opened(spark, d):
    p = op.padded(pixels(spark, d))
    size = p.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return op.opened(p.where("r + g + b > 250").select("image_id", "x", "y"), size)


@query(f"{PIXELS}, threads AS ({SQL['threads']}), {CATALOGUE}, d AS (SELECT DISTINCT r, g, b FROM pixels), {lab_sql('d', 'r, g, b', 'z')}, best AS (SELECT z.r, z.g, z.b, arg_min(thread_id, struct_pack(a := (z.lab_l - p.lab_l) * (z.lab_l - p.lab_l) + (z.lab_a - p.lab_a) * (z.lab_a - p.lab_a) + (z.lab_b - p.lab_b) * (z.lab_b - p.lab_b), b := ord)) AS thread_id FROM z, palette p GROUP BY 1, 2, 3) SELECT image_id, idx, thread_id FROM pixels JOIN best USING (r, g, b)")
def image_mapped(spark, d):
    return op.mapped(pixels(spark, d), colour_op.colours(threads(spark, d)))


@query(f"{PIXELS}, bg AS (SELECT *, 1 AS one FROM (VALUES (200, 180, 160)) v(r, g, b)), {lab_sql('bg', 'one', 'q')}, {lab_sql('pixels', 'image_id, idx', 'z')} SELECT image_id, count(*) AS n FROM z, q WHERE sqrt(pow(z.lab_l - q.lab_l, 2) + pow(z.lab_a - q.lab_a, 2) + pow(z.lab_b - q.lab_b, 2)) >= 60 GROUP BY 1")
def image_without_background(spark, d):
    return op.without_background(pixels(spark, d), 200, 180, 160, 60.0).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


#: Rounds of assigning colours to centres and moving these, each over the images that still move.
LLOYD = f"""{PIXELS.replace('WITH raw', 'WITH RECURSIVE raw')}, counted AS (SELECT image_id, r, g, b, count(*) AS n FROM pixels GROUP BY ALL), {lab_sql('counted', 'image_id, r, g, b, n', 'z')}, firsts AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS cluster FROM z QUALIFY cluster <= 8),
    k(image_id, cluster, n, c_l, c_a, c_b, far, step) AS (SELECT image_id, cluster, CAST(0 AS BIGINT), lab_l, lab_a, lab_b, 1e9::DOUBLE, 0 FROM firsts UNION ALL
        SELECT image_id, cluster, n, m_l, m_a, m_b, max(pow(m_l - c_l, 2) + pow(m_a - c_a, 2) + pow(m_b - c_b, 2)) OVER (PARTITION BY image_id), step + 1 FROM (
            SELECT w.image_id, w.cluster, coalesce(m.n, 0) AS n, coalesce(m_l, c_l) AS m_l, coalesce(m_a, c_a) AS m_a, coalesce(m_b, c_b) AS m_b, c_l, c_a, c_b, step FROM k w LEFT JOIN (
                SELECT image_id, cluster, CAST(sum(n) AS BIGINT) AS n, sum(lab_l * n) / sum(n) AS m_l, sum(lab_a * n) / sum(n) AS m_a, sum(lab_b * n) / sum(n) AS m_b FROM (
                    SELECT z.image_id, z.n, lab_l, lab_a, lab_b, arg_min(v.cluster, struct_pack(d := pow(lab_l - c_l, 2) + pow(lab_a - c_a, 2) + pow(lab_b - c_b, 2), c := v.cluster)) AS cluster FROM z JOIN k v ON v.image_id = z.image_id GROUP BY z.image_id, z.r, z.g, z.b, z.n, lab_l, lab_a, lab_b) GROUP BY 1, 2) m ON m.image_id = w.image_id AND m.cluster = w.cluster WHERE far > 0.25 AND step < 20))"""


@query(f"{LLOYD} SELECT image_id, CAST(cluster AS INTEGER) AS cluster, n, round(c_l, 6) AS c_l, round(c_a, 6) AS c_a, round(c_b, 6) AS c_b FROM k WHERE step > 0 AND (far <= 0.25 OR step = 20)")
def image_quantised(spark, d):
    return op.quantised(pixels(spark, d)).withColumns({f"c_{x}": F.round(f"c_{x}", 6) for x in ("l", "a", "b")})


@query()
def image_dithered(spark, d):
    """Error diffusion: no SQL."""
    return op.dithered(pixels(spark, d), [("k", 0, 0, 0), ("w", 255, 255, 255), ("r", 200, 30, 30), ("g", 30, 160, 60), ("b", 40, 60, 190)])


@query("WITH RECURSIVE q AS (SELECT o_orderkey AS id, o_orderkey % 23 AS x0, o_custkey % 19 AS y0, o_custkey % 29 AS x1, o_orderkey % 17 AS y1 FROM orders), w(id, i, x, y, x1, y1, dx, dy, sx, sy, e) AS (SELECT id, CAST(0 AS BIGINT), x0, y0, x1, y1, abs(x1 - x0), -abs(y1 - y0), CASE WHEN x0 < x1 THEN 1 ELSE -1 END, CASE WHEN y0 < y1 THEN 1 ELSE -1 END, abs(x1 - x0) - abs(y1 - y0) FROM q UNION ALL SELECT id, i + 1, x + CASE WHEN 2 * e >= dy THEN sx ELSE 0 END, y + CASE WHEN 2 * e <= dx THEN sy ELSE 0 END, x1, y1, dx, dy, sx, sy, e + CASE WHEN 2 * e >= dy THEN dy ELSE 0 END + CASE WHEN 2 * e <= dx THEN dx ELSE 0 END FROM w WHERE x <> x1 OR y <> y1) SELECT id, i, x, y FROM w")
def image_lines(spark, d):
    o = table(spark, d, "orders")
    return op.lines(o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 23).alias("x0"), (F.col("o_custkey") % 19).alias("y0"), (F.col("o_custkey") % 29).alias("x1"), (F.col("o_orderkey") % 17).alias("y1")))


def stepped_sql(x: str, steps) -> str:
    arms = " ".join(f"WHEN {x} <= {upper!r} THEN {base!r}::DOUBLE + ({x} - {start!r}) * {slope!r}::DOUBLE" if upper is not None else f"ELSE {base!r}::DOUBLE + ({x} - {start!r}) * {slope!r}::DOUBLE" for upper, base, start, slope in steps)
    return f"CASE {arms} END"


@query(sql("cells", f""", live AS (SELECT * FROM cells WHERE thread_id NOT IN ('__skip__', '__empty__')), n AS (SELECT a.project_id, a.idx, a.thread_id = b.thread_id AS same, b.x > a.x OR b.y > a.y AS ahead FROM live a JOIN live b ON a.project_id = b.project_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
    t AS (SELECT project_id, count(*) AS total, count(DISTINCT thread_id) FILTER (contains(thread_id, '+')) AS n_blends FROM live GROUP BY 1), k AS (SELECT project_id, count(DISTINCT idx) AS n_like FROM n WHERE same GROUP BY 1), c AS (SELECT project_id, count(*) FILTER (NOT same) / count(*)::DOUBLE AS rate FROM n WHERE ahead GROUP BY 1), u AS (SELECT project_id, count(DISTINCT trim(p)) AS n_threads FROM (SELECT project_id, unnest(string_split(thread_id, '+')) AS p FROM live) GROUP BY 1),
    m AS (SELECT t.project_id, total, n_threads, n_blends, 11 + t.project_id % 18 AS fabric, t.project_id % 70 AS bs, (total - coalesce(n_like, 0)) / total::DOUBLE AS iso, coalesce(rate, 0) AS rate, log10(greatest(total, 1)::DOUBLE) AS lg FROM t JOIN u USING (project_id) LEFT JOIN k USING (project_id) LEFT JOIN c USING (project_id)),
    f AS (SELECT *, 0.25::DOUBLE * least(1.0, least(1.0, {stepped_sql('n_threads', palette_op.PALETTE_STEPS)}) * 0.78::DOUBLE + 0.22::DOUBLE * CASE WHEN n_blends <= 0 THEN 0 WHEN n_blends <= 3 THEN 0.08 WHEN n_blends <= 8 THEN 0.15 ELSE 0.22 END) + 0.28::DOUBLE * iso + 0.17::DOUBLE * rate
        + 0.15::DOUBLE * least(1.0, least(1.0, {stepped_sql('lg', palette_op.SIZE_STEPS)}) * 0.8::DOUBLE + 0.2::DOUBLE * least(0.5, {stepped_sql('fabric', palette_op.FABRIC_STEPS)})) + 0.15::DOUBLE * least(1.0, least(1.0, {stepped_sql('bs', palette_op.BACKSTITCH_STEPS)}) * 0.7::DOUBLE + 0.3::DOUBLE * CASE WHEN fabric >= 25 THEN 0.2 WHEN fabric >= 20 THEN 0.1 ELSE 0 END) AS mixed FROM m),
    g AS (SELECT project_id, CAST(least(100, greatest(0, floor(CASE WHEN iso > 0.7 AND mixed < 0.3 THEN 0.3::DOUBLE ELSE mixed END * 100 + 0.5))) AS BIGINT) AS score FROM f)
    SELECT project_id, score, CASE WHEN score <= 25 THEN 'Beginner' WHEN score <= 50 THEN 'Intermediate' WHEN score <= 75 THEN 'Advanced' ELSE 'Expert' END AS tier FROM g"""))
def grid_difficulty(spark, d):
    c = cells(spark, d)
    blends = grid_op.stitchable(c).groupBy("project_id").agg(F.count_distinct(F.when(F.col("thread_id").contains("+"), F.col("thread_id"))).alias("n_blends"))
    m = grid_op.summary(c).join(blends, "project_id").join(grid_op.change_metrics(c), "project_id")
    return palette_op.difficulty(m.withColumns({"fabric": 11 + F.col("project_id") % 18, "n_backstitches": F.col("project_id") % 70}))
