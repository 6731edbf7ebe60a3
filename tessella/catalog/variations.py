"""Queries over seeded variations of palettes and threads for the centres of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import SQL, sql, threads
from tessella.catalog.colour import lab_sql
from tessella.catalog.image import LLOYD, PIXELS, pixels
from tessella.operators import colour as colour_op
from tessella.operators import image as image_op
from tessella.operators import variations as op
from tessella.registry import query

SIZE, SEED, CENTRES = 40, 4_294_960_000, 8

#: The generator in whole numbers of 128 bits.
NUMBER = """s1 AS (SELECT *, CAST((seed + 1831565813::HUGEINT * i) % 4294967296 AS BIGINT) AS t0 FROM s0),
    s2 AS (SELECT *, CAST(CAST(xor(t0, t0 >> 15) AS HUGEINT) * (t0 | 1) % 4294967296 AS BIGINT) AS t1 FROM s1),
    s3 AS (SELECT *, CAST(xor(t1, CAST((t1 + CAST(xor(t1, t1 >> 7) AS HUGEINT) * (t1 | 61)) % 4294967296 AS BIGINT)) AS BIGINT) AS t2 FROM s2),
    drawn AS (SELECT project_id, i, n - i AS last, CAST(floor(xor(t2, t2 >> 14) / 4294967296.0::DOUBLE * (n - i + 1)) AS BIGINT) AS j FROM s3)"""


@query(sql("threads", f""", pools AS (SELECT id // {SIZE} AS project_id, list(CAST(id AS BIGINT) ORDER BY (id * 7) % 11, id) AS pool, count(*) AS n FROM threads GROUP BY 1),
    s0 AS (SELECT project_id, n, ({SEED} + project_id * 977) % 4294967296 AS seed, unnest(range(1, n)) AS i FROM pools), {NUMBER}""").replace("WITH threads", "WITH RECURSIVE threads") + """,
    r(project_id, i, n, pool) AS (SELECT project_id, 0::BIGINT, n, pool FROM pools UNION ALL SELECT r.project_id, d.i, n, pool[1:least(j, last)] || CASE WHEN j < last THEN [pool[last + 1]] || pool[j + 2:last] || [pool[j + 1]] ELSE [pool[last + 1]] END || pool[last + 2:n] FROM r JOIN drawn d ON d.project_id = r.project_id AND d.i = r.i + 1)
    SELECT project_id, CAST(place AS INTEGER) AS place, pool[place + 1] AS item FROM (SELECT *, unnest(range(0, n)) AS place FROM r WHERE i = n - 1) WHERE place < greatest(2, floor(n * 0.75 + 0.5))""")
def palette_variation(spark, d):
    t = threads(spark, d).select(F.floor(F.col("id") / SIZE).alias("project_id"), ((F.col("id") * 7) % 11).alias("ord"), F.col("id").alias("item"))
    seeds = t.select("project_id").distinct().withColumn("seed", (SEED + F.col("project_id") * 977) % 2**32)
    return op.shuffled(t, "project_id", seeds, "greatest(2, floor(n * 0.75 + 0.5))")


@query(f"""{LLOYD}, threads AS ({SQL['threads']}), first_threads AS (SELECT arg_min(id, ord) AS thread_id, min(ord) AS ord, r, g, b FROM threads GROUP BY r, g, b), {lab_sql('first_threads', 'thread_id, ord', 'palette')},
    final AS (SELECT image_id, CAST(cluster AS INTEGER) AS cluster, c_l, c_a, c_b FROM k WHERE step > 0 AND (far <= 0.25 OR step = 20)),
    near AS (SELECT image_id, cluster, thread_id, row_number() OVER (PARTITION BY image_id, cluster ORDER BY pow(c_l - lab_l, 2) + pow(c_a - lab_a, 2) + pow(c_b - lab_b, 2), ord) AS rank FROM final, palette QUALIFY rank <= {CENTRES}),
    pick(image_id, cluster, thread_id, taken) AS (SELECT DISTINCT image_id, 0, NULL::BIGINT, []::BIGINT[] FROM final UNION ALL
        SELECT p.image_id, c.cluster, arg_min(c.thread_id, c.rank), list_append(any_value(p.taken), arg_min(c.thread_id, c.rank)) FROM pick p JOIN near c ON c.image_id = p.image_id AND c.cluster = p.cluster + 1 AND NOT list_contains(p.taken, c.thread_id) GROUP BY p.image_id, c.cluster)
    SELECT image_id, cluster, thread_id AS id FROM pick WHERE cluster > 0""")
def image_threads(spark, d):
    centres = image_op.quantised(pixels(spark, d), CENTRES).select("image_id", "cluster", F.col("c_l").alias("l"), F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    return op.each_once(op.nearest_entries(centres, colour_op.colours(threads(spark, d)), CENTRES), "image_id")


DRAWS = f"""draws AS (SELECT image_id AS project_id, seed, unnest(range(1, {CENTRES} + 1)) AS i, count(*) AS n FROM pixels, (SELECT {SEED} AS seed) GROUP BY image_id, seed), s0 AS (SELECT * FROM draws), {NUMBER}, bits AS (SELECT project_id AS image_id, i, n, CAST(xor(t2, t2 >> 14) AS HUGEINT) AS bits FROM s3)"""


@query(f"""{PIXELS.replace('WITH raw', 'WITH RECURSIVE raw')}, {DRAWS}, {lab_sql('pixels', 'image_id, idx, r, g, b', 'z')},
    p(image_id, idx, r, g, b, lab_l, lab_a, lab_b, ds, step, chosen) AS (SELECT image_id, idx, r, g, b, lab_l, lab_a, lab_b, 4611686018427387904::HUGEINT, 1::BIGINT, idx = CAST(bits * n // 4294967296 AS BIGINT) FROM z JOIN bits USING (image_id) WHERE i = 1 UNION ALL
        SELECT image_id, idx, r, g, b, lab_l, lab_a, lab_b, ds, step, idx = min(idx) FILTER (acc * 4294967296 >= bits * total) OVER (PARTITION BY image_id) FROM (
            SELECT v.*, bits, sum(ds) OVER (PARTITION BY v.image_id ORDER BY idx) AS acc, sum(ds) OVER (PARTITION BY v.image_id) AS total FROM (
                SELECT p.image_id, p.idx, p.r, p.g, p.b, p.lab_l, p.lab_a, p.lab_b, least(p.ds, CAST(floor((pow(p.lab_l - q.lab_l, 2) + pow(p.lab_a - q.lab_a, 2) + pow(p.lab_b - q.lab_b, 2)) * 1000000 + 0.5) AS HUGEINT)) AS ds, p.step + 1 AS step FROM p JOIN p q ON q.image_id = p.image_id AND q.chosen WHERE p.step < {CENTRES}) v JOIN bits ON bits.image_id = v.image_id AND i = step AND n >= step))
    SELECT image_id, CAST(step AS INTEGER) AS cluster, r, g, b FROM p WHERE chosen""")
def image_seeded_centres(spark, d):
    p = pixels(spark, d)
    return op.seeded_centres(p, p.select("image_id").distinct().withColumn("seed", F.lit(SEED)), CENTRES)
