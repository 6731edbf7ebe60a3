"""Queries over palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, lab_points, sql, stash, threads
from tessella.catalog.colour import CATALOGUE, FIRSTS, OWNED, PAIRS, STOCK, delta_sql, lab_sql, owned
from tessella.operators import colour as colour_op
from tessella.operators import palette as op
from tessella.registry import query


OWN_PALETTE = f"{OWNED}, {FIRSTS.format('owned').replace('firsts AS', 'own_firsts AS')}, {lab_sql('own_firsts', 'thread_id, ord', 'own_palette')}"


def charted(spark, d):
    """Every fourth point has a charted thread."""
    p = lab_points(spark, d).where("id % 4 = 0")
    return p.select(F.col("id").alias("src_id"), (F.col("id") % 50 + 1).alias("dst_id"), F.when(F.col("id") % 8 == 0, "official").otherwise("reconciled").alias("confidence"))


@query(sql("lab_points threads", f""", {CATALOGUE}, {PAIRS}, {delta_sql('pairs', 'x')}, best AS (SELECT * FROM x WHERE id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY delta, ord) = 1)
    SELECT id, id % 50 + 1 AS thread_id, CAST(NULL AS DOUBLE) AS delta, 'charted-' || CASE WHEN id % 8 = 0 THEN 'official' ELSE 'reconciled' END AS how FROM lab_points WHERE id % 4 = 0
    UNION ALL SELECT id, CASE WHEN delta <= 15 THEN thread_id END, round(delta, 6), CASE WHEN delta <= 10 THEN 'nearest' WHEN delta <= 15 THEN 'near-miss' ELSE 'none' END FROM best"""))
def palette_proposals(spark, d):
    found = op.proposals(lab_points(spark, d), charted(spark, d), colour_op.colours(threads(spark, d)))
    return found.withColumn("delta", F.round("delta", 6))


@query(sql("lab_points threads stash", f", {STOCK}, own AS (SELECT p.*, s.owned FROM palette p JOIN stash s ON s.id = p.thread_id), pairs AS (SELECT p.id, thread_id, ord, owned, p.id % 6 AS needed, l AS l1, a AS a1, p.b AS b1, lab_l AS l2, lab_a AS a2, lab_b AS b2 FROM lab_points p, own), {delta_sql('pairs', 'x')}, r AS (SELECT *, owned >= needed AS enough FROM x WHERE delta <= 25) SELECT id, thread_id, round(delta, 6) AS delta, enough, count(*) OVER (PARTITION BY id) AS n_in_reach FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY NOT enough, delta, ord) = 1"))
def palette_in_stock_first(spark, d):
    have = colour_op.colours(owned(spark, d)).join(stash(spark, d).select(F.col("id").alias("thread_id"), "owned"), "thread_id")
    return op.in_stock_first(lab_points(spark, d).withColumn("needed", F.col("id") % 6), have, 25.0).withColumn("delta", F.round("delta", 6))


@query(sql("cells", "SELECT project_id, idx, array_to_string(list_transform(string_split(thread_id, '+'), lambda t: CASE t WHEN 't2' THEN 't5' WHEN 't4' THEN 't1' ELSE t END), '+') AS thread_id FROM cells"))
def palette_remap(spark, d):
    mapping = spark.createDataFrame([("t2", "t5"), ("t4", "t1")], "old_id string, new_id string")
    return op.remap(cells(spark, d), mapping)


@query(sql("threads stash", f", {CATALOGUE}, s AS (SELECT thread_id, row_number() OVER (ORDER BY lab_l, ord) - 1 AS i FROM palette), {OWN_PALETTE}, t AS (SELECT thread_id AS target_id, row_number() OVER (ORDER BY lab_l, ord) - 1 AS j FROM own_palette) SELECT thread_id, target_id FROM s JOIN t ON s.i % (SELECT count(*) FROM t) = t.j"))
def palette_by_lightness(spark, d):
    """Palette of the catalogue against that of the stock."""
    return op.by_lightness(colour_op.colours(threads(spark, d)), colour_op.colours(owned(spark, d)))


COLOURS = "colours AS (SELECT * FROM (VALUES ('t1', 1, 20.0::DOUBLE, 5.0::DOUBLE, 5.0::DOUBLE), ('t2', 2, 40.0, 30.0, 10.0), ('t3', 3, 60.0, -20.0, 15.0), ('t4', 4, 45.0, 28.0, 12.0), ('t5', 5, 80.0, 0.0, -30.0), ('t6', 6, 30.0, 10.0, -10.0), ('t2+t3', 7, 50.0, 5.0, 12.5)) v(thread_id, ord, c_l, c_a, c_b))"
COUNTS = "n AS (SELECT project_id, thread_id, count(*) AS n FROM cells WHERE thread_id NOT IN ('__skip__', '__empty__') GROUP BY 1, 2)"


def colours(spark):
    rows = [("t1", 1, 20.0, 5.0, 5.0), ("t2", 2, 40.0, 30.0, 10.0), ("t3", 3, 60.0, -20.0, 15.0), ("t4", 4, 45.0, 28.0, 12.0), ("t5", 5, 80.0, 0.0, -30.0), ("t6", 6, 30.0, 10.0, -10.0), ("t2+t3", 7, 50.0, 5.0, 12.5)]
    return spark.createDataFrame(rows, "thread_id string, ord int, c_l double, c_a double, c_b double")


def _merge(keep: str, lose: str, source: str = "n") -> str:
    return f"""SELECT project_id, thread_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT project_id, thread_id, n FROM {source} WHERE {keep}
        UNION ALL SELECT a.project_id, k.thread_id, a.n FROM (SELECT * FROM {source} WHERE {lose}) a JOIN colours x ON x.thread_id = a.thread_id JOIN (SELECT * FROM {source} WHERE {keep}) k ON k.project_id = a.project_id JOIN colours y ON y.thread_id = k.thread_id
        QUALIFY row_number() OVER (PARTITION BY a.project_id, a.thread_id ORDER BY pow(x.c_l - y.c_l, 2) + pow(x.c_a - y.c_a, 2) + pow(x.c_b - y.c_b, 2), y.ord) = 1) GROUP BY 1, 2"""


@query(sql("cells", f", {COLOURS}, {COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, thread_id) AS rank FROM n) {_merge('rank <= 4', 'rank > 4', 'r')}"))
def palette_capped(spark, d):
    return op.capped(cells(spark, d), colours(spark), 4)


@query(sql("cells", f", {COLOURS}, {COUNTS} {_merge('n >= 12', 'n < 12', 'n')}"))
def palette_without_rare(spark, d):
    return op.without_rare(cells(spark, d), colours(spark), 12)


@query(sql("cells", f", {COUNTS}, p AS (SELECT project_id, thread_id, unnest(string_split(thread_id, '+')) AS t FROM n), w AS (SELECT project_id, thread_id, max(CASE t WHEN 't1' THEN 0 WHEN 't2' THEN 1 WHEN 't3' THEN 0 ELSE 2 END) AS s FROM p GROUP BY 1, 2) SELECT project_id, thread_id, CASE s WHEN 0 THEN 'owned' WHEN 1 THEN 'low' ELSE 'missing' END AS status FROM w"))
def palette_worst_status(spark, d):
    stock = spark.createDataFrame([("t1", 9), ("t2", 2), ("t3", 5), ("t4", 0)], "thread string, owned int")
    return op.worst_status(cells(spark, d), stock)


@query(sql("cells", f", {COUNTS} SELECT project_id, thread_id, CASE WHEN thread_id = 't3' THEN 0 ELSE n END AS n FROM n"))
def palette_with_zero_rows(spark, d):
    n = op.counts(cells(spark, d))
    return op.with_zero_rows(n.where("thread_id <> 't3'"), n)


HUE = "CASE WHEN h < 30 THEN 'Red' WHEN h < 60 THEN 'Orange' WHEN h < 90 THEN 'Yellow' WHEN h < 170 THEN 'Green' WHEN h < 200 THEN 'Cyan' WHEN h < 260 THEN 'Blue' WHEN h < 330 THEN 'Purple' ELSE 'Red' END"


@query(sql("threads stash", f""", x AS (SELECT t.id, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, t.b / 255.0::DOUBLE AS z, owned FROM threads t LEFT JOIN stash s ON s.id = t.id), m AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM x),
    h AS (SELECT *, (hi + lo) / 2 AS light, CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) END AS s, CASE WHEN hi = lo THEN 0 WHEN hi = x THEN 60 * ((y - z) / (hi - lo) + CASE WHEN y < z THEN 6 ELSE 0 END) WHEN hi = y THEN 60 * ((z - x) / (hi - lo) + 2) ELSE 60 * ((x - y) / (hi - lo) + 4) END AS h FROM m), k AS (SELECT id, owned, s, light, {HUE} AS hue FROM h WHERE s >= 0.12),
    w AS (SELECT * FROM k WHERE light >= 0.08 AND light <= 0.92), s AS (SELECT hue, sum(id % 5 + 1) / (SELECT sum(id % 5 + 1) FROM w)::DOUBLE AS share FROM w GROUP BY 1), t AS (SELECT hue, count(*) AS n_threads FROM k WHERE owned > 7 GROUP BY 1)
    SELECT hue, round(share, 6) AS share, coalesce(n_threads, 0) AS n_threads, CASE WHEN share > 0.15 AND coalesce(n_threads, 0) = 0 THEN 'high' WHEN share > 0.08 AND coalesce(n_threads, 0) <= 1 THEN 'medium' ELSE 'none' END AS gap FROM s LEFT JOIN t USING (hue)"""))
def palette_hue_gaps(spark, d):
    t = threads(spark, d)
    have = t.join(stash(spark, d).where("owned > 7").select("id"), "id", "left_semi")
    return op.hue_gaps(t.withColumn("n", F.col("id") % 5 + 1), have).withColumn("share", F.round("share", 6))


@query(sql("cells", ", c AS (SELECT project_id, max(x) + 1 AS w, max(y) + 1 AS h FROM cells GROUP BY 1), f AS (SELECT *, CASE WHEN fabric = 28 THEN 14 ELSE fabric END AS p FROM c, (SELECT unnest([11, 14, 16, 18, 20, 22, 25, 28, 32]) AS fabric)) SELECT project_id, fabric, floor(w / p::DOUBLE * 10 + 0.5) / 10 AS w_in, floor(h / p::DOUBLE * 10 + 0.5) / 10 AS h_in, floor(w / p::DOUBLE * 2.54 * 10 + 0.5) / 10 AS w_cm, floor(h / p::DOUBLE * 2.54 * 10 + 0.5) / 10 AS h_cm FROM f"))
def palette_finished_sizes(spark, d):
    size = cells(spark, d).groupBy("project_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return op.finished_sizes(size)
