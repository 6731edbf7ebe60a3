"""Queries over selections inside charts and the edits made there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, sql
from tessella.catalog.grid import LIVE, walk
from tessella.catalog.palette import COLOURS, colours
from tessella.operators import selection as op
from tessella.registry import query

MASKS = "old AS (SELECT project_id, idx FROM cells WHERE idx % 2 = 0), new AS (SELECT project_id, idx FROM cells WHERE idx % 3 = 0)"
WORDS = ("add", "subtract", "intersect", "replace")


@query(sql("cells", f", {MASKS}, m AS (SELECT 'add' AS how, * FROM (SELECT * FROM old UNION SELECT * FROM new) UNION ALL SELECT 'subtract', * FROM (SELECT * FROM old EXCEPT SELECT * FROM new) UNION ALL SELECT 'intersect', * FROM (SELECT * FROM old INTERSECT SELECT * FROM new) UNION ALL SELECT 'replace', * FROM new) SELECT how, project_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM m GROUP BY 1, 2"))
def selection_masks(spark, d):
    c = cells(spark, d)
    old, new = c.where("idx % 2 = 0"), c.where("idx % 3 = 0")
    parts = [op.masked(old, new, how).select(F.lit(how).alias("how"), "*") for how in WORDS]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.groupBy("how", "project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


@query(sql("cells", f", {LIVE} SELECT project_id, idx FROM live WHERE idx % 2 <> 0"))
def selection_inverted(spark, d):
    c = cells(spark, d)
    return op.inverted(c, c.where("idx % 2 = 0").select("project_id", "idx"))


NEAR = f"{COLOURS}, {LIVE}, tinted AS (SELECT l.*, c_l, c_a, c_b FROM live l JOIN colours USING (thread_id)), s AS (SELECT project_id, c_l AS sl, c_a AS sa, c_b AS sb FROM tinted WHERE idx = 9), near AS (SELECT project_id, idx, x, y FROM tinted JOIN s USING (project_id) WHERE sqrt(pow(c_l - sl, 2) + pow(c_a - sa, 2) + pow(c_b - sb, 2)) <= 25)"


def seeds(spark, d):
    return cells(spark, d).where("idx = 9").select("project_id", "idx")


@query(sql("cells", f", {NEAR} SELECT project_id, idx FROM near"))
def selection_global(spark, d):
    return op.near_seed(cells(spark, d), colours(spark), seeds(spark, d), 25.0).select("project_id", "idx")


@query(sql("cells", f", {NEAR}, reach(project_id, idx, x, y) AS (SELECT project_id, idx, x, y FROM near WHERE idx = 9 UNION SELECT n.project_id, n.idx, n.x, n.y FROM reach r JOIN near n ON n.project_id = r.project_id AND abs(n.x - r.x) + abs(n.y - r.y) = 1) SELECT project_id, idx FROM reach").replace("WITH cells", "WITH RECURSIVE cells", 1))
def selection_flood(spark, d):
    return op.flooded(cells(spark, d), colours(spark), seeds(spark, d), 25.0)


E_ = "x * 2.54::DOUBLE / 14 * 4.8::DOUBLE * 2 / (8.0::DOUBLE * 100 * 6 * (1 - 0.2::DOUBLE))"


@query(sql("cells", f", {LIVE}, n AS (SELECT project_id, thread_id, count(*) AS x FROM live WHERE idx % 2 = 0 GROUP BY 1, 2) SELECT project_id, thread_id, x AS n, round(x / (sum(x) OVER (PARTITION BY project_id))::DOUBLE, 6) AS share, CAST(greatest(1, ceil(CASE WHEN {E_} < 0.01 THEN 0 ELSE {E_} END)) AS BIGINT) AS skeins FROM n"))
def selection_statistics(spark, d):
    c = cells(spark, d)
    return op.statistics(c, c.where("idx % 2 = 0").select("project_id", "idx")).withColumn("share", F.round("share", 6))


@query(walk(", k AS (SELECT project_id, label FROM labels GROUP BY 1, 2 HAVING count(*) < 3), f AS (SELECT project_id, idx FROM labels JOIN k USING (project_id, label)), v AS (SELECT a.project_id, a.idx, a.thread_id AS old_id, b.thread_id AS new_id, count(*) AS n FROM f JOIN live a ON a.project_id = f.project_id AND a.idx = f.idx JOIN live b ON a.project_id = b.project_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2, 3, 4), w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY project_id, idx ORDER BY n DESC, new_id) = 1) SELECT project_id, idx, old_id, new_id FROM w WHERE old_id <> new_id"))
def selection_tidied(spark, d):
    c = cells(spark, d)
    return op.tidied(c, op.everything(c), 3)


@query(sql("cells", ", j AS (SELECT project_id, thread_id FROM cells WHERE thread_id IN ('t2', 't4') OR thread_id = 't5' AND idx % 2 = 0), p AS (SELECT project_id, thread_id, count(*) AS n FROM j GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, thread_id) AS k FROM p) SELECT project_id, CAST(sum(n) AS BIGINT) AS n_changed, array_to_string(list(thread_id ORDER BY k) FILTER (k <= 2), ',') AS top FROM r GROUP BY 1"))
def selection_changed(spark, d):
    c = cells(spark, d)
    t = F.col("thread_id")
    return op.changed(c, c.withColumn("thread_id", F.when(t.isin("t2", "t4") | (t == "t5") & (F.col("idx") % 2 == 0), "t1").otherwise(t)), 2)


@query(sql("cells", f", {COLOURS}, {LIVE}, tinted AS (SELECT l.*, c_l, c_a, c_b FROM live l JOIN colours USING (thread_id)), m AS (SELECT a.project_id, a.idx, max(sqrt(pow(a.c_l - b.c_l, 2) + pow(a.c_a - b.c_a, 2) + pow(a.c_b - b.c_b, 2))) AS s FROM tinted a JOIN tinted b ON a.project_id = b.project_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2) SELECT t.project_id, t.idx, round(coalesce(s, 0), 6) AS strength FROM tinted t LEFT JOIN m ON m.project_id = t.project_id AND m.idx = t.idx"))
def selection_edge_strength(spark, d):
    return op.edge_strength(cells(spark, d), colours(spark)).withColumn("strength", F.round("strength", 6))


PLAN = "plan AS (SELECT DISTINCT project_id, thread_id AS src_id, CASE thread_id WHEN 't1' THEN 't3' WHEN 't2' THEN 't6' WHEN 't4' THEN 't6' WHEN 't5' THEN CASE WHEN project_id % 2 = 0 THEN 't6' ELSE 't9' END END AS dst_id FROM cells WHERE thread_id IN ('t1', 't2', 't4', 't5'))"


def plan(spark, d):
    t = F.col("thread_id")
    dst = F.when(t == "t1", "t3").when(t.isin("t2", "t4"), "t6").when(F.col("project_id") % 2 == 0, "t6").otherwise("t9")
    return cells(spark, d).where(t.isin("t1", "t2", "t4", "t5")).select("project_id", t.alias("src_id"), dst.alias("dst_id")).distinct()


@query(sql("cells", f", {PLAN} SELECT project_id, dst_id, count(DISTINCT src_id) AS n_sources, array_to_string(list_sort(list(DISTINCT src_id)), ',') AS sources FROM plan GROUP BY 1, 2 HAVING count(DISTINCT src_id) > 1"))
def selection_collisions(spark, d):
    return op.collisions(plan(spark, d))


@query(sql("cells", f", {PLAN}, u AS (SELECT project_id, idx, x, y, unnest(string_split(thread_id, '+')) AS src_id FROM cells) SELECT u.project_id, idx, x, y, array_to_string(list_sort(list(coalesce(dst_id, u.src_id))), '+') AS thread_id, CAST(0 AS INTEGER) AS done FROM u LEFT JOIN plan p ON p.project_id = u.project_id AND p.src_id = u.src_id GROUP BY 1, 2, 3, 4"))
def selection_substituted(spark, d):
    return op.substituted(cells(spark, d), plan(spark, d))


#: One merge of each chart in a round: the closest pair of ids that are left, the first in the order of counts among equal ones.
MERGED = f"""{COLOURS}, {LIVE}, n AS (SELECT project_id, thread_id, count(*) AS n, ord, c_l, c_a, c_b FROM live JOIN colours USING (thread_id) GROUP BY ALL),
    k(project_id, pos, thread_id, n, c_l, c_a, c_b, goes, step) AS (SELECT project_id, row_number() OVER w, thread_id, n, c_l, c_a, c_b, row_number() OVER w, 0 FROM n WINDOW w AS (PARTITION BY project_id ORDER BY n DESC, ord) UNION ALL
        SELECT k.project_id, k.pos, k.thread_id, k.n + CASE WHEN k.pos = keep THEN more ELSE 0 END, k.c_l, k.c_a, k.c_b, CASE WHEN k.goes = lose THEN keep ELSE k.goes END, k.step + 1 FROM k JOIN (
            SELECT project_id, CASE WHEN p.a > p.b THEN p.i ELSE p.j END AS keep, CASE WHEN p.a > p.b THEN p.j ELSE p.i END AS lose, CASE WHEN p.a > p.b THEN p.b ELSE p.a END AS more FROM (
                SELECT x.project_id, arg_min(struct_pack(i := x.pos, j := y.pos, a := x.n, b := y.n), struct_pack(d := pow(x.c_l - y.c_l, 2) + pow(x.c_a - y.c_a, 2) + pow(x.c_b - y.c_b, 2), i := x.pos, j := y.pos)) AS p, count(DISTINCT x.pos) + 1 AS alive
                FROM k x JOIN k y ON y.project_id = x.project_id AND y.pos > x.pos WHERE x.goes = x.pos AND y.goes = y.pos GROUP BY 1) WHERE alive > 3) m ON m.project_id = k.project_id)"""


@query(sql("cells", f", {MERGED}, done AS (SELECT * FROM k QUALIFY step = max(step) OVER (PARTITION BY project_id)) SELECT a.project_id, a.thread_id, b.thread_id AS new_id FROM done a JOIN done b ON b.project_id = a.project_id AND b.pos = a.goes").replace("WITH ", "WITH RECURSIVE ", 1))
def selection_reduced(spark, d):
    return op.reduced(cells(spark, d), colours(spark), 3)


@query()
def selection_without_orphans(spark, d):
    """Later clusters see earlier edits: no SQL; compared with a fixture in the tests."""
    return op.without_orphans(cells(spark, d), colours(spark), 2)
