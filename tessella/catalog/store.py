"""Queries over stored projects, stock and libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, library, sql, stash, table, targets
from tessella.catalog.grid import PARTS
from tessella.operators import grid as grid_op
from tessella.operators import store as op
from tessella.operators import sync as sync_op
from tessella.registry import query

KEYED = "metas AS (SELECT CASE WHEN project_id % 4 = 3 THEN 'tmp_' ELSE 'proj_' END || project_id AS key, project_id % 10 AS owner, total, CAST(DATE '2024-01-01' + CAST(project_id % 30 AS INTEGER) AS DATE) AS updated_at FROM targets), summaries AS (SELECT key, total * 2 AS stitches FROM metas WHERE owner <> 5 UNION ALL SELECT 'proj_gone' || owner, 1 FROM metas)"


def metas(spark, d):
    k = F.col("project_id")
    return targets(spark, d).select(F.concat(F.when(k % 4 == 3, "tmp_").otherwise("proj_"), k.cast("string")).alias("key"), (k % 10).alias("owner"), "total", F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("updated_at"))


def summaries(spark, d):
    m = metas(spark, d)
    return m.where("owner <> 5").select("key", (F.col("total") * 2).alias("stitches")).unionByName(m.select(F.concat(F.lit("proj_gone"), F.col("owner").cast("string")).alias("key"), F.lit(1).cast("long").alias("stitches")))


@query(sql("stash", """, e AS (SELECT id % 50 AS k, CASE WHEN id % 3 = 0 THEN 'anchor:' WHEN id % 3 = 1 THEN 'dmc:' ELSE '' END || (id % 50) AS key, id % 9 AS nr, CASE WHEN owned % 3 = 1 THEN 'owned' WHEN owned % 3 = 2 THEN 'tobuy' ELSE '' END AS v FROM stash), one AS (SELECT nr, k, key, max(v) AS v FROM e GROUP BY 1, 2, 3) SELECT 'proj_7' AS project_id, CAST(k AS VARCHAR) AS thread, arg_min(v, key) FILTER (v <> '') AS status FROM one WHERE nr = 7 GROUP BY k"""))
def store_project(spark, d):
    """One of nine projects, whose threads are those of the stock, under keys of several brands."""
    k = F.col("id") % 50
    key = F.concat(F.when(F.col("id") % 3 == 0, "anchor:").when(F.col("id") % 3 == 1, "dmc:").otherwise(""), k.cast("string"))
    each = stash(spark, d).select(F.concat(F.lit("proj_"), (F.col("id") % 9).cast("string")).alias("project_id"), key.alias("k"), F.when(F.col("owned") % 3 == 1, "owned").when(F.col("owned") % 3 == 2, "tobuy").otherwise("").alias("v"))
    one = each.groupBy("project_id", "k").agg(F.max("v").alias("v"))
    projects = one.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("owned"))
    return op.project(projects, "proj_7").select("project_id", F.explode("owned").alias("thread", "status"))


@query(sql("sessions targets", f", {KEYED} SELECT key, owner, total, updated_at, CAST(row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, key) AS INTEGER) AS position FROM metas WHERE starts_with(key, 'proj_')"))
def store_listed(spark, d):
    return op.listed(metas(spark, d))


@query(sql("sessions targets", f", {KEYED}, f AS (SELECT key, stitches FROM summaries WHERE stitches > 1) SELECT m.*, stitches FROM metas m LEFT JOIN f USING (key) WHERE starts_with(key, 'proj_')"))
def store_paired(spark, d):
    return op.paired(metas(spark, d), summaries(spark, d).where("stitches > 1"))


@query(sql("sessions targets", f", {KEYED} SELECT * FROM summaries WHERE starts_with(key, 'proj_') AND key IN (SELECT key FROM metas)"))
def store_live_summaries(spark, d):
    return op.live_summaries(summaries(spark, d), metas(spark, d))


@query(sql("sessions targets stash library", f", {KEYED}, h AS (SELECT unnest(range(0, 10)) AS backup_id), b AS (SELECT backup_id, CASE WHEN backup_id = 3 THEN 'format' WHEN backup_id = 4 THEN 'version' END AS error FROM h) SELECT backup_id, error, CASE WHEN error IS NULL THEN (SELECT count(*) FROM metas WHERE owner = backup_id AND starts_with(key, 'proj_')) END AS n_projects, CASE WHEN error IS NULL THEN (SELECT count(*) FROM stash WHERE id % 10 = backup_id AND owned > 0) END AS n_threads, CASE WHEN error IS NULL THEN (SELECT count(*) FROM library WHERE pattern_id % 10 = backup_id) END AS n_patterns FROM b"))
def store_backup_findings(spark, d):
    k = F.col("id")
    heads = spark.range(10).select(k.alias("backup_id"), F.when(k != 3, "backup").alias("format"), F.when(k == 4, 2).otherwise(1).alias("version"))
    own = lambda df, c: df.withColumn("backup_id", F.col(c) % 10)
    return op.backup_findings(heads, metas(spark, d).withColumn("backup_id", F.col("owner")), own(stash(spark, d), "id"), own(library(spark, d), "pattern_id"), "backup")


@query("WITH f AS (SELECT o_custkey AS file_id, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT *, CASE WHEN file_id % 5 = 1 THEN 'format' WHEN file_id % 7 = 2 THEN 'version' WHEN file_id % 11 = 3 THEN 'projects' END AS error FROM f) SELECT file_id, error, CAST(CASE WHEN error IS NULL THEN CASE WHEN file_id % 13 = 0 THEN 0 ELSE n END END AS INTEGER) AS n_projects FROM e")
def store_sync_findings(spark, d):
    """A file of each customer, with a project for each order; some of another format or version, some without a list."""
    k = F.col("o_custkey")
    files = table(spark, d, "orders").groupBy(k.alias("file_id")).agg(F.collect_list(F.concat(F.lit("proj_"), F.col("o_orderkey").cast("string"))).alias("projects"))
    k = F.col("file_id")
    made = files.select("file_id", F.when(k % 5 == 1, F.when(k % 2 == 0, "other")).otherwise("sync").alias("format"), F.when(k % 7 == 2, 2).otherwise(1).alias("version"), F.when(k % 11 != 3, F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("projects"))).alias("projects"))
    return op.sync_findings(made, "sync")


@query(sql("cells", ", f AS (SELECT project_id // 2 AS half, project_id, CASE WHEN project_id % 9 = 0 THEN 'empty' ELSE sha256(string_agg(thread_id, ',' ORDER BY idx)) END AS fp FROM cells GROUP BY 1, 2), g AS (SELECT project_id, fp FROM f UNION ALL SELECT project_id + 1000000, fp FROM f WHERE half % 2 = 0) SELECT fp AS fingerprint, count(*) AS n, min(project_id) AS canonical_id FROM g WHERE fp <> 'empty' GROUP BY 1"))
def store_fingerprint_index(spark, d):
    """Whole charts, some of them held twice."""
    f = sync_op.fingerprints(cells(spark, d)).withColumn("fingerprint", F.when(F.col("project_id") % 9 == 0, "empty").otherwise(F.col("fingerprint")))
    again = f.where(F.floor(F.col("project_id") / 2) % 2 == 0).withColumn("project_id", F.col("project_id") + 1_000_000)
    return op.fingerprint_index(f.unionByName(again))


SIDES = "l AS (SELECT project_id, done AS seconds, 'l' || project_id AS name, 'active' AS state, project_id % 7 AS u, CASE project_id % 5 WHEN 0 THEN 'keep-remote' WHEN 1 THEN 'keep-local' END AS choice FROM targets WHERE project_id % 6 <> 0), r AS (SELECT project_id, total AS seconds, 'r' || project_id AS name, CASE WHEN project_id % 4 <> 0 THEN 'paused' END AS state, project_id % 5 AS u FROM targets WHERE project_id % 8 <> 0)"


def sides(spark, d):
    k = F.col("project_id")
    t = targets(spark, d)
    one = lambda df, p, secs, state, u: df.select("project_id", F.col(secs).alias("seconds"), F.concat(F.lit(p), k.cast("string")).alias("name"), state.alias("state"), u.alias("updated_at"))
    local = one(t.where(k % 6 != 0), "l", "done", F.lit("active"), k % 7).withColumn("choice", F.when(k % 5 == 0, "keep-remote").when(k % 5 == 1, "keep-local"))
    return local, one(t.where(k % 8 != 0), "r", "total", F.when(k % 4 != 0, "paused"), k % 5)


@query(sql("sessions targets", f", {SIDES}, j AS (SELECT l.project_id, l.seconds + r.seconds AS seconds, l.name AS ln, r.name AS rn, l.state AS ls, r.state AS rs, choice IS NOT DISTINCT FROM 'keep-remote' OR choice IS NULL AND r.u > l.u AS theirs FROM l JOIN r ON l.project_id = r.project_id) SELECT project_id, seconds, CASE WHEN theirs THEN rn ELSE ln END AS name, CASE WHEN theirs AND rs IS NOT NULL THEN rs ELSE ls END AS state FROM j"))
def store_merged_tracking(spark, d):
    return op.merged_tracking(*sides(spark, d))


@query(sql("sessions targets cells", f", {SIDES}, b AS (SELECT l.project_id FROM l JOIN r ON l.project_id = r.project_id), lm AS (SELECT project_id, idx, 'l' AS side FROM cells WHERE idx % 5 = 0 AND project_id IN (SELECT project_id FROM b)), rm AS (SELECT project_id, idx, 'r' AS side FROM cells WHERE idx % 3 = 0 AND project_id IN (SELECT project_id FROM b)) SELECT * FROM lm UNION ALL SELECT * FROM rm WHERE NOT EXISTS (SELECT 1 FROM lm WHERE lm.project_id = rm.project_id AND lm.idx = rm.idx)"))
def store_filled_in(spark, d):
    local, remote = sides(spark, d)
    c = cells(spark, d)
    side = lambda n, name: c.where(F.col("idx") % n == 0).select("project_id", "idx", F.lit(name).alias("side"))
    return op.filled_in(side(5, "l"), side(3, "r"), ["project_id", "idx"], local.join(remote.select("project_id"), "project_id", "left_semi"))


LIB = "lib AS (SELECT 'p' || pattern_id AS pattern_id, title, pattern_id AS linked_id, pattern_id % 3 = 0 AS auto FROM library WHERE pattern_id % 4 <> 0), pro AS (SELECT pattern_id AS project_id, 'Name ' || pattern_id AS name FROM library WHERE pattern_id % 5 <> 0)"


@query(sql("library", f", {LIB} SELECT pattern_id, CASE WHEN auto AND name IS NOT NULL THEN name ELSE title END AS title, linked_id, CASE WHEN auto THEN 'auto-synced' ELSE '' END AS tags FROM lib LEFT JOIN pro ON project_id = linked_id UNION ALL SELECT 'auto_' || project_id, name, project_id, 'auto-synced' FROM pro WHERE project_id NOT IN (SELECT linked_id FROM lib)"))
def store_reconciled(spark, d):
    k = F.col("pattern_id")
    lib = library(spark, d)
    patterns = lib.where(k % 4 != 0).select(F.concat(F.lit("p"), k.cast("string")).alias("pattern_id"), "title", k.alias("linked_id"), F.when(k % 3 == 0, F.array(F.lit("auto-synced"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    found = op.reconciled(patterns, lib.where(k % 5 != 0).select(k.alias("project_id"), F.concat(F.lit("Name "), k.cast("string")).alias("name")))
    return found.withColumn("tags", F.array_join("tags", ","))


@query(sql("library", "SELECT pattern_id, CASE WHEN pattern_id % 3 = 0 THEN 'new' ELSE title END AS title FROM library WHERE pattern_id % 2 = 0 OR pattern_id % 3 = 0"))
def store_upserted(spark, d):
    lib = library(spark, d).select("pattern_id", "title")
    return op.upserted(lib.where("pattern_id % 2 = 0"), lib.where("pattern_id % 3 = 0").withColumn("title", F.lit("new")), "pattern_id")


@query(sql("sessions targets", "SELECT project_id, CASE WHEN project_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN project_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS synced_at, CAST(CASE WHEN project_id % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN project_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS version FROM targets"))
def store_marked_synced(spark, d):
    t = targets(spark, d)
    even = F.col("project_id") % 2 == 0
    p = t.select("project_id", F.when(even, F.lit("2024-01-01").cast("timestamp_ntz")).alias("synced_at"), F.when(even, 4).alias("version"))
    return op.marked_synced(p, t.where("project_id % 3 = 0"), "2024-02-01 00:00:00")


@query(sql("library stash", "SELECT 'project:' || pattern_id AS name, title || '|' || status || '|' || created_at AS value FROM library UNION ALL SELECT 'thread:' || id, CAST(owned AS VARCHAR) FROM stash"))
def store_snapshot(spark, d):
    p = library(spark, d).select(F.col("pattern_id").alias("project_id"), "title", F.col("status").alias("state"), F.col("created_at").alias("updated_at"))
    return op.snapshot(p, stash(spark, d))


SHELF = "shelf AS (SELECT id, owned, tobuy, CAST(CASE WHEN tobuy THEN 2 ELSE 0 END AS BIGINT) AS q, CASE WHEN tobuy THEN added_at END AS since FROM stash WHERE id % 6 <> 0), ch AS (SELECT id, id % 2 = 0 AS want, CASE WHEN id % 5 = 0 THEN CAST(7 AS BIGINT) END AS qty FROM stash WHERE id % 3 = 0)"


def shelf(spark, d):
    s = stash(spark, d).where("id % 6 <> 0")
    return s.select("id", "owned", "tobuy", F.when(F.col("tobuy"), 2).otherwise(0).cast("long").alias("tobuy_qty"), F.when(F.col("tobuy"), F.col("added_at")).alias("tobuy_at"))


@query(sql("stash", f", {SHELF} SELECT coalesce(s.id, c.id) AS id, coalesce(owned, 0) AS owned, CASE WHEN want IS NOT NULL THEN want ELSE tobuy END AS tobuy, CAST(CASE WHEN want IS NULL THEN q WHEN want THEN coalesce(qty, q, 0) ELSE 0 END AS BIGINT) AS tobuy_qty, CASE WHEN want IS NULL THEN since WHEN want THEN coalesce(since, DATE '2024-03-01') END AS tobuy_at FROM shelf s FULL JOIN ch c ON s.id = c.id"))
def store_to_buy(spark, d):
    k = F.col("id")
    changes = stash(spark, d).where(k % 3 == 0).select("id", (k % 2 == 0).alias("tobuy"), F.when(k % 5 == 0, 7).cast("long").alias("qty"))
    return op.to_buy(shelf(spark, d), changes, "2024-03-01")


@query(sql("stash", f", {SHELF} SELECT id, owned, FALSE AS tobuy, CAST(0 AS BIGINT) AS tobuy_qty, CAST(NULL AS DATE) AS tobuy_at FROM shelf"))
def store_cleared(spark, d):
    return op.cleared(shelf(spark, d))


STOCKED = [("t1", 3), ("t2", 1), ("t3", 0), ("t9", 2)]


@query(sql("cells", f", {PARTS}, u AS (SELECT thread, sum(share) / 1890 AS c FROM parts WHERE done = 1 GROUP BY 1), s AS (SELECT * FROM (VALUES {', '.join(map(str, STOCKED))}) v(id, owned)) SELECT id, CAST(owned AS INTEGER) AS owned, round(coalesce(c, 0), 6) AS consumed, round(greatest(0, owned - coalesce(c, 0)), 6) AS left FROM s LEFT JOIN u ON thread = id".replace(" AS left", ' AS "left"')))
def store_live_stock(spark, d):
    done = grid_op.parts(cells(spark, d)).where("done = 1").select("thread", F.col("share").alias("stitches"))
    return op.live_stock(spark.createDataFrame(STOCKED, "id string, owned int"), done).withColumns({c: F.round(c, 6) for c in ("consumed", "left")})


@query(sql("stash", """, b AS (SELECT id, owned, id % 4 / 2.0::DOUBLE AS c, CASE WHEN id % 5 <> 0 THEN owned END AS seen, CASE WHEN id % 3 = 0 THEN owned + id % 2 END AS edit FROM stash), r AS (SELECT id, c, CASE WHEN edit IS NOT NULL AND (seen IS NULL OR edit <> seen) THEN edit + c ELSE owned END AS base FROM b) SELECT id, CAST(base AS DOUBLE) AS base, greatest(0, base - c) AS "left" FROM r"""))
def store_rebased(spark, d):
    s, k = stash(spark, d), F.col("id")
    base = s.select("id", F.col("owned").cast("double").alias("base"), (k % 4 / 2.0).alias("consumed"))
    return op.rebased(base, s.where(k % 5 != 0).select("id", "owned"), s.where(k % 3 == 0).select("id", (F.col("owned") + k % 2).alias("owned")))


CATALOGUE = [("t1", 10, 20, 30), ("t2", 200, 1, 5), ("t3", 55, 66, 76), ("t4", 0, 0, 0)]
TINTED = f"""known AS (SELECT * FROM (VALUES {', '.join(map(str, CATALOGUE))}) v(id, r, g, b)), c AS (SELECT project_id, idx, thread_id, string_split(thread_id, '+') AS ids FROM cells), x AS (SELECT project_id, idx, thread_id, len(ids) AS n, CAST(CASE WHEN len(ids) = 1 THEN p.r ELSE floor((p.r + q.r) / 2.0 + 0.5) END AS INTEGER) AS e_r, CAST(CASE WHEN len(ids) = 1 THEN p.g ELSE floor((p.g + q.g) / 2.0 + 0.5) END AS INTEGER) AS e_g, CAST(CASE WHEN len(ids) = 1 THEN p.b ELSE floor((p.b + q.b) / 2.0 + 0.5) END AS INTEGER) AS e_b FROM c LEFT JOIN known p ON p.id = ids[1] LEFT JOIN known q ON q.id = ids[2]),
    tinted AS (SELECT *, CASE WHEN idx % 4 = 3 THEN NULL WHEN idx % 4 = 0 THEN 9 ELSE e_r END AS r, CASE WHEN idx % 4 = 3 THEN NULL ELSE e_g END AS g, CASE WHEN idx % 4 = 3 THEN NULL ELSE e_b END AS b FROM x), slim AS (SELECT *, thread_id IN ('__skip__', '__empty__') OR e_r IS NOT NULL AND r IS NOT DISTINCT FROM e_r AND g IS NOT DISTINCT FROM e_g AND b IS NOT DISTINCT FROM e_b AS gone FROM tinted)"""


def tinted(spark, d):
    """Cells with their catalogue's colour, with another one, and with none."""
    known = spark.createDataFrame(CATALOGUE, "id string, r int, g int, b int")
    x = op.with_expected(cells(spark, d).select("project_id", "idx", "thread_id"), known)
    k = F.col("idx") % 4
    return x.select("project_id", "idx", "thread_id", F.when(k != 3, F.when(k == 0, 9).otherwise(F.col("e_r"))).alias("r"), F.when(k != 3, F.col("e_g")).alias("g"), F.when(k != 3, F.col("e_b")).alias("b")), known


@query(sql("cells", f", {TINTED} SELECT project_id, idx, thread_id, CASE WHEN NOT gone THEN r END AS r, CASE WHEN NOT gone THEN g END AS g, CASE WHEN NOT gone THEN b END AS b FROM slim"))
def store_saved(spark, d):
    return op.saved(*tinted(spark, d))


@query(sql("cells", f", {TINTED} SELECT project_id, idx, thread_id, CASE WHEN thread_id = '__skip__' THEN 'skip' WHEN n = 2 AND e_r IS NOT NULL THEN 'blend' ELSE 'solid' END AS type, CAST(CASE WHEN thread_id = '__skip__' THEN 255 ELSE coalesce(e_r, CASE WHEN NOT gone THEN r END, 128) END AS INTEGER) AS r, CAST(CASE WHEN thread_id = '__skip__' THEN 255 ELSE coalesce(e_g, CASE WHEN NOT gone THEN g END, 128) END AS INTEGER) AS g, CAST(CASE WHEN thread_id = '__skip__' THEN 255 ELSE coalesce(e_b, CASE WHEN NOT gone THEN b END, 128) END AS INTEGER) AS b FROM slim"))
def store_restored(spark, d):
    cells_, known = tinted(spark, d)
    return op.restored(op.saved(cells_, known), known)
