"""Queries over two devices' snapshots, which are cut from the domain tables by rules on the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, library, sessions, sql, stash, table, threads
from tessella.operators import sync as op
from tessella.registry import query


def shelves(spark, d):
    """The library on this device, on the other, and at the last exchange."""
    lib = library(spark, d).withColumn("updated_at", F.col("created_at"))
    k = F.col("pattern_id")
    local = lib.where(k % 10 != 3).withColumn("title", F.when(k % 5 == 0, F.concat("title", F.lit(" (mine)"))).otherwise(F.col("title")))
    remote = lib.where(k % 10 != 7).withColumns({"title": F.when(k % 7 == 0, F.concat("title", F.lit(" (theirs)"))).otherwise(F.col("title")), "updated_at": F.date_add("updated_at", (k % 3 - 1).cast("int"))})
    return local, remote, lib.where(k % 11 != 0)


SHELVES = """lib AS (SELECT *, created_at AS updated_at FROM library), local AS (SELECT * REPLACE (CASE WHEN pattern_id % 5 = 0 THEN title || ' (mine)' ELSE title END AS title) FROM lib WHERE pattern_id % 10 <> 3),
    remote AS (SELECT * REPLACE (CASE WHEN pattern_id % 7 = 0 THEN title || ' (theirs)' ELSE title END AS title, CAST(updated_at + CAST(pattern_id % 3 - 1 AS INTEGER) AS DATE) AS updated_at) FROM lib WHERE pattern_id % 10 <> 7), base AS (SELECT * FROM lib WHERE pattern_id % 11 <> 0)"""


@query(sql("cells", "SELECT project_id, idx, CASE WHEN idx % 5 = 0 THEN greatest(done, 1) ELSE done END AS done FROM cells"))
def sync_merge_done(spark, d):
    c = cells(spark, d)
    return op.merge_done(c, c.where("idx % 5 = 0").withColumn("done", F.lit(1)))


@query(sql("sessions", ", b AS (SELECT *, 0 AS side FROM sessions WHERE ord % 3 <> 0 UNION ALL SELECT *, 1 AS side FROM sessions WHERE ord % 4 <> 0) SELECT project_id, session_id, date, net_stitches, duration_seconds FROM b QUALIFY row_number() OVER (PARTITION BY project_id, date, duration_seconds, net_stitches ORDER BY side, ord) = 1"))
def sync_merge_sessions(spark, d):
    s = sessions(spark, d)
    return op.merge_sessions(s.where("ord % 3 <> 0"), s.where("ord % 4 <> 0")).select("project_id", "session_id", "date", "net_stitches", "duration_seconds")


@query(sql("stash", ", l AS (SELECT * FROM stash WHERE id % 9 <> 0), r AS (SELECT * REPLACE (CAST(owned + id % 3 - 1 AS BIGINT) AS owned, id % 5 = 0 AS tobuy, CAST(min_stock + 1 AS BIGINT) AS min_stock) FROM stash WHERE id % 8 <> 0) SELECT id, greatest(l.owned, r.owned) AS owned, coalesce(l.tobuy, FALSE) OR coalesce(r.tobuy, FALSE) AS tobuy, greatest(l.min_stock, r.min_stock) AS min_stock, coalesce(l.added_at, r.added_at) AS added_at FROM l FULL JOIN r USING (id)"))
def sync_merge_stash(spark, d):
    s = stash(spark, d)
    remote = s.where("id % 8 <> 0").withColumns({"owned": F.col("owned") + F.col("id") % 3 - 1, "tobuy": F.col("id") % 5 == 0, "min_stock": F.col("min_stock") + 1})
    return op.merge_stash(s.where("id % 9 <> 0"), remote)


@query(sql("library", f", {SHELVES}, b AS (SELECT *, 1 AS rank FROM local UNION ALL SELECT *, 0 AS rank FROM remote) SELECT * EXCLUDE (rank) FROM b QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC, rank DESC) = 1"))
def sync_upsert_library(spark, d):
    local, remote, _ = shelves(spark, d)
    return op.upsert(local, remote)


@query(sql("library", f""", {SHELVES}, j AS (SELECT coalesce(l.pattern_id, r.pattern_id, s.pattern_id) AS pattern_id, l.title AS l, r.title AS r, s.title AS s FROM local l FULL JOIN remote r ON l.pattern_id = r.pattern_id FULL JOIN base s ON s.pattern_id = coalesce(l.pattern_id, r.pattern_id))
    SELECT pattern_id, CASE WHEN l IS NOT DISTINCT FROM r THEN 'same' WHEN s IS NULL AND l IS NULL THEN 'added' WHEN s IS NULL AND r IS NULL THEN 'keep' WHEN s IS NULL THEN 'conflict' WHEN l IS NOT DISTINCT FROM s AND r IS NULL THEN 'removed' WHEN l IS NOT DISTINCT FROM s THEN 'apply' WHEN r IS NOT DISTINCT FROM s THEN 'keep' ELSE 'conflict' END AS kind FROM j"""))
def sync_three_way(spark, d):
    return op.three_way(*shelves(spark, d), "pattern_id", "title")


@query(sql("cells", "SELECT project_id, sha256(string_agg(thread_id, ',' ORDER BY idx)) AS fingerprint, count(*) AS n FROM cells GROUP BY 1"))
def sync_fingerprints(spark, d):
    return op.fingerprints(cells(spark, d))


def devices(spark, d):
    """Customers as projects whose chart is one of 40; ids differ between the devices for every third."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 40).cast("string").alias("fingerprint"), F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 6).alias("updated_at"))
    local = c.where("ord % 4 <> 0")
    remote = c.where("ord % 5 <> 0").withColumns({"project_id": F.when(F.col("ord") % 3 == 0, F.col("ord") + 1_000_000_000).otherwise(F.col("ord")), "updated_at": F.col("ord") % 4})
    return remote, local


DEVICES = """c AS (SELECT c_custkey AS project_id, CAST(c_custkey % 40 AS VARCHAR) AS fingerprint, c_custkey AS ord, c_custkey % 6 AS updated_at FROM customer), local AS (SELECT * FROM c WHERE ord % 4 <> 0), remote AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN ord + 1000000000 ELSE ord END AS project_id, ord % 4 AS updated_at) FROM c WHERE ord % 5 <> 0),
    ids AS (SELECT r.project_id, l.project_id AS local_id FROM remote r JOIN local l ON r.project_id = l.project_id), rr AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS k FROM remote WHERE project_id NOT IN (SELECT project_id FROM ids)), ll AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS k FROM local WHERE project_id NOT IN (SELECT project_id FROM ids)),
    matches AS (SELECT project_id, local_id, 'id' AS how FROM ids UNION ALL SELECT rr.project_id, ll.project_id, CASE WHEN ll.project_id IS NULL THEN 'new' ELSE 'fingerprint' END FROM rr LEFT JOIN ll ON rr.fingerprint = ll.fingerprint AND rr.k = ll.k)"""


@query(f"WITH {DEVICES} SELECT project_id, local_id, how, least(project_id, coalesce(local_id, project_id)) AS canonical_id FROM matches")
def sync_match(spark, d):
    return op.match(*devices(spark, d))


@query(f"WITH {DEVICES} SELECT m.project_id, CASE WHEN l.fingerprint IS NULL THEN 'new' WHEN r.fingerprint <> l.fingerprint THEN 'conflict' WHEN r.updated_at = l.updated_at THEN 'identical' ELSE 'merge' END AS kind FROM matches m JOIN remote r ON r.project_id = m.project_id LEFT JOIN local l ON l.project_id = m.local_id UNION ALL SELECT project_id, 'local-only' FROM local WHERE project_id NOT IN (SELECT local_id FROM matches WHERE local_id IS NOT NULL)")
def sync_import_plan(spark, d):
    remote, local = devices(spark, d)
    return op.import_plan(op.match(remote, local), remote, local)


@query(sql("cells", "SELECT project_id, count(*) FILTER (done = 1 AND idx % 2 = 1) AS new, CAST(sum(done) - sum(CASE WHEN idx % 2 = 0 THEN done ELSE 0 END) AS BIGINT) AS delta FROM cells GROUP BY 1"))
def sync_newly_done(spark, d):
    c = cells(spark, d)
    return op.newly_done(c.withColumn("done", F.when(F.col("idx") % 2 == 0, F.col("done")).otherwise(0)), c)


@query("WITH s AS (SELECT user_id AS project_id, event_id AS snapshot_id, ts, CASE WHEN event_id % 9 = 0 THEN event_type END AS label FROM events) SELECT * FROM s QUALIFY label IS NOT NULL OR row_number() OVER (PARTITION BY project_id, label IS NULL ORDER BY ts DESC, snapshot_id DESC) <= 20")
def sync_kept_snapshots(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("snapshot_id"), "ts", F.when(F.col("event_id") % 9 == 0, F.col("event_type")).alias("label"))
    return op.kept_snapshots(e, 20)


@query(sql("threads", ", i AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM threads) SELECT id, CASE k WHEN 1 THEN name WHEN 2 THEN name || ' (copy)' ELSE name || ' (copy ' || (k - 1) || ')' END AS title FROM i"))
def sync_copy_titles(spark, d):
    return op.copy_titles(threads(spark, d).select("id", F.col("name").alias("title")))
