"""Queries that carry out an import between two devices, whose projects are customers and whose rows are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import table
from tessella.operators import exchange as op
from tessella.operators import sync as sync_op
from tessella.registry import query

SHIFT, COPY = 1_000_000_000, 2_000_000_000


def devices(spark, d):
    """Remote and local projects: every third id differs between the devices, every seventh chart, and names, states and times by rules on the id."""
    k = F.col("c_custkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (k % n).cast("int"))
    c = table(spark, d, "customer").select(k.alias("project_id"), k.alias("ord"), (k % 40).cast("string").alias("fingerprint"), F.col("c_name").alias("name"), F.lit("active").alias("state"), (k % 1000).alias("seconds"), day(20).alias("created_at"), day(6).alias("updated_at"))
    k = F.col("ord")
    remote = c.where("ord % 5 <> 0").withColumns({"project_id": F.when(k % 3 == 0, k + SHIFT).otherwise(k), "fingerprint": F.when(k % 7 == 0, "other").otherwise(F.col("fingerprint")), "name": F.when(k % 11 != 0, F.concat("name", F.lit(" *"))), "state": F.when(k % 2 == 0, "paused").otherwise(F.col("state")), "updated_at": F.date_add(F.lit("2024-01-01").cast("date"), (k % 4).cast("int"))})
    return remote, c.where("ord % 4 <> 0")


def choices(remote):
    k = F.col("ord") % 3
    return remote.select("project_id", F.when(k == 1, "keep-remote").when(k == 2, "keep-both").alias("choice"))


def planned(spark, d):
    remote, local = devices(spark, d)
    matches = sync_op.match(remote, local)
    plan = sync_op.import_plan(matches, remote, local)
    return remote, local, plan, op.new_ids(matches, plan, local, choices(remote), lambda i: i + COPY)


IDS = f"""c AS (SELECT c_custkey AS project_id, c_custkey AS ord, CAST(c_custkey % 40 AS VARCHAR) AS fingerprint, c_name AS name, 'active' AS state, c_custkey % 1000 AS seconds, CAST(DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS DATE) AS created_at, CAST(DATE '2024-01-01' + CAST(c_custkey % 6 AS INTEGER) AS DATE) AS updated_at FROM customer),
    local AS (SELECT * FROM c WHERE ord % 4 <> 0), remote AS (SELECT CASE WHEN ord % 3 = 0 THEN ord + {SHIFT} ELSE ord END AS project_id, ord, CASE WHEN ord % 7 = 0 THEN 'other' ELSE fingerprint END AS fingerprint, CASE WHEN ord % 11 <> 0 THEN name || ' *' END AS name, CASE WHEN ord % 2 = 0 THEN 'paused' ELSE state END AS state, seconds, created_at, CAST(DATE '2024-01-01' + CAST(ord % 4 AS INTEGER) AS DATE) AS updated_at FROM c WHERE ord % 5 <> 0),
    same AS (SELECT r.project_id FROM remote r JOIN local l ON r.project_id = l.project_id),
    rr AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS k FROM remote WHERE project_id NOT IN (SELECT project_id FROM same)), ll AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS k FROM local WHERE project_id NOT IN (SELECT project_id FROM same)),
    matches AS (SELECT project_id, project_id AS local_id FROM same UNION ALL SELECT rr.project_id, ll.project_id FROM rr LEFT JOIN ll ON rr.fingerprint = ll.fingerprint AND rr.k = ll.k),
    fate AS (SELECT m.project_id, m.local_id, CASE WHEN l.project_id IS NULL THEN 'new' WHEN r.fingerprint <> l.fingerprint THEN 'conflict' WHEN r.updated_at = l.updated_at THEN 'identical' ELSE 'merge' END AS kind, CASE r.ord % 3 WHEN 1 THEN 'keep-remote' WHEN 2 THEN 'keep-both' ELSE 'keep-local' END AS choice FROM matches m JOIN remote r USING (project_id) LEFT JOIN local l ON l.project_id = m.local_id),
    ids AS (SELECT 'remote' AS side, project_id, CASE WHEN kind = 'merge' THEN least(project_id, local_id) WHEN kind = 'conflict' AND choice = 'keep-both' THEN project_id + {COPY} ELSE project_id END AS new_id, CASE WHEN kind = 'new' THEN 'take' WHEN kind = 'merge' THEN 'merge' WHEN kind = 'conflict' AND choice = 'keep-remote' THEN 'take' WHEN kind = 'conflict' AND choice = 'keep-both' THEN 'copy' ELSE 'drop' END AS role FROM fate
        UNION ALL SELECT 'local', l.project_id, CASE WHEN kind = 'merge' THEN least(f.project_id, l.project_id) ELSE l.project_id END, CASE WHEN kind = 'merge' THEN 'merge' WHEN kind = 'conflict' AND choice = 'keep-remote' THEN 'drop' ELSE 'keep' END FROM local l LEFT JOIN fate f ON f.local_id = l.project_id)"""


@query(f"WITH {IDS} SELECT * FROM ids")
def exchange_ids(spark, d):
    return planned(spark, d)[3]


@query(f"""WITH {IDS}, ch AS (SELECT project_id, CASE WHEN ord % 4 = 1 THEN 'keep-remote' WHEN ord % 4 = 2 THEN 'keep-local' END AS nc, CASE WHEN ord % 5 = 1 THEN 'keep-remote' WHEN ord % 5 = 2 THEN 'keep-local' END AS sc FROM local),
    m AS (SELECT i.new_id AS project_id, l.name AS ln, r.name AS rn, l.state AS ls, r.state AS rs, l.seconds + r.seconds AS seconds, l.created_at, greatest(l.updated_at, r.updated_at) AS updated_at, CASE WHEN nc IS NULL THEN r.updated_at > l.updated_at ELSE nc = 'keep-remote' END AS nt, CASE WHEN sc IS NULL THEN r.updated_at > l.updated_at ELSE sc = 'keep-remote' END AS st
        FROM ids i JOIN local l ON i.side = 'local' AND i.role = 'merge' AND i.project_id = l.project_id JOIN ch ON ch.project_id = l.project_id JOIN ids j ON j.side = 'remote' AND j.role = 'merge' AND j.new_id = i.new_id JOIN remote r ON r.project_id = j.project_id)
    SELECT project_id, CASE WHEN nt AND rn IS NOT NULL THEN rn ELSE ln END AS name, CASE WHEN st AND rs IS NOT NULL THEN rs ELSE ls END AS state, seconds, created_at, updated_at FROM m
    UNION ALL SELECT new_id, name, state, seconds, created_at, updated_at FROM ids JOIN local USING (project_id) WHERE side = 'local' AND role = 'keep'
    UNION ALL SELECT new_id, CASE WHEN role = 'copy' THEN coalesce(name, 'Untitled') || ' (synced)' ELSE name END, state, seconds, CASE WHEN role <> 'copy' THEN created_at END, updated_at FROM ids JOIN remote USING (project_id) WHERE side = 'remote' AND role IN ('take', 'copy')""")
def exchange_projects(spark, d):
    remote, local, _, ids = planned(spark, d)
    k = F.col("ord")
    asked = F.array(F.struct(F.lit("name").alias("field"), F.when(k % 4 == 1, "keep-remote").when(k % 4 == 2, "keep-local").alias("choice")), F.struct(F.lit("state").alias("field"), F.when(k % 5 == 1, "keep-remote").when(k % 5 == 2, "keep-local").alias("choice")))
    fields = local.select("project_id", F.explode(asked).alias("a")).select("project_id", "a.*").where("choice is not null")
    return op.merged_projects(local, remote, ids, fields)


#: Rows of the projects on either side, by the customer's number.
HELD = f"held AS (SELECT o_custkey AS ord, o_orderkey AS k, o_orderdate AS day, CAST(floor(o_totalprice) AS BIGINT) AS net FROM orders), lid AS (SELECT project_id, ord FROM local), rid AS (SELECT project_id, ord FROM remote)"


def held(spark, d, side):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ord"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), F.floor("o_totalprice").cast("long").alias("net"))
    return o.join(side.select("project_id", "ord"), "ord").drop("ord")


@query(f"""WITH {IDS}, {HELD}, rows AS (SELECT 'local' AS side, project_id, k % 50 AS idx, CAST(k % 2 AS INTEGER) AS done FROM held JOIN lid USING (ord) UNION ALL SELECT 'remote', project_id, k % 60, CAST(k % 3 = 0 AS INTEGER) FROM held JOIN rid USING (ord)),
    moved AS (SELECT side, new_id AS project_id, idx, done, role FROM rows JOIN ids USING (side, project_id) WHERE role <> 'drop')
    SELECT project_id, idx, max(done) AS done FROM moved WHERE role = 'merge' GROUP BY 1, 2 UNION ALL SELECT project_id, idx, done FROM moved WHERE role <> 'merge'""")
def exchange_done(spark, d):
    remote, local, _, ids = planned(spark, d)
    cells = lambda side, n, done: held(spark, d, side).select("project_id", (F.col("k") % n).alias("idx"), done.cast("int").alias("done"))
    return op.merged_rows(cells(local, 50, F.col("k") % 2), cells(remote, 60, F.col("k") % 3 == 0), ids, ["idx"], greatest=("done",))


@query(f"""WITH {IDS}, {HELD}, rows AS (SELECT 'local' AS side, project_id, CASE WHEN k % 4 <> 0 THEN 's' || k % 9 END AS start, CAST(day AS DATE) AS date, k % 5 AS duration, net FROM held JOIN lid USING (ord) UNION ALL SELECT 'remote', project_id, CASE WHEN k % 4 <> 0 THEN 's' || k % 9 END, CAST(day AS DATE), k % 5, net + k % 2 FROM held JOIN rid USING (ord)),
    moved AS (SELECT *, coalesce('s:' || start, 'd:' || date || ':' || duration || ':' || net) AS key FROM rows JOIN ids USING (side, project_id) WHERE role <> 'drop'),
    merged AS (SELECT * FROM moved WHERE role = 'merge' QUALIFY row_number() OVER (PARTITION BY new_id, key ORDER BY side, start, date, duration, net) = 1)
    SELECT new_id AS project_id, start, date, duration, net FROM merged UNION ALL SELECT new_id, start, date, duration, net FROM moved WHERE role <> 'merge'""")
def exchange_sessions(spark, d):
    remote, local, _, ids = planned(spark, d)
    k = F.col("k")
    worked = lambda side, more: held(spark, d, side).select("project_id", F.when(k % 4 != 0, F.concat(F.lit("s"), (k % 9).cast("string"))).alias("start"), F.col("day").alias("date"), (k % 5).alias("duration"), (F.col("net") + more).alias("net"))
    return op.merged_sessions(worked(local, F.lit(0)), worked(remote, k % 2), ids)


CORNERS = ", ".join(f"CASE WHEN k % {n} = 0 THEN 't' || (k + side_no) % 5 END AS \"{c}\"" for n, c in zip((2, 3, 4, 5), op.CORNERS, strict=True))
FILLED = ", ".join(f"coalesce(min(\"{c}\") FILTER (side = 'local'), min(\"{c}\")) AS \"{c}\"" for c in op.CORNERS)
LISTED = ", ".join(f'"{c}"' for c in op.CORNERS)


@query(f"""WITH {IDS}, {HELD}, both_sides AS (SELECT 'local' AS side, 0 AS side_no, project_id, k FROM held JOIN lid USING (ord) UNION ALL SELECT 'remote', 1, project_id, k FROM held JOIN rid USING (ord)), rows AS (SELECT side, project_id, k % 7 AS idx, {CORNERS} FROM both_sides),
    moved AS (SELECT side, new_id AS project_id, role, idx, {LISTED} FROM rows JOIN ids USING (side, project_id) WHERE role <> 'drop')
    SELECT project_id, idx, {FILLED} FROM moved WHERE role = 'merge' GROUP BY 1, 2 UNION ALL SELECT project_id, idx, {LISTED} FROM moved WHERE role <> 'merge'""")
def exchange_half_stitches(spark, d):
    remote, local, _, ids = planned(spark, d)
    k = F.col("k")
    cells = lambda side, n: held(spark, d, side).select("project_id", (k % 7).alias("idx"), *(F.when(k % m == 0, F.concat(F.lit("t"), ((k + n) % 5).cast("string"))).alias(c) for m, c in zip((2, 3, 4, 5), op.CORNERS, strict=True)))
    return op.merged_half_stitches(cells(local, 0), cells(remote, 1), ids)


@query(f"""WITH {IDS}, logs AS (SELECT c_custkey + 5000000000 AS project_id, 0 AS stage, c_custkey AS pos FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT project_id, 1, 0 FROM ids WHERE side = 'local' AND project_id <> new_id UNION ALL SELECT c_custkey + 5000000000, 2, c_custkey FROM customer WHERE c_custkey % 6 = 0),
    first AS (SELECT project_id, min({{'stage': stage, 'pos': pos}}) AS a FROM logs GROUP BY 1), last AS (SELECT * FROM first ORDER BY a.stage DESC, a.pos DESC, project_id DESC LIMIT 200) SELECT project_id, CAST(row_number() OVER (ORDER BY a.stage, a.pos, project_id) - 1 AS INTEGER) AS pos FROM last""")
def exchange_deletions(spark, d):
    ids = planned(spark, d)[3]
    k = F.col("c_custkey")
    log = lambda n: table(spark, d, "customer").where(k % n == 0).select((k + 5_000_000_000).alias("project_id"), k.alias("pos"))
    return op.deletion_log(log(9), log(6), ids)


@query(f"WITH {IDS} SELECT DISTINCT CASE WHEN kind = 'merge' THEN least(project_id, local_id) ELSE project_id END AS project_id FROM fate WHERE kind <> 'identical'")
def exchange_synced(spark, d):
    _, _, plan, ids = planned(spark, d)
    return op.synced(ids, plan)


@query(f"WITH {IDS} SELECT count(*) FILTER (kind = 'new') AS imported, count(*) FILTER (kind = 'merge') AS merged, count(*) FILTER (kind = 'conflict') AS conflicts_resolved FROM fate")
def exchange_counts(spark, d):
    return op.counts(planned(spark, d)[2])
