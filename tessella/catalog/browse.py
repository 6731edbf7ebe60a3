"""Queries over lists: lookups, searches and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import AS_OF, library, sessions, sql, stash, table, targets, threads
from tessella.operators import browse as op
from tessella.registry import query

DAY = f"DATE '{AS_OF}'"


@query(sql("threads", ", k AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'dmc' ELSE 'anchor' END AS brand, CAST(l_partkey + l_linenumber % 2 * 1000000 AS VARCHAR) AS id FROM lineitem) SELECT k.brand, k.id, coalesce(name, k.id) AS name FROM k LEFT JOIN threads t ON t.brand = k.brand AND CAST(t.id AS VARCHAR) = lower(k.id)"))
def browse_lookup(spark, d):
    li = table(spark, d, "lineitem")
    keys = li.select(F.when(F.col("l_partkey") % 2 == 0, "dmc").otherwise("anchor").alias("brand"), (F.col("l_partkey") + F.col("l_linenumber") % 2 * 1_000_000).cast("string").alias("id")).distinct()
    return op.lookup(keys, threads(spark, d))


@query(sql("threads", ", k AS (SELECT CASE id % 3 WHEN 0 THEN 'anchor:' || id WHEN 1 THEN 'dmc:' || id ELSE CAST(id AS VARCHAR) END AS raw, id AS n FROM threads), s AS (SELECT n, CASE WHEN contains(raw, ':') THEN raw ELSE 'dmc:' || raw END AS key FROM k) SELECT key, string_split(key, ':')[1] AS brand, string_split(key, ':')[2] AS id FROM s"))
def browse_keys(spark, d):
    n = F.col("id").cast("string")
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("anchor:"), n)).when(F.col("id") % 3 == 1, F.concat(F.lit("dmc:"), n)).otherwise(n)
    keyed = threads(spark, d).select(op.key_of(F.lit(None).cast("string"), raw).alias("key"))
    return keyed.withColumn("s", op.split_key(F.col("key"))).select("key", "s.brand", "s.id")


@query(sql("threads", "SELECT * FROM threads WHERE (contains(CAST(id AS VARCHAR), '12') OR contains(lower(name), '12')) AND brand = 'dmc'"))
def browse_search_threads(spark, d):
    return op.search_threads(threads(spark, d), "12", "dmc")


@query(sql("threads", "SELECT * FROM threads WHERE contains(CAST(id AS VARCHAR), '1') OR contains(lower(name), '1') ORDER BY ord LIMIT 10"))
def browse_autocomplete(spark, d):
    return op.autocomplete(threads(spark, d), "1")


@query(sql("library", "SELECT * FROM library WHERE (contains(lower(title), '7') OR contains(lower(tag), '7')) AND status = 'wishlist'"))
def browse_search_patterns(spark, d):
    return op.search_patterns(library(spark, d), "7", "wishlist")


@query(sql("threads stash", ", j AS (SELECT t.brand, t.id, name, coalesce(owned, 0) AS owned FROM threads t LEFT JOIN stash s ON s.id = t.id) SELECT brand, id, CAST(row_number() OVER (PARTITION BY brand ORDER BY id) AS INTEGER) AS by_number, CAST(row_number() OVER (PARTITION BY brand ORDER BY name, id) AS INTEGER) AS by_name, CAST(row_number() OVER (PARTITION BY brand ORDER BY owned DESC, id) AS INTEGER) AS by_stock FROM j"))
def browse_thread_orders(spark, d):
    return op.thread_orders(threads(spark, d), stash(spark, d))


@query(sql("library", "SELECT pattern_id, CAST(row_number() OVER (PARTITION BY designer ORDER BY title, pattern_id) AS INTEGER) AS by_title, CAST(row_number() OVER (PARTITION BY designer ORDER BY CASE status WHEN 'inprogress' THEN 0 WHEN 'owned' THEN 1 WHEN 'wishlist' THEN 2 WHEN 'completed' THEN 3 ELSE 4 END, title, pattern_id) AS INTEGER) AS by_status FROM library"))
def browse_pattern_orders(spark, d):
    return op.pattern_orders(library(spark, d))


@query("WITH c AS (SELECT DISTINCT p_name AS label FROM part), s AS (SELECT label, CASE WHEN starts_with(lower(label), 'pa') THEN 100 WHEN contains(lower(label), ' pa') THEN 80 WHEN contains(lower(label), 'pa') THEN 60 WHEN regexp_matches(lower(label), '.*p.*a.*') THEN 50 ELSE 0 END AS score FROM c) SELECT label, CAST(score AS INTEGER) AS score FROM s WHERE score > 0")
def browse_fuzzy_commands(spark, d):
    return op.fuzzy_commands(table(spark, d, "part").select(F.col("p_name").alias("label")).distinct(), "pa")


@query("WITH i AS (SELECT p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN 'E' || p_partkey WHEN 1 THEN CAST(4000 + p_partkey % 1500 AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part) SELECT n, starts_with(upper(id), 'E') OR starts_with(upper(id), 'S') OR regexp_full_match(id, '4[0-9]{3}') AS special FROM i")
def browse_specialty(spark, d):
    k = F.col("p_partkey")
    i = F.when(k % 4 == 0, F.concat(F.lit("E"), k.cast("string"))).when(k % 4 == 1, (4000 + k % 1500).cast("string")).otherwise(k.cast("string"))
    return table(spark, d, "part").select(k.alias("n"), op.specialty(i).alias("special"))


def projects(spark, d):
    """Projects with what lists show of them."""
    last = sessions(spark, d).groupBy("project_id").agg(F.max("date").alias("last_touched"), F.min("date").alias("created_at"))
    t = targets(spark, d).join(last, "project_id")
    k = F.col("project_id")
    return t.withColumns({"done": F.when(k % 7 == 0, F.col("total")).when(k % 11 == 0, 0).otherwise(F.col("done")), "last_touched": F.when(k % 5 != 0, F.col("last_touched")), "override": F.when(k % 13 == 0, "paused"), "ready": k % 2 == 0, "source": F.when(k % 3 == 0, "creator").otherwise("import"), "n_sessions": F.when(k % 11 == 0, k % 2).otherwise(3)})


PROJECTS = "p AS (SELECT t.project_id, total, CASE WHEN t.project_id % 7 = 0 THEN total WHEN t.project_id % 11 = 0 THEN 0 ELSE done END AS done, CASE WHEN t.project_id % 5 <> 0 THEN max(date) END AS last_touched, min(date) AS created_at, CASE WHEN t.project_id % 13 = 0 THEN 'paused' END AS override, t.project_id % 2 = 0 AS ready, CASE WHEN t.project_id % 3 = 0 THEN 'creator' ELSE 'import' END AS source, CASE WHEN t.project_id % 11 = 0 THEN t.project_id % 2 ELSE 3 END AS n_sessions FROM targets t JOIN sessions s ON s.project_id = t.project_id GROUP BY t.project_id, total, done)"


@query(sql("sessions targets", f", {PROJECTS} SELECT project_id, coalesce(override, CASE WHEN total > 0 AND done >= total THEN 'complete' WHEN done > 0 THEN 'active' WHEN source = 'creator' AND n_sessions = 0 THEN 'design' ELSE 'queued' END) AS state FROM p"))
def browse_project_states(spark, d):
    return op.project_states(projects(spark, d))


@query(sql("sessions targets", f", {PROJECTS} SELECT project_id, coalesce(last_touched, created_at) AS since FROM p WHERE done < total ORDER BY 2, 1 LIMIT 3"))
def browse_oldest_open(spark, d):
    return op.oldest_open(projects(spark, d))


@query(sql("sessions targets", f", {PROJECTS} SELECT project_id, CAST(CASE WHEN last_touched IS NULL THEN 0 ELSE least(30, 3 * ({DAY} - last_touched)) END + CASE WHEN done / greatest(total, 1)::DOUBLE >= 0.8 THEN 20 WHEN done / greatest(total, 1)::DOUBLE >= 0.5 THEN 5 ELSE 0 END + CASE WHEN ready THEN 10 ELSE 0 END AS BIGINT) AS score FROM p WHERE done < total ORDER BY 2 DESC NULLS LAST, 1 LIMIT 1"))
def browse_next_project(spark, d):
    return op.next_project(projects(spark, d), AS_OF)
