"""Queries over stock and library."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import AS_OF, library, library_threads, sessions, sql, stash, stash_history, table
from tessella.functions import skeins as sk
from tessella.operators import stash as op
from tessella.registry import query

#: Stock is asked about on the last day of the tables' order dates.
STOCK_DAY = "2001-08-01"
DAY = f"DATE '{STOCK_DAY}'"


def skeins_sql(x: str) -> str:
    e = f"({x} * 2.54::DOUBLE / 14 * 4.8::DOUBLE * 2 / (8.0::DOUBLE * 100 * 6 * (1 - 0.2::DOUBLE)))"
    return f"CAST(ceil(CASE WHEN {e} < 0.01 THEN 0 ELSE {e} END) AS BIGINT)"


OPEN = "open AS (SELECT pattern_id FROM library WHERE status <> 'completed')"
PER = "per AS (SELECT pattern_id, id, sum(stitches) AS stitches FROM library_threads WHERE pattern_id IN (SELECT pattern_id FROM {}) GROUP BY 1, 2)"
ALL = "library library_threads stash"
START = f"""waiting AS (SELECT pattern_id, status FROM library WHERE status NOT IN ('completed', 'inprogress')), {PER.format('waiting')}, ok AS (SELECT p.*, coalesce(owned >= {skeins_sql('stitches')}, FALSE) AS ok FROM per p LEFT JOIN stash USING (id)),
    startable AS (SELECT pattern_id, count(*) AS n_threads, count(*) FILTER (ok) AS covered, list(id ORDER BY id) FILTER (NOT ok) AS missing, CAST(floor(count(*) FILTER (ok) / count(*)::DOUBLE * 100 + 0.5) AS BIGINT) AS percent FROM ok GROUP BY 1)"""


def everything(spark, d):
    return library(spark, d), library_threads(spark, d), stash(spark, d)


def joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


@query(sql("stash", ", l AS (SELECT id, brand, owned, CAST(CASE WHEN min_stock > 0 THEN min_stock ELSE 2 END AS BIGINT) AS least FROM stash) SELECT id, brand, owned, least, least - owned AS short, CAST(row_number() OVER (PARTITION BY brand ORDER BY least - owned DESC, id) AS INTEGER) AS position FROM l WHERE owned < least"))
def stash_low_stock(spark, d):
    return op.low_stock(stash(spark, d))


@query(sql("stash", "SELECT CASE WHEN owned <= 0 THEN 'usedup' WHEN owned < 2 THEN 'lowstock' ELSE 'owned' END AS state, tobuy, count(*) AS n, CAST(sum(owned) AS BIGINT) AS owned FROM stash GROUP BY 1, 2"))
def stash_thread_states(spark, d):
    return op.thread_states(stash(spark, d))


@query(sql("stash", "SELECT brand, id, added_at, CAST(row_number() OVER (PARTITION BY brand ORDER BY added_at DESC, id) AS INTEGER) AS position FROM stash WHERE tobuy"))
def stash_shopping_order(spark, d):
    return op.shopping_order(stash(spark, d))


@query(sql("stash", f"SELECT CASE WHEN {DAY} - added_at < 365 THEN 'under 1 year' WHEN {DAY} - added_at < 1095 THEN '1 to 3 years' WHEN {DAY} - added_at < 1825 THEN '3 to 5 years' ELSE 'older' END AS bucket, count(*) AS n, min(added_at) AS oldest FROM stash WHERE owned > 0 GROUP BY 1"))
def stash_age_buckets(spark, d):
    return op.age_buckets(stash(spark, d), STOCK_DAY)


@query(sql("stash_history sessions", f""", spine AS (SELECT CAST(unnest(generate_series(DATE '2023-02-01', DATE '2024-01-01', INTERVAL 1 MONTH)) AS DATE) AS month), came AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(delta) AS BIGINT) AS added FROM stash_history WHERE delta > 0 GROUP BY 1), used AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, floor(sum(net_stitches) / 1800.0::DOUBLE * 10 + 0.5) / 10 AS used FROM sessions GROUP BY 1)
    SELECT s.month, coalesce(added, 0) AS added, coalesce(used, 0.0::DOUBLE) AS used FROM spine s LEFT JOIN came c ON c.month = s.month LEFT JOIN used u ON u.month = s.month"""))
def stash_monthly_flow(spark, d):
    return op.monthly_flow(stash_history(spark, d), sessions(spark, d), AS_OF)


@query(sql("stash_history", "SELECT id, count(*) AS n, min(date) AS first, max(date) AS last FROM stash_history WHERE delta > 0 GROUP BY 1 HAVING count(*) >= 2 AND max(date) - min(date) > 30"))
def stash_repeat_purchases(spark, d):
    return op.repeat_purchases(stash_history(spark, d))


@query(sql(ALL, f", {OPEN}, {PER.format('open')}, demand AS (SELECT id, CAST(sum({skeins_sql('stitches')}) AS BIGINT) AS needed FROM per GROUP BY 1) SELECT id, needed, coalesce(owned, 0) AS owned, needed - coalesce(owned, 0) AS deficit FROM demand LEFT JOIN stash USING (id) WHERE needed > coalesce(owned, 0)"))
def stash_shortfalls(spark, d):
    return op.shortfalls(*everything(spark, d))


@query(sql(ALL, f", {START} SELECT pattern_id, n_threads, covered, coalesce(array_to_string(missing, ','), '') AS missing, percent FROM startable"))
def stash_startable(spark, d):
    return op.startable(*everything(spark, d)).withColumn("missing", joined("missing"))


@query(sql("library library_threads", "SELECT pattern_id, title, status FROM library WHERE pattern_id IN (SELECT pattern_id FROM library_threads WHERE id = 17)"))
def stash_patterns_using(spark, d):
    return op.patterns_using(library(spark, d), library_threads(spark, d), 17)


@query(sql(ALL, "SELECT id, brand, owned FROM stash WHERE owned > 0 AND id NOT IN (SELECT t.id FROM library_threads t JOIN library USING (pattern_id) WHERE status = 'completed' OR status = 'inprogress')"))
def stash_never_used(spark, d):
    lib, needs, st = everything(spark, d)
    return op.never_used(st, lib, needs)


DORMANT = f"dormant AS (SELECT id, owned, max(date) AS last_change FROM stash JOIN stash_history USING (id) WHERE owned > 0 GROUP BY 1, 2 HAVING {DAY} - max(date) > 900)"


@query(sql("stash stash_history", f", {DORMANT} SELECT * FROM dormant"))
def stash_dormant(spark, d):
    return op.dormant(stash(spark, d), stash_history(spark, d), STOCK_DAY, 900)


@query(sql(ALL, ", used AS (SELECT t.id FROM library_threads t JOIN library USING (pattern_id) WHERE status IN ('completed', 'inprogress')), unused AS (SELECT id FROM stash WHERE owned > 0 AND id NOT IN (SELECT id FROM used)) SELECT pattern_id, count(DISTINCT t.id) AS n_threads FROM library_threads t JOIN library USING (pattern_id) WHERE status NOT IN ('completed', 'inprogress') AND t.id IN (SELECT id FROM unused) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def stash_use_what_you_have(spark, d):
    lib, needs, st = everything(spark, d)
    return op.use_what_you_have(op.never_used(st, lib, needs), lib, needs)


@query(sql(ALL, f", {OPEN}, w AS (SELECT DISTINCT pattern_id, id FROM library_threads WHERE pattern_id IN (SELECT pattern_id FROM open) AND id NOT IN (SELECT id FROM stash WHERE owned > 0)) SELECT id, count(*) AS n_patterns, array_to_string(list(pattern_id ORDER BY pattern_id)[1:3], ',') AS samples FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def stash_buying_impact(spark, d):
    return op.buying_impact(*everything(spark, d)).withColumn("samples", joined("samples"))


@query(sql(ALL, ", m AS (SELECT brand AS modal FROM stash WHERE owned > 0 GROUP BY 1 ORDER BY count(*) DESC, brand DESC LIMIT 1), b AS (SELECT DISTINCT t.pattern_id, t.id, brand FROM library_threads t JOIN stash USING (id)), p AS (SELECT pattern_id, modal, CAST(floor(count(*) FILTER (brand = modal) / count(*)::DOUBLE * 100 + 0.5) AS BIGINT) AS percent FROM b, m GROUP BY 1, 2) SELECT *, percent < 80 AS conflict FROM p"))
def stash_brand_alignment(spark, d):
    return op.brand_alignment(*everything(spark, d))


@query(sql(ALL, ", a AS (SELECT id FROM library_threads GROUP BY 1 ORDER BY sum(stitches) DESC, id LIMIT 20), b AS (SELECT id FROM stash ORDER BY owned DESC, id LIMIT 20), c AS (SELECT a.id AS a, b.id AS b FROM a FULL JOIN b ON a.id = b.id) SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) AS total, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*)::DOUBLE, 6) AS jaccard FROM c"))
def stash_fingerprint(spark, d):
    return op.jaccard_of_top(library_threads(spark, d), stash(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@query(sql("library", ", q AS (SELECT CAST(date_trunc('quarter', created_at) AS DATE) AS quarter, 1 AS s, 0 AS f FROM library UNION ALL SELECT CAST(date_trunc('quarter', completed_at) AS DATE), 0, 1 FROM library WHERE status = 'completed' AND completed_at IS NOT NULL) SELECT quarter, CAST(sum(s) AS BIGINT) AS started, CAST(sum(f) AS BIGINT) AS finished FROM q GROUP BY 1 ORDER BY 1 DESC LIMIT 8"))
def library_quarters(spark, d):
    return op.quarter_portfolio(library(spark, d))


@query(sql(ALL, f", {START} SELECT pattern_id, CAST(percent + CASE WHEN status = 'wishlist' THEN 5 ELSE 0 END AS BIGINT) AS score FROM startable JOIN library USING (pattern_id) ORDER BY 2 DESC, 1 LIMIT 1"))
def library_recommended(spark, d):
    return op.recommended(*everything(spark, d)).withColumn("score", F.col("score").cast("long"))


@query(sql("library", "SELECT designer, count(*) AS total, count(*) FILTER (status = 'completed') AS finished FROM library GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def library_designers(spark, d):
    return op.designers(library(spark, d))


@query(sql("library", "SELECT CASE WHEN size < 5000 THEN 'small' WHEN size < 25000 THEN 'medium' ELSE 'large' END AS bucket, status, count(*) AS n FROM library GROUP BY 1, 2"))
def library_sizes(spark, d):
    return op.size_buckets(library(spark, d))


@query(sql(ALL, f""", {OPEN}, {PER.format('open')}, n AS (SELECT pattern_id, {skeins_sql('stitches')} AS needed, coalesce(owned, 0) AS owned FROM per LEFT JOIN stash USING (id)), m AS (SELECT *, greatest(0, needed - owned) AS missing FROM n)
    SELECT pattern_id, CAST(sum(needed) AS BIGINT) AS needed, CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (missing = 0) AS n_owned, count(*) FILTER (missing > 0 AND owned > 0) AS n_partial, count(*) FILTER (missing > 0 AND owned <= 0) AS n_missing, round(sum(missing) * 0.95::DOUBLE, 6) AS cost FROM m GROUP BY 1"""))
def stash_shopping_list(spark, d):
    return op.shopping_list(*everything(spark, d)).withColumn("cost", F.round("cost", 6))


@query(sql(ALL, "SELECT count(*) AS n, count(*) >= 5 AS fires FROM stash WHERE owned > 0 AND id NOT IN (SELECT id FROM library_threads)"))
def stash_unused_hint(spark, d):
    _, needs, st = everything(spark, d)
    return op.unused_stock_count(st, needs)


@query(sql("stash", "SELECT id, brand, CAST(owned + CASE WHEN tobuy THEN 1 ELSE 0 END AS BIGINT) AS owned, FALSE AS tobuy FROM stash"))
def stash_purchases(spark, d):
    return op.purchases(stash(spark, d))


@query(sql("stash_history", ", d AS (SELECT id, date, sum(delta) AS delta FROM stash_history GROUP BY 1, 2), s AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY id ORDER BY date) AS BIGINT) AS stock, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS back FROM d) SELECT id, count(*) AS n, arg_max(stock, date) AS stock, min(stock) AS least_stock FROM s WHERE back <= 500 GROUP BY 1"))
def stash_running_stock(spark, d):
    return op.running_stock(stash_history(spark, d))


@query("SELECT l_orderkey AS pattern_id, l_linenumber AS line, l_partkey AS id, CAST(l_quantity * 100 AS BIGINT) AS stitches, " + skeins_sql("l_quantity * 100") + " AS skeins, greatest(1, " + skeins_sql("l_quantity * 100") + ") AS estimate, CAST(floor(l_quantity * (8.0::DOUBLE * 100 * 6 * (1 - 0.2::DOUBLE)) / (2.54::DOUBLE / 14 * 4.8::DOUBLE * 2)) AS BIGINT) AS stitches_of FROM lineitem")
def skein_arithmetic(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_quantity") * 100
    return li.select(F.col("l_orderkey").alias("pattern_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("id"), n.cast("long").alias("stitches"), sk.skeins_needed(n).alias("skeins"), sk.skeins_estimate(n).alias("estimate"), sk.stitches_of(F.col("l_quantity")).alias("stitches_of"))
