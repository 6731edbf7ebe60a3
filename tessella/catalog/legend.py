"""Queries over legends and stock totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import AS_OF, cells, library_threads, sessions, sql, stash, stash_history, threads
from tessella.operators import legend as op
from tessella.operators import stash as stash_op
from tessella.registry import query

STOCK = [("t1", 2), ("t2", 0), ("t3", 1), ("t5", 1), ("t6", 9)]
STOCK_SQL = "stock AS (SELECT * FROM (VALUES " + ", ".join(map(str, STOCK)) + ") v(thread_id, owned))"
SKEINS = "CAST(ceil(CASE WHEN {n} * 2.54::DOUBLE / 14 * 4.8::DOUBLE * {s} / (8.0::DOUBLE * 100 * 6 * (1 - 0.2::DOUBLE)) < 0.01 THEN 0 ELSE {n} * 2.54::DOUBLE / 14 * 4.8::DOUBLE * {s} / (8.0::DOUBLE * 100 * 6 * (1 - 0.2::DOUBLE)) END) AS BIGINT)"
LEGEND = f"""{STOCK_SQL}, n AS (SELECT project_id, thread_id, count(*) AS n, CAST(sum(done) AS BIGINT) AS done FROM cells WHERE thread_id NOT IN ('__skip__', '__empty__') GROUP BY 1, 2),
    k AS (SELECT n.*, greatest(1, CASE WHEN contains(n.thread_id, '+') THEN {SKEINS.format(n='n', s=1)} ELSE {SKEINS.format(n='n', s=2)} END) AS needed, CAST(coalesce(owned, 0) AS INTEGER) AS owned FROM n LEFT JOIN stock USING (thread_id)), legend AS (SELECT *, CASE WHEN owned >= needed THEN 'owned' WHEN owned > 0 THEN 'partial' ELSE 'needed' END AS status FROM k)"""


def legend(spark, d):
    return op.rows(cells(spark, d), spark.createDataFrame(STOCK, "thread string, owned int"))


@query(sql("cells", f", {LEGEND} SELECT * FROM legend"))
def legend_rows(spark, d):
    return legend(spark, d)


@query(sql("cells", f", {LEGEND} SELECT project_id, count(*) AS n_ids, CAST(sum(needed) AS BIGINT) AS skeins, CAST(sum(greatest(0, needed - owned)) AS BIGINT) AS to_buy, count(*) FILTER (status = 'owned') AS covered FROM legend GROUP BY 1"))
def legend_totals(spark, d):
    return op.totals(legend(spark, d))


def _place(by: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY project_id ORDER BY {by} num NULLS LAST, thread_id) AS INTEGER)"


@query(sql("cells", f", {LEGEND}, m AS (SELECT *, CASE WHEN regexp_full_match(thread_id, '[0-9]+') THEN CAST(thread_id AS BIGINT) END AS num, CASE status WHEN 'needed' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END AS s FROM legend) SELECT project_id, thread_id, {_place('')} AS by_number, {_place('n DESC,')} AS by_stitches, {_place('needed DESC,')} AS by_skeins, {_place('s,')} AS by_status FROM m"))
def legend_orders(spark, d):
    return op.orders(legend(spark, d))


@query(sql("cells", f", {LEGEND} SELECT project_id, coalesce(array_to_string(list(thread_id ORDER BY thread_id) FILTER (status = 'owned'), ','), '') AS owned, coalesce(array_to_string(list(thread_id ORDER BY thread_id) FILTER (status <> 'owned'), ','), '') AS to_buy FROM legend GROUP BY 1"))
def legend_owned_and_to_buy(spark, d):
    return op.split_by_status(legend(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("owned", "to_buy")})


@query(sql("cells", ", i AS (SELECT DISTINCT project_id, CASE WHEN starts_with(thread_id, 't') AND NOT contains(thread_id, '+') THEN (idx % 7) || thread_id ELSE thread_id END AS thread_id FROM cells WHERE thread_id NOT IN ('__skip__', '__empty__')), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY contains(thread_id, '+'), CASE WHEN NOT contains(thread_id, '+') THEN CAST(regexp_extract(thread_id, '^[0-9]+') AS BIGINT) END NULLS LAST, thread_id) AS k FROM i) SELECT project_id, thread_id, CAST(k AS INTEGER) AS position, CAST(57344 + (k - 1) % 24 AS INTEGER) AS symbol FROM r"))
def legend_symbols(spark, d):
    c = cells(spark, d)
    plain = F.col("thread_id").startswith("t") & ~F.col("thread_id").contains("+")
    return op.symbols(c.withColumn("thread_id", F.when(plain, F.concat((F.col("idx") % 7).cast("string"), "thread_id")).otherwise(F.col("thread_id"))), 0xE000, 24)


@query(sql("threads", "SELECT id, CASE WHEN (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255 > 0.55 THEN 'black' ELSE 'white' END AS ink FROM threads"))
def legend_contrast(spark, d):
    return threads(spark, d).select("id", op.contrast(F.col("r"), F.col("g"), F.col("b")).alias("ink"))


@query(sql("cells", ", p AS (SELECT project_id, 't' || unnest(range(1, 10)) AS thread_id FROM (SELECT DISTINCT project_id FROM cells)) SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.project_id = p.project_id AND c.thread_id = p.thread_id)"))
def legend_unused(spark, d):
    c = cells(spark, d)
    palette = c.select("project_id").distinct().select("project_id", F.explode(F.array(*(F.lit(f"t{i}") for i in range(1, 10)))).alias("thread_id"))
    return op.unused(palette, c)


@query(sql("threads stash", ", h AS (SELECT DISTINCT id FROM stash WHERE owned > 6 AND brand = 'dmc') SELECT 'owned' AS what, brand, id, name FROM threads WHERE brand = 'dmc' AND id IN (SELECT id FROM h) UNION ALL SELECT 'all', brand, id, name FROM threads WHERE brand = 'dmc'"))
def legend_allowed(spark, d):
    """With a stock, and with none."""
    t, held = threads(spark, d), stash(spark, d).withColumn("owned", F.greatest(F.lit(0), F.col("owned") - 6))
    return op.allowed(t, held).select(F.lit("owned").alias("what"), "*").unionByName(op.allowed(t, held.where("false")).select(F.lit("all").alias("what"), "*"))


PATTERN = "t AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 16 END AS own, CASE WHEN pattern_id % 2 = 0 THEN 18 END AS usual, CASE WHEN ord % 5 = 0 THEN id + 1 END AS blend FROM library_threads), u AS (SELECT pattern_id, unnest(list_filter([id, blend], lambda z: z IS NOT NULL)) AS thread, CAST(ceil(stitches * 14 / coalesce(own, usual, 14)::DOUBLE * (2.54::DOUBLE / 14 * 4.8::DOUBLE * 2 / (8.0::DOUBLE * 100 * 6 * (1 - 0.2::DOUBLE)))) AS BIGINT) AS sk FROM t), n AS (SELECT pattern_id, thread, CAST(sum(sk) AS BIGINT) AS needed FROM u GROUP BY 1, 2), m AS (SELECT n.*, coalesce(owned, 0) < needed AS missing FROM n LEFT JOIN stash s ON s.id = n.thread)"


@query(sql("library_threads stash", f", {PATTERN} SELECT pattern_id, count(*) AS n_threads, CAST(sum(needed) AS BIGINT) AS needed, count(*) FILTER (missing) AS n_missing FROM m GROUP BY 1"))
def legend_pattern_threads(spark, d):
    n = library_threads(spark, d)
    needs = n.withColumns({"fabric": F.when(F.col("ord") % 3 == 0, 16), "blend_id": F.when(F.col("ord") % 5 == 0, F.col("id") + 1)})
    profiles = n.where("pattern_id % 2 = 0").select("pattern_id", F.lit(18).alias("fabric")).distinct()
    return op.missing_counts(op.pattern_threads(needs, profiles, stash(spark, d)))


@query(sql("stash", "SELECT CAST(coalesce(sum(owned), 0) AS BIGINT) AS owned, count(*) FILTER (owned > 0) AS n_threads FROM stash"))
def stash_total_owned(spark, d):
    return op.total_owned(stash(spark, d))


@query(sql("threads stash", "SELECT (SELECT count(DISTINCT id) FROM stash WHERE owned > 0 AND brand = 'dmc') AS owned, (SELECT count(*) FROM threads WHERE brand = 'dmc') AS total, round((SELECT count(DISTINCT id) FROM stash WHERE owned > 0 AND brand = 'dmc') / (SELECT count(*) FROM threads WHERE brand = 'dmc')::DOUBLE * 100, 6) AS percent"))
def stash_coverage(spark, d):
    return op.coverage(threads(spark, d), stash(spark, d)).withColumn("percent", F.round("percent", 6))


@query(sql("stash_history sessions", ", spine AS (SELECT CAST(unnest(generate_series(DATE '2023-02-01', DATE '2024-01-01', INTERVAL 1 MONTH)) AS DATE) AS month), came AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(delta) AS added FROM stash_history WHERE delta > 0 GROUP BY 1), used AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, floor(sum(net_stitches) / 1800.0::DOUBLE * 10 + 0.5) / 10 AS used FROM sessions GROUP BY 1), t AS (SELECT CAST(sum(coalesce(added, 0)) AS BIGINT) AS added, sum(coalesce(used, 0.0::DOUBLE)) AS used FROM spine s LEFT JOIN came c ON c.month = s.month LEFT JOIN used u ON u.month = s.month) SELECT added, round(used, 6) AS used, CASE WHEN used > 0 THEN floor(added / used * 10 + 0.5) / 10 END AS ratio, CASE WHEN used = 0 OR added / used > 1.5 THEN 'adding' WHEN added / used >= 0.8 THEN 'balanced' ELSE 'using' END AS kind FROM t WHERE added > 0 OR used > 0"))
def stash_buying_headline(spark, d):
    return op.buying_headline(stash_op.monthly_flow(stash_history(spark, d), sessions(spark, d), AS_OF)).withColumn("used", F.round("used", 6))
