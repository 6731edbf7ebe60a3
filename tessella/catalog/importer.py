"""Queries over imported documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, sql, table, threads
from tessella.operators import importer as op
from tessella.registry import query


def files(spark, d):
    """Pages as files: every third keeps its text, others get a head of another format."""
    p = table(spark, d, "pages")
    k = F.col("page_id")
    head = F.when(k % 6 == 0, "%PDF-1.7").when(k % 6 == 1, '  {"a": 1}').when(k % 6 == 2, "<?xml version='1.0'?>").when(k % 6 == 3, "<chart w='1'>").otherwise(F.substring(F.coalesce("html", F.lit("")), 1, 64))
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "json", "oxs", "bin"))), (k % 4 + 1).cast("int"))
    return p.select(F.concat(F.lit("f"), k.cast("string"), F.lit("."), ext).alias("name"), head.cast("binary").alias("head"), F.when(k % 5 == 0, "image/png").otherwise("").alias("mime"))


FILES = """files AS (SELECT 'f' || page_id || '.' || ['pdf', 'json', 'oxs', 'bin'][page_id % 4 + 1] AS name, page_id % 4 AS e, CASE WHEN page_id % 5 = 0 THEN 'image/png' ELSE '' END AS mime, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'json' WHEN 2 THEN 'oxs' WHEN 3 THEN 'oxs' END AS magic FROM pages),
    x AS (SELECT *, CASE e WHEN 0 THEN 'pdf' WHEN 1 THEN 'json' WHEN 2 THEN 'oxs' END AS ext FROM files)"""


@query(f"WITH {FILES} SELECT name, coalesce(magic, ext, CASE WHEN mime = 'image/png' THEN 'image' END, 'unknown') AS format, CAST(CASE WHEN magic IS NOT NULL THEN CASE WHEN ext = magic THEN 1.0 ELSE 0.9 END WHEN ext IS NOT NULL THEN 0.7 WHEN mime = 'image/png' THEN 0.6 ELSE 0 END AS DOUBLE) AS confidence FROM x")
def import_sniff(spark, d):
    return op.sniff(files(spark, d))


@query("WITH s AS (SELECT o_orderkey AS file, 's' || (o_custkey % 5) AS strategy, o_custkey % 5 AS ord, CAST(floor(o_totalprice) % 7 AS BIGINT) AS score FROM orders UNION ALL SELECT o_orderkey, 't', 9, CAST(o_custkey % 7 AS BIGINT) FROM orders) SELECT file, strategy, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, ord) = 1")
def import_best_strategy(spark, d):
    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("file"), F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("strategy"), (F.col("o_custkey") % 5).alias("ord"), (F.floor("o_totalprice") % 7).cast("long").alias("score"))
    b = o.select(F.col("o_orderkey").alias("file"), F.lit("t").alias("strategy"), F.lit(9).cast("long").alias("ord"), (F.col("o_custkey") % 7).cast("long").alias("score"))
    return op.best_strategy(a.unionByName(b))


def lists(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("dmc "), c, F.lit("; #"), k, F.lit(", anchor"), c, F.lit("\tE168,,Blanc")).alias("text"))


@query(sql("threads", ", o AS (SELECT o_orderkey AS id, unnest([{'p': 0, 'c': CAST(o_custkey AS VARCHAR)}, {'p': 1, 'c': CAST(o_orderkey AS VARCHAR)}, {'p': 2, 'c': CAST(o_custkey AS VARCHAR)}, {'p': 3, 'c': 'E168'}, {'p': 4, 'c': 'BLANC'}]) AS t FROM orders) SELECT o.id, CAST(t.p AS INTEGER) AS position, t.c AS code, threads.id AS thread_id FROM o LEFT JOIN threads ON CAST(threads.id AS VARCHAR) = t.c"))
def import_bulk_codes(spark, d):
    return op.resolved_codes(op.bulk_codes(lists(spark, d)), threads(spark, d))


@query(sql("threads", "SELECT id, printf('#%02X%02x%02x', r, g, b) AS hex, r, g, b, CAST(CASE WHEN id % 5 = 0 THEN 170 END AS INTEGER) AS short_r FROM threads"))
def import_hex(spark, d):
    t = threads(spark, d)
    byte = lambda c, upper: F.format_string("%02X" if upper else "%02x", F.col(c))
    coded = t.withColumn("hex", F.concat(F.lit("#"), byte("r", True), byte("g", False), byte("b", False)))
    c = op.hex_channels(F.col("hex"))
    short = op.hex_channels(F.when(F.col("id") % 5 == 0, "#abc").otherwise("#zz"))
    return coded.select("id", "hex", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), short["r"].alias("short_r"))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), h AS (SELECT name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM n) SELECT name, CAST(h AS BIGINT) AS h FROM h")
def import_name_hash(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("h", op.name_hash(F.col("name")))


#: Words of a page by its number, so that every rule has pages.
PAGE_WORDS = ("", "Colour key 310 321 666 703 B5200 3865 D310", "Aida 14 ct, stranded cotton", "Wash before you start", "Symbole 310", "Nothing in particular")


@query(f"""WITH p AS (SELECT o_custkey AS page_id, o_custkey % 4 AS page, [{', '.join(f"'{w}'" for w in PAGE_WORDS)}][o_custkey % {len(PAGE_WORDS)} + 1] AS text, CAST(sum(floor(o_totalprice / 10000)) AS BIGINT) AS total, CAST(sum(o_orderkey % 150) AS BIGINT) AS fills, count(*) * 5 AS colours, count(*) FILTER (o_orderstatus = 'P') > 1 AS large_image FROM orders GROUP BY 1),
    t AS (SELECT *, lower(text) AS low FROM p), k AS (SELECT *, regexp_matches(low, 'colour key|symbole') AS legend, CASE WHEN page_id % 6 = 1 THEN 5 WHEN page_id % 6 IN (2, 4) THEN 1 ELSE 0 END AS codes FROM t),
    r AS (SELECT page_id, CASE WHEN total < 50 THEN 0 WHEN colours >= 50 AND fills >= 1000 THEN 1 WHEN colours >= 5 AND fills >= 1000 THEN 2 WHEN fills >= 500 AND legend THEN 3 WHEN legend AND codes >= 5 THEN 4 WHEN contains(low, 'aida') THEN 5 WHEN large_image AND fills < 100 THEN 6 WHEN page = 1 AND total < 200 AND low <> '' THEN 7 WHEN contains(low, 'wash') THEN 8 ELSE 9 END AS rule FROM k)
    SELECT page_id, ['blank', 'chart-vector-colour', 'chart-vector-bs', 'chart-combined', 'legend', 'materials', 'cover', 'cover', 'instructions', 'instructions'][rule + 1] AS role, [1.0::DOUBLE, 0.9, 0.9, 0.8, 0.85, 0.75, 0.9, 0.6, 0.7, 0.4][rule + 1] AS confidence FROM r""")
def import_page_roles(spark, d):
    o = table(spark, d, "orders")
    p = o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.sum(F.floor(F.col("o_totalprice") / 10000)).cast("long").alias("total"), F.sum(F.col("o_orderkey") % 150).alias("fills"), (F.count(F.lit(1)) * 5).alias("colours"), (F.count_if(F.col("o_orderstatus") == "P") > 1).alias("large_image"))
    text = F.element_at(F.array(*map(F.lit, PAGE_WORDS)), (F.col("page_id") % len(PAGE_WORDS) + 1).cast("int"))
    return op.page_roles(p.withColumns({"page": F.col("page_id") % 4, "text": text}))


@query("""WITH r AS (SELECT l_suppkey AS page_id, CASE WHEN l_suppkey % 5 = 0 THEN (l_partkey % 2) * 2.5::DOUBLE WHEN l_suppkey % 7 = 0 THEN (l_partkey % 60) * 0.25::DOUBLE ELSE (l_partkey % 41) * 2.5::DOUBLE + (l_partkey % 3) * 0.3::DOUBLE END AS v, CASE WHEN l_suppkey % 35 <> 0 THEN l_quantity END AS size FROM lineitem),
    d AS (SELECT DISTINCT page_id, floor(v * 100 + 0.5) / 100 AS v FROM r), s AS (SELECT page_id, v, v - lag(v) OVER (PARTITION BY page_id ORDER BY v) AS gap, count(*) OVER (PARTITION BY page_id) AS n FROM d),
    n AS (SELECT page_id, floor(gap * 10 + 0.5) / 10 AS step, count(*) AS n, min(v) AS first FROM s WHERE gap > 0.5 AND n >= 3 GROUP BY 1, 2), c AS (SELECT page_id, step FROM n QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) = 1),
    m AS (SELECT page_id, list_sort(list(CAST(size AS DOUBLE)) FILTER (size > 0)) AS sizes FROM r GROUP BY 1) SELECT page_id, coalesce(step, sizes[len(sizes) // 2 + 1], 0) AS pitch FROM m LEFT JOIN c USING (page_id)""")
def import_pitch(spark, d):
    """Pages with steps of several widths, with two coordinates, with steps that are too small, and without sizes."""
    page, part = F.col("l_suppkey"), F.col("l_partkey")
    v = F.when(page % 5 == 0, (part % 2) * 2.5).when(page % 7 == 0, (part % 60) * 0.25).otherwise((part % 41) * 2.5 + (part % 3) * 0.3)
    return op.pitch(table(spark, d, "lineitem").select(page.alias("page_id"), v.alias("v"), F.when(page % 35 != 0, F.col("l_quantity")).alias("size")))


CODED = "coded AS (SELECT project_id AS doc, CASE WHEN thread_id IN ('__skip__', '__empty__') THEN NULL ELSE thread_id END AS code, CASE WHEN thread_id = '__empty__' OR project_id % 3 = 0 AND idx % 3 <> 0 THEN 0.0::DOUBLE ELSE 0.9 END AS confidence FROM cells WHERE thread_id <> '__skip__'), legend AS (SELECT DISTINCT project_id AS doc, 't' || (idx % 9) AS code, project_id % 97 AS expected FROM cells WHERE idx < 8), sizes AS (SELECT DISTINCT project_id AS doc, project_id * 13 % 1300 AS width, project_id * 7 % 40 AS height FROM cells)"


@query(sql("cells", f""", {CODED}, c AS (SELECT doc, code, count(*) AS actual FROM coded WHERE code IS NOT NULL GROUP BY 1, 2), j AS (SELECT coalesce(c.doc, l.doc) AS doc, coalesce(c.code, l.code) AS code, actual, expected, l.code IS NOT NULL AS listed FROM c FULL JOIN legend l ON c.doc = l.doc AND c.code = l.code), v AS (SELECT doc, count(*) FILTER (confidence > 0) / count(*)::DOUBLE AS share FROM coded GROUP BY 1), z AS (SELECT s.*, coalesce(share, 0) AS share, share IS NULL AS none FROM sizes s LEFT JOIN v USING (doc))
    SELECT doc, code, 'COUNT_MISMATCH' AS finding, 'medium' AS severity FROM j WHERE expected > 0 AND abs(coalesce(actual, 0) - expected) > greatest(5.0, expected * 0.1) UNION ALL SELECT doc, code, 'LEGEND_MISSING_CODE', 'medium' FROM j WHERE NOT listed AND doc IN (SELECT doc FROM legend) UNION ALL SELECT doc, code, 'LEGEND_UNUSED', 'low' FROM j WHERE actual IS NULL
    UNION ALL SELECT doc, NULL, CASE WHEN share < 0.5 THEN 'LOW_PALETTE_COVERAGE' ELSE 'PALETTE_COVERAGE' END, CASE WHEN share < 0.5 THEN 'high' ELSE 'medium' END FROM z WHERE share < 0.85 UNION ALL SELECT doc, NULL, 'EMPTY_GRID', 'error' FROM z WHERE none UNION ALL SELECT doc, NULL, 'GRID_TOO_LARGE', 'medium' FROM z WHERE width > 0 AND height > 0 AND (width > 1000 OR height > 1000) UNION ALL SELECT doc, NULL, 'GRID_TOO_SMALL', 'medium' FROM z WHERE width > 0 AND height > 0 AND (width < 5 OR height < 5)"""))
def import_validate(spark, d):
    c = cells(spark, d)
    k = F.col("project_id")
    sure = F.when((F.col("thread_id") == "__empty__") | (k % 3 == 0) & (F.col("idx") % 3 != 0), 0.0).otherwise(0.9)
    coded = c.where("thread_id <> '__skip__'").select(k.alias("doc"), F.when(F.col("thread_id") != "__empty__", F.col("thread_id")).alias("code"), sure.alias("confidence"))
    legend = c.where("idx < 8").select(k.alias("doc"), F.concat(F.lit("t"), (F.col("idx") % 9).cast("string")).alias("code"), (k % 97).alias("expected")).distinct()
    return op.validate(coded, legend, c.select(k.alias("doc"), (k * 13 % 1300).alias("width"), (k * 7 % 40).alias("height")).distinct())


@query(sql("cells", ", s AS (SELECT project_id AS doc, x, y, thread_id AS code FROM cells WHERE idx % 3 = 0), b AS (SELECT doc, max(x) AS w, max(y) AS h FROM s GROUP BY 1), r AS (SELECT doc, w, unnest(range(0, h + 1)) AS y FROM b), q AS (SELECT doc, y, unnest(range(0, w + 1)) AS x FROM r) SELECT q.doc, q.x, q.y, coalesce(code, '__skip__') AS code FROM q LEFT JOIN s ON q.doc = s.doc AND q.x = s.x AND q.y = s.y"))
def import_materialised(spark, d):
    return op.materialised(cells(spark, d).where("idx % 3 = 0").select(F.col("project_id").alias("doc"), "x", "y", F.col("thread_id").alias("code")))


@query("WITH e AS (SELECT event_id AS id, 0.5::DOUBLE * ((event_id % 11) / 10.0::DOUBLE) + 0.3::DOUBLE * ((event_id % 7) / 6.0::DOUBLE) + 0.2::DOUBLE * ((event_id % 3) / 2.0::DOUBLE) AS c FROM events) SELECT id, round(c, 6) AS confidence, CASE WHEN c >= 0.95 THEN 'accept' WHEN c >= 0.8 THEN 'review' ELSE 'guided' END AS mode FROM e")
def import_confidence(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(k.alias("id"), op.overall_confidence((k % 11) / 10.0, (k % 7) / 6.0, (k % 3) / 2.0).alias("c"))
    return e.select("id", F.round("c", 6).alias("confidence"), op.review_mode(F.col("c")).alias("mode"))
