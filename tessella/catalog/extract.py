"""Queries over what is read from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import cells, sql, table, threads
from tessella.operators import extract as op
from tessella.registry import query


@query("WITH p AS (SELECT o_custkey AS page_id, o_custkey % 3 AS page, count(*) * 20 AS n_lines, CAST(sum(o_orderkey % 200) AS BIGINT) AS n_texts, count(*) FILTER (o_orderkey % 2 = 0) * 12 AS n_single, count(*) FILTER (o_orderstatus = 'P') > 0 AS mentions FROM orders GROUP BY 1) SELECT page_id, CASE WHEN n_lines > 50 AND (n_single > 50 OR n_texts > 1000 OR n_lines > 2000) THEN 'chart' WHEN mentions THEN 'legend' WHEN page = 1 THEN 'cover' ELSE 'info' END AS class FROM p")
def extract_older_classes(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    p = o.groupBy(F.col("o_custkey").alias("page_id")).agg((F.count(F.lit(1)) * 20).alias("n_lines"), F.sum(k % 200).alias("n_texts"), (F.count_if(k % 2 == 0) * 12).alias("n_single"), (F.count_if(F.col("o_orderstatus") == "P") > 0).alias("mentions"))
    return op.older_page_classes(p.withColumn("page", F.col("page_id") % 3))


RECTS = "rects AS (SELECT project_id AS page_id, x * 5.0::DOUBLE + 1 - (idx % 3) AS x, y * 4.0::DOUBLE + 2 AS y, [5.0::DOUBLE, 2.6, 2.0, 4.9][idx % 4 + 1] AS w, [4.0::DOUBLE, 3.9, 2.0, 1.9][idx % 4 + 1] AS h, CAST(idx * 7 % 256 AS INTEGER) AS r, CAST(idx * 3 % 256 AS INTEGER) AS g, CAST(idx % 5 * 50 AS INTEGER) AS b FROM cells WHERE idx % 2 = 0)"
SNAPPED = f"{RECTS}, snapped AS (SELECT page_id, CAST(floor((x + w / 2 - 1 - 2.5) / 5 + 0.5) AS BIGINT) AS col, CAST(floor((y + h / 2 - 2 - 2) / 4 + 0.5) AS BIGINT) AS row, r, g, b, CASE WHEN w / 5 > 0.9 AND h / 4 > 0.9 THEN 'full' WHEN w / 5 > 0.4 AND w / 5 < 0.65 AND h / 4 > 0.9 OR w / 5 > 0.9 AND h / 4 > 0.4 AND h / 4 < 0.65 THEN 'half' WHEN w / 5 < 0.65 AND h / 4 < 0.65 THEN 'quarter' ELSE 'full' END AS type FROM rects)"


def rects(spark, d):
    i = F.col("idx")
    of = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % 4 + 1).cast("int"))
    return cells(spark, d).where("idx % 2 = 0").select(F.col("project_id").alias("page_id"), (F.col("x") * 5.0 + 1 - i % 3).alias("x"), (F.col("y") * 4.0 + 2).alias("y"), of(5.0, 2.6, 2.0, 4.9).alias("w"), of(4.0, 3.9, 2.0, 1.9).alias("h"), (i * 7 % 256).cast("int").alias("r"), (i * 3 % 256).cast("int").alias("g"), (i % 5 * 50).cast("int").alias("b"))


def snapped(spark, d):
    r = rects(spark, d)
    grids = r.select("page_id").distinct().select("page_id", F.lit(5.0).alias("pitch_x"), F.lit(4.0).alias("pitch_y"), F.lit(1.0).alias("origin_x"), F.lit(2.0).alias("origin_y"))
    return op.snapped(r, grids)


@query(sql("cells", f", {SNAPPED} SELECT * FROM snapped WHERE col >= 0 AND row >= 0"))
def extract_snapped(spark, d):
    return snapped(spark, d)


@query(sql("cells threads", f""", {SNAPPED}, c AS (SELECT * FROM snapped WHERE col >= 0 AND row >= 0), l AS (SELECT DISTINCT page_id, 'c' || (r % 9) AS code, r, g, b, r * 1000 + g AS ord FROM rects WHERE r < 60), k AS (SELECT DISTINCT page_id, r, g, b FROM c),
    n AS (SELECT k.page_id, k.r, k.g, k.b, l.code, sqrt(pow(k.r - l.r, 2) + pow(k.g - l.g, 2) + pow(k.b - l.b, 2)) AS d FROM k JOIN l ON l.page_id = k.page_id QUALIFY row_number() OVER (PARTITION BY k.page_id, k.r, k.g, k.b ORDER BY d, ord, l.b) = 1),
    f AS (SELECT k.r, k.g, k.b, CAST(t.id AS VARCHAR) AS thread FROM (SELECT DISTINCT r, g, b FROM k) k, threads t QUALIFY row_number() OVER (PARTITION BY k.r, k.g, k.b ORDER BY pow(k.r - t.r, 2) + pow(k.g - t.g, 2) + pow(k.b - t.b, 2), ord) = 1)
    SELECT c.page_id, col, row, CASE WHEN n.d < 25 THEN n.code ELSE thread END AS code, CASE WHEN n.d = 0 THEN 'legend-exact' WHEN n.d < 25 THEN 'legend-nearest' ELSE 'catalogue' END AS kind, CAST(CASE WHEN n.d = 0 THEN 1.0 WHEN n.d < 25 THEN 0.95 ELSE 0.5 END AS DOUBLE) AS confidence FROM c LEFT JOIN n ON n.page_id = c.page_id AND n.r = c.r AND n.g = c.g AND n.b = c.b LEFT JOIN f ON f.r = c.r AND f.g = c.g AND f.b = c.b"""))
def extract_matched(spark, d):
    legend = rects(spark, d).where("r < 60").select("page_id", F.concat(F.lit("c"), (F.col("r") % 9).cast("string")).alias("code"), "r", "g", "b", F.struct((F.col("r") * 1000 + F.col("g")).alias("o"), "b").alias("ord")).distinct()
    return op.matched(snapped(spark, d), legend, threads(spark, d).select("id", "r", "g", "b", "ord"))


#: Rows of legends, by number; what a row holds is checked by value.
LINES = ("♥ 310 Black 2 strands", "X B5200 Snow White / cross stitch", "back stitch 3371 brown 1 strand", "Materials and tools", "★ E168 Argent point de croix", "glyph 666 demi-point red", "♥ 310 Black 2 strands")
ROWS = ((0, "♥", "310", "Black", 2, "full", 1.0), (1, "X", "B5200", "Snow White /", None, "full", 0.9), (2, "", "3371", "brown", 1, "bs", 0.85), (4, "★", "E168", "Argent", None, "full", 0.9), (5, "", "666", "red", None, "half", 0.75))


@query(f"SELECT CAST(c_custkey AS BIGINT) AS page_id, CAST(k AS INTEGER) AS band, glyph, code, label, CAST(strands AS INTEGER) AS strands, type, CAST(confidence AS DOUBLE) AS confidence FROM customer, (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in r) + ')' for r in ROWS)}) v(k, glyph, code, label, strands, type, confidence)")
def extract_legend_rows(spark, d):
    lines = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("page_id"), F.posexplode(F.array(*map(F.lit, LINES))).alias("band", "text"))
    return op.legend_rows(lines).withColumn("confidence", F.round("confidence", 6))


@query("WITH s AS (SELECT o_custkey AS page_id, o_orderkey AS item, CAST(o_orderkey % 97 AS DOUBLE) AS x, CAST((o_orderkey * 7) % 40 AS DOUBLE) * 0.9 AS y, 'w' || o_orderkey AS text FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y DESC, item) AS k FROM s), w(page_id, k, band, first) AS (SELECT page_id, k, 0, y FROM r WHERE k = 1 UNION ALL SELECT r.page_id, r.k, w.band + CAST(w.first - r.y > 2.5 AS INTEGER), CASE WHEN w.first - r.y > 2.5 THEN r.y ELSE w.first END FROM w JOIN r ON r.page_id = w.page_id AND r.k = w.k + 1) SELECT w.page_id, CAST(band AS INTEGER) AS band, max(first) AS y, string_agg(text, ' ' ORDER BY x, item) AS text FROM w JOIN r ON r.page_id = w.page_id AND r.k = w.k GROUP BY 1, 2".replace("WITH s", "WITH RECURSIVE s", 1))
def extract_bands(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    return op.bands(o.select(F.col("o_custkey").cast("long").alias("page_id"), k.cast("long").alias("item"), (k % 97).cast("double").alias("x"), ((k * 7 % 40).cast("double") * 0.9).alias("y"), F.concat(F.lit("w"), k.cast("string")).alias("text")))


MARKS = ("Page {a}/{b}", "page {a} sur {b}", "{a} of {b}", "no marker", "Seite {a} von {b}")


@query("WITH p AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, CAST(o_custkey % 9 + 1 AS BIGINT) AS a, CAST(o_orderkey % 8 + 1 AS BIGINT) AS b FROM orders) SELECT id, CASE WHEN k <> 3 AND b >= a THEN a END AS number, CASE WHEN k <> 3 AND b >= a THEN b END AS total FROM p")
def extract_page_markers(spark, d):
    o = table(spark, d, "orders")
    text = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    fill = lambda t, mark, v: F.replace(t, F.lit(mark), v.cast("string"))
    return op.page_markers(o.select(F.col("o_orderkey").alias("id"), fill(fill(text, "{a}", F.col("o_custkey") % 9 + 1), "{b}", F.col("o_orderkey") % 8 + 1).alias("text")))


#: Every chart as tiles of 10 x 8 cells by the number of its tile, numbered backwards on every other chart.
TILES = "t AS (SELECT DISTINCT project_id AS doc, x // 10 + 2 * (y // 8) AS tile FROM cells WHERE y < 16), n AS (SELECT doc, count(*) AS n FROM t GROUP BY 1), tiles AS (SELECT t.*, CASE WHEN doc % 2 = 0 THEN n - row_number() OVER (PARTITION BY doc ORDER BY tile) + 1 END AS number, n FROM t JOIN n USING (doc)), part AS (SELECT project_id AS doc, x // 10 + 2 * (y // 8) AS tile, x % 10 AS col, y % 8 AS row, thread_id AS code FROM cells WHERE y < 16)"


@query(sql("cells", f""", {TILES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY number, tile) - 1 AS i, CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 2 END AS cols FROM tiles) SELECT p.doc, col + 10 * (i % cols) AS col, row + 8 * (i // cols) AS row, code FROM part p JOIN o ON o.doc = p.doc AND o.tile = p.tile"""))
def extract_assembled(spark, d):
    c = cells(spark, d).where("y < 16")
    tile = (F.floor(F.col("x") / 10) + 2 * F.floor(F.col("y") / 8)).alias("tile")
    part = c.select(F.col("project_id").alias("doc"), tile, (F.col("x") % 10).alias("col"), (F.col("y") % 8).alias("row"), F.col("thread_id").alias("code"), F.lit(1.0).alias("confidence"))
    t = part.select("doc", "tile").distinct()
    w = F.count(F.lit(1)).over(op.Window.partitionBy("doc"))
    k = F.row_number().over(op.Window.partitionBy("doc").orderBy("tile"))
    tiles = t.withColumns({"n": w, "k": k}).select("doc", "tile", F.when(F.col("doc") % 2 == 0, F.col("n") - F.col("k") + 1).alias("number"), F.when(F.col("doc") % 2 == 0, F.col("n")).alias("total"), F.lit(10).cast("long").alias("cols"), F.lit(8).cast("long").alias("rows"))
    return op.assembled(tiles, part)


@query("WITH f AS (SELECT s_suppkey AS id, ['DMC Studio 3', 'made with FlossCross', 'Pattern Keeper', 'KGChart 1', 'plain', ''][s_suppkey % 6 + 1] AS meta, CASE WHEN s_suppkey % 12 = 4 THEN 'a DMC color key' END AS sample FROM supplier) SELECT id, CASE WHEN contains(lower(meta), 'dmc ') OR sample IS NOT NULL THEN 'dmc' WHEN id % 6 = 1 THEN 'flosscross' WHEN id % 6 = 2 THEN 'patternkeeper' WHEN id % 6 = 3 THEN 'kgchart' ELSE 'unknown' END AS publisher, CAST(CASE WHEN contains(lower(meta), 'dmc ') OR sample IS NOT NULL THEN 0.95 WHEN id % 6 IN (1, 2) THEN 0.9 WHEN id % 6 = 3 THEN 0.85 ELSE 0 END AS DOUBLE) AS confidence FROM f")
def extract_publisher(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    meta = F.element_at(F.array(*map(F.lit, ("DMC Studio 3", "made with FlossCross", "Pattern Keeper", "KGChart 1", "plain", ""))), (k % 6 + 1).cast("int"))
    return op.publisher(s.select(k.alias("id"), meta.alias("meta"), F.when(k % 12 == 4, "a DMC color key").alias("sample")))
