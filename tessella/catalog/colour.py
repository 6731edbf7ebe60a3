"""Queries over colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import lab_points, sql, stash, threads
from tessella.operators import colour as op
from tessella.registry import query


def _linear(x: str) -> str:
    return f"CASE WHEN {x} / 255.0::DOUBLE > 0.04045 THEN pow(({x} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {x} / 255.0::DOUBLE / 12.92 END"


def _root(x: str) -> str:
    return f"CASE WHEN {x} > 216.0::DOUBLE / 24389 THEN pow({x}, 1.0::DOUBLE / 3) ELSE (24389.0::DOUBLE / 27 * ({x}) + 16) / 116 END"


def lab_sql(source: str, keep: str, name: str) -> str:
    """Views that end in the named one: keep and lab_l, lab_a, lab_b from r, g, b of the source."""
    return f"""{name}_1 AS (SELECT *, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM {source}),
    {name}_2 AS (SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047::DOUBLE AS tx, (0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb) / 1.0::DOUBLE AS ty, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883::DOUBLE AS tz FROM {name}_1),
    {name}_3 AS (SELECT *, {_root('tx')} AS fx, {_root('ty')} AS fy, {_root('tz')} AS fz FROM {name}_2),
    {name} AS (SELECT {keep}, 116 * fy - 16 AS lab_l, 500 * (fx - fy) AS lab_a, 200 * (fy - fz) AS lab_b FROM {name}_3)"""


def hue_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"


def delta_sql(source: str, name: str) -> str:
    """Views that end in the named one: source and delta, the CIEDE2000 of l1, a1, b1 and l2, a2, b2."""
    weight = lambda c: f"sqrt(pow({c}, 7.0) / (pow({c}, 7.0) + pow(25.0::DOUBLE, 7.0)))"
    return f"""{name}_1 AS (SELECT *, 1.5::DOUBLE - 0.5 * {weight('((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2)')} AS wide FROM {source}),
    {name}_2 AS (SELECT *, sqrt(a1 * wide * a1 * wide + b1 * b1) AS c1, sqrt(a2 * wide * a2 * wide + b2 * b2) AS c2, {hue_sql('(a1 * wide)', 'b1')} AS h1, {hue_sql('(a2 * wide)', 'b2')} AS h2 FROM {name}_1),
    {name}_3 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (l1 + l2) / 2 - 50 AS ml, (c1 + c2) / 2 AS mc FROM {name}_2),
    {name}_4 AS (SELECT *, 1 - 0.17::DOUBLE * cos(radians(mh - 30)) + 0.24::DOUBLE * cos(radians(2 * mh)) + 0.32::DOUBLE * cos(radians(3 * mh + 6)) - 0.2::DOUBLE * cos(radians(4 * mh - 63)) AS t FROM {name}_3),
    {name}_5 AS (SELECT *, (l2 - l1) / (1 + 0.015::DOUBLE * ml * ml / sqrt(20 + ml * ml)) AS dl, (c2 - c1) / (1 + 0.045::DOUBLE * mc) AS ds, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015::DOUBLE * mc * t) AS dt FROM {name}_4),
    {name} AS (SELECT *, sqrt(greatest(0.0::DOUBLE, dl * dl + ds * ds + dt * dt - 2 * {weight('mc')} * sin(radians(60 * exp(-pow((mh - 275) / 25, 2.0)))) * ds * dt)) AS delta FROM {name}_5)"""


OWNED = "owned AS (SELECT t.* FROM threads t JOIN stash s ON t.id = s.id WHERE owned > 0)"
FIRSTS = "firsts AS (SELECT r, g, b, arg_min(id, ord) AS thread_id, min(ord) AS ord FROM {} GROUP BY r, g, b)"
CATALOGUE = f"{FIRSTS.format('threads')}, {lab_sql('firsts', 'thread_id, ord', 'palette')}"
STOCK = f"{OWNED}, {FIRSTS.format('owned')}, {lab_sql('firsts', 'thread_id, ord', 'palette')}"
PAIRS = "pairs AS (SELECT p.id, thread_id, ord, l AS l1, a AS a1, p.b AS b1, lab_l AS l2, lab_a AS a2, lab_b AS b2 FROM lab_points p, palette)"


def owned(spark, d):
    return threads(spark, d).join(stash(spark, d).where("owned > 0").select("id"), "id", "left_semi")


@query(sql("threads", f", {lab_sql('threads', 'id', 'x')} SELECT id, round(lab_l, 6) AS lab_l, round(lab_a, 6) AS lab_a, round(lab_b, 6) AS lab_b FROM x"))
def colour_catalogue_lab(spark, d):
    return op.with_lab(threads(spark, d)).select("id", *(F.round(f"lab_{x}", 6).alias(f"lab_{x}") for x in ("l", "a", "b")))


@query(sql("lab_points threads", f""", {CATALOGUE}, {PAIRS}, d2 AS (SELECT *, (l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2) AS d2 FROM pairs), best AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, ord) = 1), {delta_sql('best', 'x')},
    w AS (SELECT *, sqrt(a2 * a2 + b2 * b2) - sqrt(a1 * a1 + b1 * b1) AS dc, CASE WHEN abs(a2 - a1) >= 5 THEN CASE WHEN a2 < a1 THEN 'greener' ELSE 'redder' END END AS wa, CASE WHEN abs(b2 - b1) >= 5 THEN CASE WHEN b2 < b1 THEN 'bluer' ELSE 'yellower' END END AS wb FROM x),
    v AS (SELECT *, list_filter([CASE WHEN abs(l2 - l1) >= 5 THEN CASE WHEN l2 < l1 THEN 'darker' ELSE 'lighter' END END, CASE WHEN abs(dc) >= 5 THEN CASE WHEN dc < 0 THEN 'less saturated' ELSE 'more saturated' END END, CASE WHEN abs(a2 - a1) >= abs(b2 - b1) THEN wa ELSE wb END, CASE WHEN abs(a2 - a1) >= abs(b2 - b1) THEN wb ELSE wa END], lambda z: z IS NOT NULL) AS words FROM w)
    SELECT id, thread_id, round(d2, 6) AS d2, round(delta, 6) AS delta, CASE WHEN delta < 1 THEN 'exact' WHEN delta < 3 THEN 'close' WHEN delta < 5 THEN 'good' WHEN delta < 10 THEN 'fair' WHEN delta < 20 THEN 'poor' ELSE 'none' END AS tier, CASE WHEN len(words) = 0 THEN 'very close' ELSE array_to_string(words[1:2], ', ') END AS words FROM v"""))
def colour_nearest(spark, d):
    return op.nearest(lab_points(spark, d), op.colours(threads(spark, d))).withColumns({c: F.round(c, 6) for c in ("d2", "delta")})


@query(sql("lab_points threads stash", f", {STOCK}, {PAIRS}, {delta_sql('pairs', 'x')}, y AS (SELECT id, thread_id, ord, floor(delta * 10 + 0.5) / 10 AS delta FROM x) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY delta, ord) AS INTEGER) AS rank, thread_id, delta FROM y QUALIFY rank <= 5"))
def colour_substitutes(spark, d):
    return op.substitutes(lab_points(spark, d), op.colours(owned(spark, d)))


@query(sql("threads stash", f", {STOCK}, pairs AS (SELECT x.thread_id AS first_id, y.thread_id AS second_id, x.lab_l AS l1, x.lab_a AS a1, x.lab_b AS b1, y.lab_l AS l2, y.lab_a AS a2, y.lab_b AS b2 FROM palette x JOIN palette y ON x.ord < y.ord), {delta_sql('pairs', 'z')} SELECT first_id, second_id, round(delta, 6) AS delta FROM z WHERE delta < 3"))
def colour_near_pairs(spark, d):
    return op.near_pairs(op.colours(owned(spark, d)), 3.0).withColumn("delta", F.round("delta", 6))


@query(sql("lab_points threads stash", f", {STOCK}, {PAIRS}, {delta_sql('pairs', 'x')} SELECT id, bool_or(delta < 6) AS covered FROM x GROUP BY 1"))
def colour_coverage(spark, d):
    return op.covered(lab_points(spark, d), op.colours(owned(spark, d)))


@query(sql("threads", f", {CATALOGUE} SELECT array_to_string(list_sort([CAST(x.thread_id AS VARCHAR), CAST(y.thread_id AS VARCHAR)]), '+') AS blend_id, round((x.lab_l + y.lab_l) / 2, 6) AS l, round((x.lab_a + y.lab_a) / 2, 6) AS a, round((x.lab_b + y.lab_b) / 2, 6) AS b FROM palette x JOIN palette y ON x.ord < y.ord"))
def colour_blends(spark, d):
    return op.blends(op.colours(threads(spark, d))).withColumns({c: F.round(c, 6) for c in ("l", "a", "b")})


@query(sql("lab_points", f", h AS (SELECT CASE WHEN sqrt(a * a + b * b) < 10 THEN -1 ELSE CAST(floor(({hue_sql('a', 'b')}) / 30) AS BIGINT) % 12 END AS bin FROM lab_points) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n FROM h GROUP BY 1"))
def colour_hue_bins(spark, d):
    return op.hue_bins(lab_points(spark, d))


@query(sql("threads", f""", {lab_sql('threads', 'name, id', 'x')}, y AS (SELECT *, sqrt(lab_a * lab_a + lab_b * lab_b) AS c, {hue_sql('lab_a', 'lab_b')} AS h FROM x)
    SELECT CASE WHEN regexp_matches(lower(name), 'metalli|effect|jewel|gold|silver|copper|bronze|pearl|fluor') THEN 'metallics' WHEN lab_l >= 92 AND c < 14 THEN 'whites' WHEN lab_l <= 18 AND c < 14 THEN 'blacks' WHEN c < 10 THEN 'greys' WHEN lab_a > 6 AND lab_b > 6 AND lab_l < 60 AND c < 38 THEN 'browns' WHEN h >= 340 OR h < 12 THEN 'reds' WHEN h < 30 THEN 'pinks' WHEN h < 55 THEN 'oranges' WHEN h < 75 THEN 'yellows' WHEN h < 165 THEN 'greens' WHEN h < 200 THEN 'teals' WHEN h < 260 THEN 'blues' WHEN h < 320 THEN 'purples' ELSE 'pinks' END AS family, count(*) AS n FROM y GROUP BY 1"""))
def colour_families(spark, d):
    return op.families(threads(spark, d))


@query(sql("threads", f""", x AS (SELECT id, r, g, b, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM threads),
    m AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo, (greatest(x, y, z) + least(x, y, z)) / 2 AS li, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS q1, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS q2, cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS q3, 0.2126 * lr + 0.7152 * lg + 0.0722 * lb AS lum FROM x),
    o AS (SELECT *, 0.2104542553 * q1 + 0.7936177850 * q2 - 0.0040720468 * q3 AS ol, 1.9779984951 * q1 - 2.4285922050 * q2 + 0.4505937099 * q3 AS oa, 0.0259040371 * q1 + 0.7827717662 * q2 - 0.8086757660 * q3 AS ob FROM m)
    SELECT id, round(CASE WHEN hi = lo THEN 0 WHEN hi = x THEN 60 * ((y - z) / (hi - lo) + CASE WHEN y < z THEN 6 ELSE 0 END) WHEN hi = y THEN 60 * ((z - x) / (hi - lo) + 2) ELSE 60 * ((x - y) / (hi - lo) + 4) END, 5) AS hue, round(CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(2 * li - 1)) END, 5) AS saturation, round(li, 5) AS lightness, round(ol, 5) AS ok_l, round(sqrt(oa * oa + ob * ob), 5) AS ok_c, CASE WHEN sqrt(oa * oa + ob * ob) > 1e-6 THEN round({hue_sql('oa', 'ob')}, 5) END AS ok_h, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 5) AS luminance, round((1.0 + 0.05) / (lum + 0.05), 5) AS contrast FROM o"""))
def colour_described(spark, d):
    return op.described(threads(spark, d)).withColumns({c: F.round(c, 5) for c in ("hue", "saturation", "lightness", "ok_l", "ok_c", "ok_h", "luminance", "contrast")})


def _back(t: str) -> str:
    return f"CASE WHEN {t} > 0.2069 THEN {t} * {t} * {t} ELSE ({t} - 16.0::DOUBLE / 116) / 7.787::DOUBLE END"


def _gamma(c: str) -> str:
    return f"CAST(greatest(0, least(255, floor((CASE WHEN {c} > 0.0031308 THEN 1.055::DOUBLE * pow(greatest({c}, 0), 1.0::DOUBLE / 2.4) - 0.055 ELSE 12.92::DOUBLE * ({c}) END) * 255 + 0.5))) AS INTEGER)"


@query(sql("lab_points", f", f AS (SELECT id, (l + 16) / 116 AS fy, a / 500 + (l + 16) / 116 AS fx, (l + 16) / 116 - b / 200 AS fz FROM lab_points), v AS (SELECT id, ({_back('fx')}) * 0.95047::DOUBLE AS x, {_back('fy')} AS y, ({_back('fz')}) * 1.08883::DOUBLE AS z FROM f), k AS (SELECT id, 3.2406::DOUBLE * x - 1.5372::DOUBLE * y - 0.4986::DOUBLE * z AS lr, -0.9689::DOUBLE * x + 1.8758::DOUBLE * y + 0.0415::DOUBLE * z AS lg, 0.0557::DOUBLE * x - 0.2040::DOUBLE * y + 1.0570::DOUBLE * z AS lb FROM v) SELECT id, {_gamma('lr')} AS r, {_gamma('lg')} AS g, {_gamma('lb')} AS b FROM k"))
def colour_from_lab(spark, d):
    return op.from_lab(lab_points(spark, d))
