"""Queries over palettes in OKLab: twenty threads of the catalogue make a palette."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.adapters import sql, threads
from tessella.catalog.colour import CATALOGUE, lab_sql
from tessella.functions import colour as c
from tessella.operators import colour as colour_op
from tessella.operators import harmony as op
from tessella.registry import query

WIDE, FEW, VARIANTS, DEGREES = 26, 6, 9, 75


def palettes(spark, d):
    return threads(spark, d).select(F.floor(F.col("id") / 20).alias("project_id"), F.col("id").cast("int").alias("ord"), "r", "g", "b")


def _times(matrix, v: tuple[str, ...]) -> list[str]:
    return [" + ".join(f"{m!r}::DOUBLE * {x}" for m, x in zip(row, v, strict=True)) for row in matrix]


def _linear(x: str) -> str:
    return f"CASE WHEN {x} / 255.0::DOUBLE > 0.04045 THEN pow(({x} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {x} / 255.0::DOUBLE / 12.92 END"


def _held(x: str) -> str:
    gamma = f"CASE WHEN {x} > 0.0031308 THEN 1.055::DOUBLE * pow(greatest({x}, 0.0::DOUBLE), 1 / 2.4::DOUBLE) - 0.055 ELSE 12.92::DOUBLE * {x} END"
    return f"CAST(greatest(0, least(255, floor(({gamma}) * 255 + 0.5))) AS INTEGER)"


def to_ok(source: str) -> str:
    """source with ok_l, ok_a, ok_b of its r, g, b."""
    lms = ", ".join(f"cbrt({e}) AS {k}" for e, k in zip(_times(c.OK_LMS, ("lr", "lg", "lb")), ("ql", "qm", "qs"), strict=True))
    lab = ", ".join(f"{e} AS {k}" for e, k in zip(_times(c.OK_LAB, ("ql", "qm", "qs")), ("ok_l", "ok_a", "ok_b"), strict=True))
    linear = ", ".join(f"{_linear(x)} AS l{x}" for x in "rgb")
    return f"(SELECT * EXCLUDE (lr, lg, lb, ql, qm, qs), {lab} FROM (SELECT *, {lms} FROM (SELECT *, {linear} FROM {source})))"


def from_ok(source: str) -> str:
    """source with n_r, n_g, n_b for its n_l, n_a, n_b0."""
    cubes = ", ".join(f"({e}) AS {k}" for e, k in zip(_times(c.OK_ROOTS, ("n_l", "n_a", "n_b0")), ("cl", "cm", "cs"), strict=True))
    linear = ", ".join(f"{e} AS {k}" for e, k in zip(_times(c.OK_RGB, ("cl * cl * cl", "cm * cm * cm", "cs * cs * cs")), ("vr", "vg", "vb"), strict=True))
    return f"(SELECT * EXCLUDE (cl, cm, cs, vr, vg, vb), {_held('vr')} AS n_r, {_held('vg')} AS n_g, {_held('vb')} AS n_b FROM (SELECT *, {linear} FROM (SELECT *, {cubes} FROM {source})))"


def in_lch(source: str, light: str, chroma: str, hue: str) -> str:
    """source with n_r, n_g, n_b for expressions over its l0, c0, h0, which come from r, g, b."""
    polar = f"(SELECT *, ok_l AS l0, sqrt(ok_a * ok_a + ok_b * ok_b) AS c0, CASE WHEN ok_a = 0 AND ok_b = 0 THEN 0.0 WHEN degrees(atan2(ok_b, ok_a)) < 0 THEN degrees(atan2(ok_b, ok_a)) + 360 ELSE degrees(atan2(ok_b, ok_a)) END AS h0 FROM {to_ok(source)})"
    moved = f"(SELECT *, {light} AS n_l, {chroma} AS n_c, {hue} AS n_h FROM {polar})"
    return from_ok(f"(SELECT *, n_c * cos(radians(n_h)) AS n_a, n_c * sin(radians(n_h)) AS n_b0 FROM {moved})")


PALETTES = "pal AS (SELECT id // 20 AS project_id, CAST(id AS INTEGER) AS ord, r, g, b FROM threads)"
TURNED = in_lch("pal", "l0", "c0", f"(h0 + {DEGREES}.0) % 360.0")


@query(sql("threads", f", {PALETTES} SELECT project_id, ord, n_r AS r, n_g AS g, n_b AS b FROM {TURNED}"))
def palette_turned(spark, d):
    return op.turned(palettes(spark, d), DEGREES)


LOCKED = f"""{CATALOGUE}, {PALETTES}, new AS (SELECT project_id, ord, n_r AS r, n_g AS g, n_b AS b FROM {TURNED} WHERE ord % 9 <> 0), {lab_sql('new', 'project_id, ord', 'z')}, best AS (SELECT project_id, z.ord, arg_min(struct_pack(t := thread_id, d := (z.lab_l - p.lab_l) * (z.lab_l - p.lab_l) + (z.lab_a - p.lab_a) * (z.lab_a - p.lab_a) + (z.lab_b - p.lab_b) * (z.lab_b - p.lab_b)), struct_pack(d := (z.lab_l - p.lab_l) * (z.lab_l - p.lab_l) + (z.lab_a - p.lab_a) * (z.lab_a - p.lab_a) + (z.lab_b - p.lab_b) * (z.lab_b - p.lab_b), o := p.ord)) AS m FROM z, palette p GROUP BY 1, 2)"""


def locked(spark, d):
    p = palettes(spark, d).withColumns({"locked": F.col("ord") % 9 == 0, "thread_id": F.col("ord").cast("long")})
    return op.turned_onto(p, colour_op.colours(threads(spark, d)), DEGREES)


@query(sql("threads", f", {LOCKED} SELECT project_id, ord, m.t AS thread_id, round(sqrt(m.d), 5) AS delta, FALSE AS locked FROM best UNION ALL SELECT project_id, ord, CAST(ord AS BIGINT), 0, TRUE FROM pal WHERE ord % 9 = 0"))
def palette_turned_onto(spark, d):
    return locked(spark, d).withColumn("delta", F.round("delta", 5))


@query(sql("threads", f", {LOCKED} SELECT project_id, m.t AS thread_id, count(*) AS n FROM best GROUP BY 1, 2 HAVING count(*) > 1"))
def palette_collisions(spark, d):
    return op.collisions(locked(spark, d))


PARTNERS = f"base AS (SELECT id, r, g, b FROM threads), f AS (SELECT *, unnest([0, 1, 2]) AS k FROM base), q AS (SELECT id, k, CASE WHEN k = 0 THEN r ELSE n_r END AS r, CASE WHEN k = 0 THEN g ELSE n_g END AS g, CASE WHEN k = 0 THEN b ELSE n_b END AS b FROM {in_lch('f', 'l0', 'c0', '(h0 + [0.0, 120.0, 240.0][k + 1]) % 360.0')}), v AS (SELECT *, unnest(range(0, {VARIANTS - 3})) AS i FROM q), w AS (SELECT * FROM v WHERE (i // 2) % 3 = k)"
VARIED = in_lch("w", "CASE WHEN i % 2 = 0 THEN least(0.95::DOUBLE, l0 + 0.12::DOUBLE * (i // 2 // 3 + 1)) ELSE greatest(0.05::DOUBLE, l0 - 0.12::DOUBLE * (i // 2 // 3 + 1)) END", "c0 * CASE WHEN i % 2 = 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END", "h0")


@query(sql("threads", f", {PARTNERS} SELECT id, CAST(k AS INTEGER) AS place, r, g, b FROM q UNION ALL SELECT id, CAST(i + 3 AS INTEGER), n_r, n_g, n_b FROM {VARIED}"))
def palette_harmony(spark, d):
    return op.harmony(threads(spark, d).select("id", "r", "g", "b"), "triadic", VARIANTS)


POINT = "struct_pack(r := r, g := g, b := b, l := ok_l, a := ok_a, c := ok_b)"
GAP = "sqrt(pow({p}.l - {q}.l, 2) + pow({p}.a - {q}.a, 2) + pow({p}.c - {q}.c, 2))"
#: The widest gap of each palette gets its middle, round by round.
MIDDLE = to_ok(f"(SELECT * EXCLUDE (n_r, n_g, n_b, n_l, n_a, n_b0), n_r AS r, n_g AS g, n_b AS b FROM {from_ok('(SELECT *, (pts[mid].l + pts[mid + 1].l) / 2 AS n_l, (pts[mid].a + pts[mid + 1].a) / 2 AS n_a, (pts[mid].c + pts[mid + 1].c) / 2 AS n_b0 FROM (SELECT *, list_position(gaps, list_max(gaps)) AS mid FROM gapped))')})")


@query(sql("threads", f""", {PALETTES}, listed AS (SELECT project_id, list({POINT} ORDER BY ord) AS own, list({POINT} ORDER BY ok_l, ord) AS pts FROM {to_ok('pal')} GROUP BY 1),
    grown(project_id, pts) AS (SELECT project_id, CASE WHEN len(own) >= {WIDE} THEN own[1:{WIDE}] WHEN len(own) = 1 THEN list_transform(range(0, {WIDE}), lambda i: own[1]) ELSE pts END FROM listed
        UNION ALL SELECT project_id, list_concat(list_append(pts[1:mid], {POINT}), pts[mid + 1:]) FROM (WITH gapped AS (SELECT project_id, pts, list_transform(range(1, len(pts)), lambda i: {GAP.format(p='pts[i]', q='pts[i + 1]')}) AS gaps FROM grown WHERE len(pts) < {WIDE}) SELECT * FROM {MIDDLE})),
    done AS (SELECT project_id, pts FROM grown WHERE len(pts) = {WIDE}), u AS (SELECT project_id, unnest(range(0, {WIDE})) AS place, pts FROM done)
    SELECT project_id, CAST(place AS INTEGER) AS place, pts[place + 1].r AS r, pts[place + 1].g AS g, pts[place + 1].b AS b FROM u""").replace("WITH threads", "WITH RECURSIVE threads", 1))
def palette_expanded(spark, d):
    return op.expanded(palettes(spark, d), WIDE)


@query(sql("threads", f""", {PALETTES}, listed AS (SELECT project_id, list({POINT} ORDER BY ord) AS pts, list(ord ORDER BY ord) AS ords FROM {to_ok('pal')} GROUP BY 1),
    chosen(project_id, pts, ords, k, far) AS (SELECT project_id, pts, ords, 1, list_transform(range(1, len(pts) + 1), lambda i: CASE WHEN i = 1 THEN -1 ELSE {GAP.format(p='pts[i]', q='pts[1]')} END) FROM listed
        UNION ALL SELECT project_id, pts, ords, k + 1, list_transform(range(1, len(pts) + 1), lambda i: CASE WHEN i = mid THEN -1 ELSE least(far[i], {GAP.format(p='pts[i]', q='pts[mid]')}) END) FROM (SELECT *, list_position(far, list_max(far)) AS mid FROM chosen WHERE k < least({FEW}, len(pts)))),
    done AS (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM chosen WHERE k = least({FEW}, len(pts)))
    SELECT project_id, ords[i] AS ord, pts[i].r AS r, pts[i].g AS g, pts[i].b AS b FROM done WHERE far[i] < 0""").replace("WITH threads", "WITH RECURSIVE threads", 1))
def palette_reduced(spark, d):
    return op.reduced(palettes(spark, d), FEW)


@query(sql("threads", f", {CATALOGUE}, s AS (SELECT thread_id AS id, lab_l AS l, lab_a AS a, lab_b AS b FROM palette WHERE thread_id % 7 = 0), p AS (SELECT s.id, p.thread_id, p.ord, sqrt((s.l - p.lab_l) * (s.l - p.lab_l) + (s.a - p.lab_a) * (s.a - p.lab_a) + (s.b - p.lab_b) * (s.b - p.lab_b)) AS delta FROM s, palette p) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY delta, ord) AS INTEGER) AS rank, thread_id, round(delta, 5) AS delta FROM p QUALIFY rank <= 5"))
def palette_similar(spark, d):
    """Threads like every seventh one, which is what a user asks for."""
    own = colour_op.colours(threads(spark, d))
    points = own.where("thread_id % 7 = 0").select(F.col("thread_id").alias("id"), F.col("c_l").alias("l"), F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    return op.similar(points, own).withColumn("delta", F.round("delta", 5))
