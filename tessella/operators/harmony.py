"""Palettes turned, extended, widened and thinned in OKLab. Palettes have project_id, ord, r, g, b.

A palette is the list of a project's colours, some hundreds at most, so the two
operators that pick one colour after the other work on it as one array, project
by project, inside expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import colour as c
from tessella.operators import colour as search
from tessella.operators import nearby

#: Degrees that each harmony adds to the base hue.
HARMONIES = {"complementary": (180,), "analogous": (-30, 30), "triadic": (120, 240), "split": (150, 210)}
#: How far variants of a harmony move in lightness, its bounds, and the chroma they keep.
STEP, DARKEST, LIGHTEST, LIGHT_CHROMA, DARK_CHROMA = 0.12, 0.05, 0.95, 0.8, 0.9


def turned(palette: DataFrame, degrees: float) -> DataFrame:
    """The palette with every hue turned."""
    new = c.turned(F.col("r"), F.col("g"), F.col("b"), F.lit(float(degrees)))
    return palette.withColumn("__new", new).withColumns({k: F.col(f"__new.{k}") for k in "rgb"}).drop("__new")


def turned_onto(palette: DataFrame, catalogue: DataFrame, degrees: float) -> DataFrame:
    """project_id, ord, thread_id, delta, locked: the catalogue's nearest thread to each turned colour; locked entries (locked, thread_id) keep theirs. catalogue: see colour.colours."""
    as_lab = lambda x: F.struct(*(v.alias(k) for k, v in zip("lab", c.rgb_to_lab(*(x["m"][k] for k in "rgb")), strict=True)))
    new = c.bind({"m": c.turned(F.col("r"), F.col("g"), F.col("b"), F.lit(float(degrees)))}, as_lab)
    points = palette.where("not locked").select(F.struct("project_id", "ord").alias("id"), new.alias("p")).select("id", "p.l", "p.a", "p.b")
    found = search.nearest(points, catalogue).select("id.project_id", "id.ord", "thread_id", F.sqrt("d2").alias("delta"), F.lit(False).alias("locked"))
    return found.unionByName(palette.where("locked").select("project_id", "ord", "thread_id", F.lit(0.0).alias("delta"), "locked"))


def collisions(mapping: DataFrame) -> DataFrame:
    """Threads that several free entries of a project were turned onto: project_id, thread_id, n."""
    return mapping.where("not locked").groupBy("project_id", "thread_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def harmony(bases: DataFrame, kind: str, count: int | None = None) -> DataFrame:
    """id, place (from 0), r, g, b: the base colour, its partners by hue, and up to count lighter and darker variants of these in turn. bases: id, r, g, b. Each distinct colour is worked once."""
    colour = F.struct("r", "g", "b")
    found = _harmony_of(bases.select("r", "g", "b").distinct().select(colour.alias("id"), "r", "g", "b"), kind, count)
    return bases.select("id", colour.alias("__base")).join(found.withColumnRenamed("id", "__base"), "__base").drop("__base")


def _harmony_of(bases: DataFrame, kind: str, count: int | None) -> DataFrame:
    angles = (0, *HARMONIES[kind])
    m = len(angles)
    count = m if count is None else max(count, m)
    first = bases.select("id", F.posexplode(F.array(*(F.lit(float(a)) for a in angles))).alias("k", "angle"), "r", "g", "b")
    new = c.turned(F.col("r"), F.col("g"), F.col("b"), F.col("angle"))
    partners = first.select("id", "k", "r", "g", "b", new.alias("new")).select("id", "k", *(F.when(F.col("k") == 0, F.col(x)).otherwise(F.col(f"new.{x}")).alias(x) for x in "rgb"))
    out = partners.select("id", F.col("k").alias("place"), "r", "g", "b")
    if count == m:
        return out
    # The i-th variant is of partner i // 2, wrapping around, lighter for even i and darker for odd.
    places = F.filter(F.sequence(F.lit(0), F.lit(count - m - 1)), lambda i: F.floor(i / 2) % m == F.col("k"))
    more = partners.select("id", F.explode(places).alias("i"), "r", "g", "b")
    step = STEP * (F.floor(F.floor(F.col("i") / 2) / m) + 1)
    lighter = F.col("i") % 2 == 0
    moved = lambda light, ch, h: (F.when(lighter, F.least(F.lit(LIGHTEST), light + step)).otherwise(F.greatest(F.lit(DARKEST), light - step)), ch * F.when(lighter, LIGHT_CHROMA).otherwise(DARK_CHROMA), h)
    new = c.in_oklch(F.col("r"), F.col("g"), F.col("b"), moved)
    return out.unionByName(more.select("id", (F.col("i") + m).cast("int").alias("place"), new.alias("new")).select("id", "place", "new.r", "new.g", "new.b"))


def _point(r: Column, g: Column, b: Column) -> Column:
    ok = c.rgb_to_oklab(r, g, b)
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), *(v.alias(k) for v, k in zip(ok, ("ok_l", "ok_a", "ok_b"), strict=True)))


def _distance(p: Column, q: Column) -> Column:
    return F.sqrt(c.delta_e2(*(tuple(x[k] for k in ("ok_l", "ok_a", "ok_b")) for x in (p, q))))


def _listed(palette: DataFrame) -> DataFrame:
    """project_id and points: the colours in order, each with its OKLab coordinates."""
    by_ord = F.array_sort(F.collect_list(F.struct("ord", _point(F.col("r"), F.col("g"), F.col("b")).alias("p"))))
    return palette.groupBy("project_id").agg(F.transform(by_ord, lambda x: x["p"]).alias("points"))


def expanded(palette: DataFrame, count: int) -> DataFrame:
    """project_id, place (from 0), r, g, b: count colours, by inserting the middle of the widest gap between neighbours in lightness, the first of equal ones, again and again. A palette of as many or more gives its first ones."""

    def widen(points: Column, _) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: _distance(F.element_at(points, i), F.element_at(points, i + 1)))
        at = F.array_position(gaps, F.array_max(gaps)).cast("int")
        p, q = F.element_at(points, at), F.element_at(points, at + 1)
        middle = c.oklab_to_rgb(*((p[k] + q[k]) / 2 for k in ("ok_l", "ok_a", "ok_b")))
        # Bound first: the coordinates of the rounded colour name each of its channels often.
        point = c.bind({"m": middle}, lambda x: _point(x["m"]["r"], x["m"]["g"], x["m"]["b"]))
        return F.concat(F.slice(points, F.lit(1), at), F.array(point), F.slice(points, at + 1, F.size(points)))

    listed = _listed(palette)
    by_light = F.transform(F.array_sort(F.transform("points", lambda p, i: F.struct(p["ok_l"].alias("l"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    steps = F.slice(F.sequence(F.lit(1), F.lit(count)), F.lit(1), F.greatest(F.lit(0), count - F.size("points")))
    grown = F.when(F.size("points") >= count, F.slice("points", 1, count)).when(F.size("points") == 1, F.array_repeat(F.col("points")[0], count)).otherwise(F.aggregate(steps, by_light, widen))
    return listed.select("project_id", F.posexplode(grown).alias("place", "p")).select("project_id", "place", "p.r", "p.g", "p.b")


def reduced(palette: DataFrame, count: int) -> DataFrame:
    """project_id, ord, r, g, b of count colours that lie far apart: the first one, then always the colour farthest from its nearest chosen one, the first of equal ones."""
    listed = palette.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", _point(F.col("r"), F.col("g"), F.col("b")).alias("p")))).alias("items"))

    def far(apart: Column, chosen: Column) -> Column:
        """apart: the distance to the nearest chosen colour, -1 for chosen ones."""
        here = F.element_at(F.col("items"), chosen)["p"]
        return F.transform(F.arrays_zip(apart.alias("d"), F.col("items").alias("x")), lambda z, i: F.when(i + 1 == chosen, -1.0).otherwise(F.least(z["d"], _distance(z["x"]["p"], here))))

    def step(apart: Column, _) -> Column:
        return far(apart, F.array_position(apart, F.array_max(apart)).cast("int"))

    start = far(F.transform("items", lambda x: F.lit(float("inf"))), F.lit(1))
    rounds = F.slice(F.sequence(F.lit(1), F.lit(max(1, count))), F.lit(1), F.least(F.size("items"), F.lit(count)) - 1)
    apart = F.aggregate(rounds, start, step)
    kept = listed.where(F.lit(count > 0)).select("project_id", F.explode(F.arrays_zip(apart.alias("d"), F.col("items").alias("x"))).alias("z")).where("z.d < 0")
    return kept.select("project_id", "z.x.ord", "z.x.p.r", "z.x.p.g", "z.x.p.b")


def similar(points: DataFrame, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """id, rank, thread_id, delta: the k catalogue colours nearest by Euclidean Lab distance. points: id, l, a, b."""
    best = nearby.nearest_in_lab(search.distinct_points(points), catalogue, k).select("l", "a", "b", "rank", "thread_id", F.sqrt("d2").alias("delta"))
    return points.join(best, ["l", "a", "b"]).select("id", "rank", "thread_id", "delta")
