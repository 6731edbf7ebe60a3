"""Searches among colours by places in Lab, without comparing every colour with every other.

Lab is cut into boxes; colours meet in equi-joins on the box. A search within a
distance visits the boxes that the distance reaches; a search for the nearest among more than a thousand colours
widens its boxes round by round, for those colours only whose nearest may still
lie beyond the boxes visited. Both give what a full comparison gives, for a
catalogue of any size.

Points have l, a, b, each once; catalogues thread_id, ord, c_l, c_a, c_b.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import colour as c
from tessella.plans.rounds import forget, settled

#: Catalogues of so many colours are broadcast, and all of them compared, which is one plain job: where they stand, without a sort or shuffle of pairs.
FEW = 1000
#: The last round deals its points over so many tasks.
DEALT = 64
#: Side of the boxes of the first round, and one that holds all of Lab.
FIRST_SIDE, WHOLE = 12.0, 4096.0
#: Boxes for searches within a distance.
LIGHT_SIDE, PLANE_SIDE = 5.0, 20.0
#: The rotation term takes at most this share of the chroma and hue terms' squares: sin(60 degrees).
ROTATION = 0.8661


def _lab(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{x}") for x in "lab")


def nearest_in_lab(points: DataFrame, catalogue: DataFrame, k: int = 1, first_side: float = FIRST_SIDE, few: int = FEW) -> DataFrame:
    """The columns of points and of the catalogue, with d2 and rank, for the k colours of least squared distance, by ord among equals; fewer where the catalogue has fewer."""
    own = points.columns
    side, left, found = first_side, points, None
    order = Window.partitionBy("l", "a", "b").orderBy("d2", "ord")
    ranked = lambda met: met.withColumn("d2", c.delta_e2(_lab(""), _lab("c_"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    size = catalogue.limit(max(few, k) + 1).count()
    if size <= few:
        # One row is broadcast; each point looks at all colours by itself.
        every = catalogue.agg(F.collect_list(F.struct("ord", F.struct(*catalogue.columns).alias("c"))).alias("__all"))
        apart = F.transform("__all", lambda x: F.struct(c.delta_e2(_lab(""), tuple(x["c"][f"c_{y}"] for y in "lab")).alias("d2"), x["ord"].alias("ord"), x["c"].alias("c")))
        best = F.array_compact(F.array(F.array_min(apart))) if k == 1 else F.slice(F.sort_array(apart), 1, k)
        found = points.crossJoin(F.broadcast(every)).select(*own, F.posexplode(best).alias("__at", "__m"))
        return found.select(*own, *(F.col(f"__m.c.{x}").alias(x) for x in catalogue.columns), F.col("__m.d2").alias("d2"), (F.col("__at") + 1).alias("rank"))
    k = min(k, size)
    box = lambda prefix, step: [F.floor(F.col(f"{prefix}{x}") / step).cast("int").alias(f"box_{x}") for x in "lab"]
    while True:
        last = side >= WHOLE
        if last:
            # What is left is far from every colour, and such points are few: each is compared with all colours.
            zero = [F.lit(0).alias(f"box_{x}") for x in "ab"]
            asking = left.select("*", F.pmod(F.xxhash64("l", "a", "b"), F.lit(DEALT)).cast("int").alias("box_l"), *zero)
            there = catalogue.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("box_l"), *zero)
        else:
            asking = left.select("*", *box("", side))
            for x in "lab":
                asking = asking.withColumn("step", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(f"box_{x}", F.col(f"box_{x}") + F.col("step")).drop("step")
            there = catalogue.select("*", *box("c_", side))
        best = ranked(asking.join(there, [f"box_{x}" for x in "lab"]).drop(*(f"box_{x}" for x in "lab")))
        if not last:
            # All colours within one side were visited: k of them that near are the nearest.
            best = best.withColumn("sure", F.count_if(F.col("d2") <= side * side).over(Window.partitionBy("l", "a", "b")) >= k)
            best = settled(best.where("sure").drop("sure"), "nearest")
        found = best if found is None else found.unionByName(best)
        if last:
            return found
        rest = settled(left.join(best.select("l", "a", "b").distinct(), ["l", "a", "b"], "left_anti").select(*own), "left")
        forget(left)
        left = rest
        if left.isEmpty():
            return found
        side = side * 3 if side < 100 else WHOLE


def plane_reach(l_chroma: Column, most: Column) -> Column:
    """How far, in the plane of a and b, a colour can lie within so much CIEDE2000 of one of that chroma.

    With the widening of a left in, which only adds, the squares of the chroma and
    hue differences sum up to the squared distance in the plane; each is divided
    by at most 1 + 0.045 times the mean chroma, itself at most half as large
    again as in Lab, and the rotation term leaves a share of 1 - ROTATION. Null where no bound follows.
    """
    per_unit = most / (1 - ROTATION) ** 0.5
    # reach = per_unit * (1 + 0.045 * 1.5 * (chroma + reach / 2)), solved for reach.
    rest = 1 - per_unit * 0.045 * 1.5 / 2
    return F.when(rest > 0.02, per_unit * (1 + 0.045 * 1.5 * l_chroma) / rest)


def light_reach(farthest: Column, most: Column) -> Column:
    """How far apart in lightness two colours within so much CIEDE2000 can be, neither farther from 50 than farthest: with m for their mean less 50, the difference is divided by 1 + 0.015 * m**2 / sqrt(20 + m**2)."""
    return most * (1 + 0.015 * farthest)


def within_ciede2000(points: DataFrame, catalogue: DataFrame, most: Column, few: int = FEW) -> DataFrame:
    """Every pair of a point and a colour that may be within most (a column of points) by CIEDE2000; all that are, are among them."""
    # A reach beyond the bounds of the catalogue visits no more boxes than the catalogue has.
    ends = catalogue.agg(F.count(F.lit(1)).alias("n"), *(f(f"c_{x}").alias(f"{name}_{x}") for x in "lab" for f, name in ((F.min, "low"), (F.max, "high")))).first()
    farthest = F.greatest(F.abs(F.col("l") - 50), *(F.abs(F.lit(ends[k]) - 50) for k in ("low_l", "high_l")))
    reach_l = light_reach(farthest, most) + 1e-6
    reach = F.coalesce(plane_reach(c.chroma(F.col("a"), F.col("b")), most), F.lit(1e6)) + 1e-6
    asking = points.withColumns({"__l": reach_l, "__p": reach})
    keep = [*points.columns, *catalogue.columns]
    if ends["n"] <= few:
        # A point with a wide reach would visit thousands of boxes, more than there are colours.
        near = reduce(Column.__and__, (F.abs(F.col(x) - F.col(f"c_{x}")) <= F.col(r) for x, r in (("l", "__l"), ("a", "__p"), ("b", "__p"))))
        return asking.join(F.broadcast(catalogue), near).select(*keep)
    for x, r, side in (("l", "__l", LIGHT_SIDE), ("a", "__p", PLANE_SIDE), ("b", "__p", PLANE_SIDE)):
        first = F.floor(F.greatest(F.col(x) - F.col(r), F.lit(ends[f"low_{x}"])) / side).cast("int")
        final = F.floor(F.least(F.col(x) + F.col(r), F.lit(ends[f"high_{x}"])) / side).cast("int")
        asking = asking.withColumn(f"box_{x}", F.explode(F.when(first <= final, F.sequence(first, final))))
    there = catalogue.select("*", *(F.floor(F.col(f"c_{x}") / side).cast("int").alias(f"box_{x}") for x, side in (("l", LIGHT_SIDE), ("a", PLANE_SIDE), ("b", PLANE_SIDE))))
    return asking.join(there, ["box_l", "box_a", "box_b"]).where(F.abs(F.col("l") - F.col("c_l")) <= F.col("__l")).select(*keep)


def nearest_by_ciede2000(points: DataFrame, catalogue: DataFrame, k: int = 1, slack: float = 1e-6) -> DataFrame:
    """The columns of points and of the catalogue with delta, for every colour whose CIEDE2000 is at most slack more than that of the k-th nearest in Lab; so the k nearest by CIEDE2000, and more, are among them."""
    first = nearest_in_lab(points.select("l", "a", "b"), catalogue, k).withColumn("delta", c.ciede2000(_lab(""), _lab("c_")))
    bound = settled(first.groupBy("l", "a", "b").agg((F.max("delta") + slack).alias("__most")), "bounds")
    asked = points.join(bound, ["l", "a", "b"])
    # As an array of one, which no filter is pushed through, the difference is computed once for a pair.
    found = within_ciede2000(asked, catalogue, F.col("__most")).select("*", F.explode(F.array(c.ciede2000(_lab(""), _lab("c_")))).alias("delta"))
    return found.where(F.col("delta") <= F.col("__most")).drop("__most")
