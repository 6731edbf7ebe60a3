"""Colour matching. Catalogues have brand, id, name, r, g, b, ord; points have id, l, a, b.

Distances are computed between distinct colours only and joined back; which
colours are compared follows from their places (see operators.nearby).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import colour as c
from tessella.operators import nearby


def lab(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{x}") for x in ("l", "a", "b"))


def with_lab(threads: DataFrame) -> DataFrame:
    light, a, b = c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return threads.withColumns({"lab_l": light, "lab_a": a, "lab_b": b})


def colours(threads: DataFrame) -> DataFrame:
    """The distinct colours of a catalogue in Lab, each with its first thread."""
    first = threads.groupBy("r", "g", "b").agg(F.min_by("id", "ord").alias("thread_id"), F.min("ord").alias("ord"))
    light, a, b = c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return first.select("thread_id", "ord", light.alias("c_l"), a.alias("c_a"), b.alias("c_b"))


def distinct_points(points: DataFrame) -> DataFrame:
    return points.select("l", "a", "b").distinct()


def nearest(points: DataFrame, catalogue: DataFrame) -> DataFrame:
    """For each point the thread of least squared distance, the first of equal ones, with CIEDE2000, tier and words."""
    best = nearby.nearest_in_lab(distinct_points(points), catalogue).select("l", "a", "b", F.struct("thread_id", "c_l", "c_a", "c_b", "d2").alias("m"))
    target = tuple(F.col(f"m.c_{x}") for x in ("l", "a", "b"))
    out = points.join(best, ["l", "a", "b"]).withColumn("delta", c.ciede2000(lab(""), target))
    return out.select("id", F.col("m.thread_id").alias("thread_id"), F.col("m.d2").alias("d2"), "delta", c.match_tier(F.col("delta")).alias("tier"), c.difference_words(lab(""), target).alias("words"))


def substitutes(points: DataFrame, stock: DataFrame, k: int = 5) -> DataFrame:
    """The k colours in stock that are nearest by CIEDE2000, rounded to a tenth."""
    # What rounds to the tenth of the k-th may be a tenth farther.
    pairs = nearby.nearest_by_ciede2000(distinct_points(points), stock, k, 0.11).withColumn("delta", F.floor(F.col("delta") * 10 + 0.5) / 10)
    rank = F.row_number().over(Window.partitionBy("l", "a", "b").orderBy("delta", "ord"))
    top = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return points.join(top, ["l", "a", "b"]).select("id", "rank", "thread_id", "delta")


def near_pairs(stock: DataFrame, most: float = 1.0) -> DataFrame:
    """Pairs of colours in stock closer than most by CIEDE2000."""
    x = stock.select(F.col("thread_id").alias("first_id"), F.col("ord").alias("first_ord"), *(F.col(f"c_{k}").alias(k) for k in "lab"))
    near = nearby.within_ciede2000(x, stock, F.lit(float(most))).where(F.col("first_ord") < F.col("ord")).withColumn("delta", c.ciede2000(lab(""), lab("c_")))
    return near.where(F.col("delta") < most).select("first_id", F.col("thread_id").alias("second_id"), "delta")


def covered(points: DataFrame, stock: DataFrame, most: float = 6.0) -> DataFrame:
    """Whether any colour in stock is closer to a point than most."""
    near = nearby.within_ciede2000(distinct_points(points), stock, F.lit(float(most)))
    hit = near.where(c.ciede2000(lab(""), lab("c_")) < most).select("l", "a", "b").distinct().withColumn("covered", F.lit(True))
    return points.join(hit, ["l", "a", "b"], "left").select("id", F.coalesce("covered", F.lit(False)).alias("covered"))


def blends(catalogue: DataFrame) -> DataFrame:
    """Every pair of colours as the blend of their means, named by the sorted ids."""
    x, y = (catalogue.select(*(F.col(n).alias(f"{side}_{n}") for n in ("thread_id", "ord", "c_l", "c_a", "c_b"))) for side in ("x", "y"))
    ids = F.array_sort(F.array(F.col("x_thread_id").cast("string"), F.col("y_thread_id").cast("string")))
    mean = lambda k: ((F.col(f"x_c_{k}") + F.col(f"y_c_{k}")) / 2).alias(k)
    return x.join(y, F.col("x_ord") < F.col("y_ord")).select(F.array_join(ids, "+").alias("blend_id"), mean("l"), mean("a"), mean("b"))


def hue_bins(points: DataFrame) -> DataFrame:
    """Points in twelve bins of 30 degrees; -1 for chroma under 10."""
    bin_ = F.when(c.chroma(F.col("a"), F.col("b")) < 10, -1).otherwise(F.floor(c.hue(F.col("a"), F.col("b")) / 30) % 12)
    return points.groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def families(threads: DataFrame) -> DataFrame:
    named = with_lab(threads)
    return named.groupBy(c.family(F.col("name"), lab("lab_")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def described(threads: DataFrame) -> DataFrame:
    """HSL, OKLCH, luminance and contrast against white of every thread."""
    rgb = tuple(map(F.col, ("r", "g", "b")))
    h, s, light = c.hsl(*rgb)
    ok_l, ok_c, ok_h = c.rgb_to_oklch(*rgb)
    white = (F.lit(255), F.lit(255), F.lit(255))
    return threads.select("id", h.alias("hue"), s.alias("saturation"), light.alias("lightness"), ok_l.alias("ok_l"), ok_c.alias("ok_c"), F.when(ok_c > 1e-6, ok_h).alias("ok_h"), c.luminance(*rgb).alias("luminance"), c.contrast_ratio(*rgb, *white).alias("contrast"))


def from_lab(points: DataFrame) -> DataFrame:
    """The nearest displayable colour of every point."""
    r, g, b = c.lab_to_rgb(F.col("l"), F.col("a"), F.col("b"))
    return points.select("id", r.alias("r"), g.alias("g"), b.alias("b"))
