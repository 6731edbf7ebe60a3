"""Edges of images: gradients in Lab, Canny edges, and the map of protected places around them.

Images are tables of pixels as in operators.image, and stencils are its windows
along rows and columns; a place inside the image is one with all nine values.
Hysteresis follows links between runs of candidates in neighbouring rows, in
rounds over all images together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import colour as c
from tessella.operators.image import NINE, PLACES, SOBEL_X, SOBEL_Y, along_row, around, blurred, filled, full, padded, weighted
from tessella.plans.rounds import least_reached, settled

#: Blur before the gradient, and the thresholds of hysteresis.
SIGMA, LOW, HIGH = 1.4, 30.0, 80.0
#: Weights of red, green and blue.
GREY = (0.2126, 0.7152, 0.0722)
#: Upper bounds of the direction in degrees, and the two places that a gradient of it is compared with; what is beyond all lies in line again.
ALONG = ((22.5, ((-1, 0), (1, 0))), (67.5, ((1, -1), (-1, 1))), (112.5, ((0, -1), (0, 1))), (157.5, ((-1, -1), (1, 1))), (None, ((-1, 0), (1, 0))))
#: Decimals of a gradient: the order of a sum must not decide between equal ones.
DECIMALS = 6


def _steps(places) -> Column:
    return F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in places))


def _gradients(values: DataFrame, *columns: str) -> DataFrame:
    """values with g_{column}x and g_{column}y of each column, and inside: whether all eight neighbours are in the image too."""
    near = around(full(values), "there", *columns, held=False).where("there")
    inside = reduce(Column.__and__, (F.coalesce(F.col(f"{p}.there"), F.lit(False)) for p in NINE))
    sums = [weighted(w, v).alias(f"g_{v}{axis}") for v in columns for w, axis in ((SOBEL_X, "x"), (SOBEL_Y, "y"))]
    return near.select(*values.columns, inside.alias("inside"), *sums)


def gradients(values: DataFrame, *columns: str) -> DataFrame:
    """image_id, x, y and g_{column}x and g_{column}y of each column, for places whose eight neighbours are in the image too."""
    return _gradients(values, *columns).where("inside").drop("inside", *(c for c in values.columns if c not in ("image_id", "x", "y")))


def lab_sobel(pixels: DataFrame) -> DataFrame:
    """image_id, idx, magnitude: the gradient over all three Lab axes; 0 at the border."""
    light, a, b = c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    g = _gradients(filled(pixels).select("image_id", "idx", "x", "y", "fill", light.alias("l"), a.alias("a"), b.alias("b")), "l", "a", "b")
    total = sum(F.col(f"g_{v}{axis}") * F.col(f"g_{v}{axis}") for v in "lab" for axis in "xy")
    return g.where("not fill").select("image_id", "idx", F.when(F.col("inside"), F.coalesce(F.sqrt(total), F.lit(0.0))).otherwise(0.0).alias("magnitude"))


def thinned(gradient: DataFrame) -> DataFrame:
    """image_id, x, y, magnitude of the places that are not less than both neighbours along their gradient. gradient: image_id, x, y, gx, gy."""
    magnitude = F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), DECIMALS)
    found = full(gradient.select("image_id", "x", "y", magnitude.alias("magnitude"), F.abs(F.degrees(F.atan2("gy", "gx"))).alias("angle")))
    at = lambda dx, dy: F.col(f"{('up', 'level', 'down')[dy + 1]}.{('left', 'mid', 'right')[dx + 1]}.magnitude")
    other = F.lit(None)
    for upper, beside in reversed(ALONG):
        most = F.greatest(*(at(*p) for p in beside))
        other = most if upper is None else F.when(F.col("angle") < upper, most).otherwise(other)
    near = around(found, "magnitude", held=False).where((F.col("magnitude") > 0) & (F.col("magnitude") >= F.coalesce(other, F.lit(0.0))))
    return near.select("image_id", "x", "y", "magnitude")


def connected_to_strong(places: DataFrame) -> DataFrame:
    """image_id, x, y of places (image_id, x, y, strong) that steps in eight directions over places connect with a strong one."""
    # Places without a gap in a row are one run, told by its first place; x less the position is the same along it.
    run = F.col("x") - F.row_number().over(along_row())
    first = F.min("x").over(Window.partitionBy("image_id", "y", "run"))
    own = places.select("image_id", "x", "y", "strong", run.alias("run")).select("image_id", "x", "y", "strong", (F.shiftleft(F.col("y").cast("long"), 32) + first).alias("node"))
    own = settled(own, "candidates")
    # A place tells its run to the three below it; equal runs that meet there are one link.
    told = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (-1, 1), (0, 1), (1, 1)))))
    sent = own.repartition("image_id").select("image_id", "x", "y", "node", told.alias("s"))
    sent = sent.select("image_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.when(F.col("s.dy") == 0, F.col("node")).alias("u"), F.when(F.col("s.dy") == 1, F.col("node")).alias("v"))
    met = sent.groupBy("image_id", "x", "y").agg(F.max("u").alias("u"), F.collect_set("v").alias("v")).where("u is not null")
    links = met.select("image_id", "u", F.explode("v").alias("v")).distinct()
    roots = least_reached(links, "image_id")
    # Roots come to the places of their runs as rows, and then all of a root's places say whether one is strong.
    rows = own.withColumn("root", F.lit(None).cast("long")).unionByName(roots, allowMissingColumns=True).repartition("image_id")
    root = F.coalesce(F.max("root").over(Window.partitionBy("image_id", "node")), F.col("node"))
    held = F.max("strong").over(Window.partitionBy("image_id", "root"))
    return rows.withColumn("root", root).where("x is not null").withColumn("held", held).where("held").select("image_id", "x", "y")


def canny(pixels: DataFrame, sigma: float = SIGMA, low: float = LOW, high: float = HIGH) -> DataFrame:
    """image_id, x, y of the edge pixels; a last row that is cut short goes on with its last pixel."""
    grey = padded(pixels).select("image_id", "x", "y", sum(w * F.col(v) for w, v in zip(GREY, "rgb", strict=True)).alias("v"))
    g = gradients(blurred(grey, "v", sigma), "v").select("image_id", "x", "y", F.col("g_vx").alias("gx"), F.col("g_vy").alias("gy"))
    return connected_to_strong(thinned(g).where(F.col("magnitude") >= low).select("image_id", "x", "y", (F.col("magnitude") >= high).alias("strong")))


def widened(places: DataFrame, times: int) -> DataFrame:
    """Places (image_id, x, y) and those up to so many squares around them, whether in the image or not."""
    for _ in range(times):
        places = places.select("image_id", "x", "y", F.explode(_steps(PLACES)).alias("s")).select("image_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).distinct()
    return places


def edge_map(pixels: DataFrame, dilation: int = 1, **thresholds: float) -> DataFrame:
    """image_id, idx, edge: whether a pixel is an edge or within dilation squares of one."""
    edges = canny(pixels, **thresholds).select("image_id", "x", "y", F.lit(None).cast("long").alias("idx"), F.lit(True).alias("edge"))
    rows = pixels.select("image_id", "x", "y", "idx", F.lit(False).alias("edge")).unionByName(edges).repartition("image_id")
    hit = full(rows.groupBy("image_id", "x", "y").agg(F.max("idx").alias("idx"), F.max("edge").alias("edge")))
    for _ in range(dilation):
        any_ = reduce(Column.__or__, (F.coalesce(F.col(f"{p}.edge"), F.lit(False)) for p in NINE))
        hit = around(hit, "edge", held=False).withColumn("edge", any_).drop("up", "level", "down")
    return hit.where("idx is not null").select("image_id", "idx", "edge")
