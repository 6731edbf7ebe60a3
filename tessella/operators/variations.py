"""Variations of a palette: subsets by seeded shuffles, and catalogue entries for centres, each entry once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import colour as c
from tessella.functions import seeded
from tessella.operators import colour, nearby
from tessella.plans.rounds import forget, settled


def shuffled(items: DataFrame, group: str, seeds: DataFrame, keep: str) -> DataFrame:
    """group, place (from 0), item: the first `keep` items of each group in the order of a seeded shuffle.

    items: group, ord, item; seeds: group, seed (0 to 2**32 - 1). The shuffle
    swaps places from the last one down, each with a place drawn up to it, in the
    order of ord and item; keep is an expression over n, the size of the group.
    A group is a palette, which is small; it is shuffled as one array.
    """
    pools = items.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda s: s["item"]).alias("pool"))
    pools = pools.join(seeds.select(group, F.col("seed").cast("long").alias("seed")), group).withColumn("n", F.size("pool"))
    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    # Each place is drawn once, before the swaps, which move whole stretches of the array.
    draws = F.transform(steps, lambda step: F.struct((F.col("n") - step).alias("last"), seeded.below(F.col("seed"), step, F.col("n") - step + 1).cast("int").alias("drawn")))

    def swapped(pool, s):
        last, drawn = s["last"], s["drawn"]
        one = lambda at: F.array(F.get(pool, at))
        between = F.slice(pool, drawn + 2, last - drawn - 1)
        return F.when(drawn == last, pool).otherwise(F.concat(F.slice(pool, F.lit(1), drawn), one(last), between, one(drawn), F.slice(pool, last + 2, F.col("n"))))

    done = pools.select(group, "n", "pool", draws.alias("draws")).select(group, "n", F.aggregate("draws", F.col("pool"), swapped).alias("pool"))
    return done.select(group, "n", F.posexplode("pool").alias("place", "item")).where(F.col("place") < F.expr(keep)).drop("n")


def nearest_entries(centres: DataFrame, catalogue: DataFrame, k: int) -> DataFrame:
    """centres (l, a, b and others) with the rank and id of each one's k nearest catalogue entries in Lab."""
    found = nearby.nearest_in_lab(colour.distinct_points(centres), catalogue, k).select("l", "a", "b", "rank", F.col("thread_id").alias("id"))
    return centres.join(found, ["l", "a", "b"]).drop("l", "a", "b")


def each_once(near: DataFrame, group: str) -> DataFrame:
    """group, cluster, id: for every centre in order the nearest entry that none before it has taken.

    near: group, cluster, rank, id: of each centre its nearest entries by rank, as
    many as a group has centres, since no more can be taken before it; a group's
    centres and ranks are few. A centre whose entries are all taken has no row.
    """
    ranked = near.groupBy(group, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))
    rows = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("cluster", "ids"))).alias("centres"))
    kind = dict(near.dtypes)
    start = F.array().cast(f"array<struct<cluster:{kind['cluster']},id:{kind['id']}>>")

    def choose(taken, centre):
        free = F.get(F.filter(centre["ids"], lambda i: ~F.exists(taken, lambda t: t["id"] == i)), F.lit(0))
        return F.when(free.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(centre["cluster"].alias("cluster"), free.alias("id")))))

    return rows.select(group, F.inline(F.aggregate("centres", start, choose)))


#: Pixels of an image whose weights are added up together, and of an image up to which all of them lie in one task.
BLOCK, IMAGE = 4096, 1_000_000
#: Squared Lab distances count in millionths, so that sums do not depend on their order.
PARTS = 1_000_000


def seeded_centres(pixels: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """image_id, cluster (from 1), r, g, b: k pixels of every image, each drawn by its squared Lab distance to those before it.

    pixels: image_id, idx (from 0, without gaps), r, g, b; seeds: image_id, seed. The first is drawn
    evenly; an image without k pixels has as many as it has. Where all pixels have
    been drawn in colour the first pixel is drawn again. Images move once and their
    draws are windows over their pixels; where an image is larger than IMAGE, distances
    are added up by blocks of pixels, so that none is in one task.
    """
    largest = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return _drawn_by_image(pixels, seeds, k) if largest <= IMAGE else _drawn_by_block(pixels, seeds, k)


def _drawn_by_image(pixels: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    image, order = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("pos")
    every = image.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = pixels.select("image_id", F.col("idx").cast("long").alias("pos"), "r", "g", "b").join(seeds.select("image_id", F.col("seed").cast("long").alias("seed")), "image_id")
    at = at.withColumn("size", F.count(F.lit(1)).over(image))
    light, a, b = c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    at = at.withColumns({"p": F.struct(light.alias("l"), a.alias("a"), b.alias("b"))})
    own = ["image_id", "pos", "r", "g", "b", "seed", "size", "p"]
    here = F.col("pos") == seeded.below(F.col("seed"), F.lit(1), F.col("size"))
    at = at.select(*own, F.lit(2**62).alias("weight"), F.when(here, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("clusters"), here.alias("here"))
    for cluster in range(2, k + 1):
        last = F.max(F.when(F.col("here"), F.col("p"))).over(every)
        at = at.withColumn("c", last)
        lab = lambda s: tuple(F.col(f"{s}.{x}") for x in "lab")
        distance = F.floor(c.delta_e2(lab("p"), lab("c")) * PARTS + 0.5).cast("long")
        # Without a centre before it an image gets no more: its weights are null.
        at = at.withColumn("weight", F.when(F.col("c").isNotNull(), F.least("weight", distance)))
        at = at.withColumns({"acc": F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("weight").over(every)})
        bits = seeded.bits(F.col("seed"), F.lit(cluster))
        reached = F.col("acc").cast("decimal(38,0)") * F.lit(2**32).cast("decimal(10,0)") >= bits.cast("decimal(10,0)") * F.col("total").cast("decimal(19,0)")
        at = at.withColumn("chosen", F.min(F.when((F.col("size") >= cluster) & reached, F.col("pos"))).over(every))
        here = F.coalesce(F.col("pos") == F.col("chosen"), F.lit(False))
        at = at.select(*own, "weight", F.when(here, F.concat("clusters", F.array(F.lit(cluster)))).otherwise(F.col("clusters")).alias("clusters"), here.alias("here"))
    return at.where(F.size("clusters") > 0).select("image_id", F.explode("clusters").alias("cluster"), "r", "g", "b")


def _drawn_by_block(pixels: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Distances are kept for an image's distinct colours and added up by blocks, so a draw looks into one block of each image."""
    position = pixels.select("image_id", F.col("idx").cast("long").alias("pos"), "r", "g", "b")
    light, a, b = c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    position = settled(position.withColumn("block", F.floor(F.col("pos") / BLOCK)), "positions")
    counts = settled(position.groupBy("image_id", "block", "r", "g", "b").agg(F.count(F.lit(1)).alias("n")), "counts")
    images = settled(counts.groupBy("image_id").agg(F.sum("n").alias("size")).join(seeds.select("image_id", F.col("seed").cast("long").alias("seed")), "image_id"), "images")
    colours = counts.select("image_id", "r", "g", "b").distinct().withColumns({"p_l": light, "p_a": a, "p_b": b, "weight": F.lit(2**62)})
    drawn = images.select("image_id", seeded.below(F.col("seed"), F.lit(1), F.col("size")).alias("pos"))
    found = settled(position.join(drawn, ["image_id", "pos"]).select("image_id", F.lit(1).alias("cluster"), "r", "g", "b"), "centres")
    centres = [found]
    before = None
    for cluster in range(2, k + 1):
        last_l, last_a, last_b = c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
        last = found.select("image_id", last_l.alias("c_l"), last_a.alias("c_a"), last_b.alias("c_b"))
        distance = F.floor(c.delta_e2(tuple(F.col(f"p_{x}") for x in "lab"), tuple(F.col(f"c_{x}") for x in "lab")) * PARTS + 0.5).cast("long")
        colours = settled(colours.join(last, "image_id").withColumn("weight", F.least("weight", distance)).drop("c_l", "c_a", "c_b"), "weights")
        if before is not None:
            forget(before)
        before = colours
        weights = colours.select("image_id", "r", "g", "b", "weight")
        blocks = counts.join(weights, ["image_id", "r", "g", "b"]).groupBy("image_id", "block").agg(F.sum(F.col("n") * F.col("weight")).alias("sum"))
        order = Window.partitionBy("image_id").orderBy("block")
        blocks = blocks.select("image_id", "block", (F.sum("sum").over(order) - F.col("sum")).alias("before"), F.sum("sum").over(order).alias("until"), F.sum("sum").over(Window.partitionBy("image_id")).alias("total"))
        reached = lambda acc: F.col(acc).cast("decimal(38,0)") * F.lit(2**32).cast("decimal(10,0)") >= F.col("bits").cast("decimal(10,0)") * F.col("total").cast("decimal(19,0)")
        blocks = blocks.join(images.where(F.col("size") >= cluster).select("image_id", seeded.bits(F.col("seed"), F.lit(cluster)).alias("bits")), "image_id").where(reached("until"))
        block = blocks.groupBy("image_id").agg(F.min_by(F.struct("block", "before", "total", "bits"), "block").alias("at")).select("image_id", "at.*")
        inside = position.join(block, ["image_id", "block"]).join(weights, ["image_id", "r", "g", "b"])
        upto = F.col("before") + F.sum("weight").over(Window.partitionBy("image_id").orderBy("pos"))
        first = inside.withColumn("acc", upto).where(reached("acc")).groupBy("image_id").agg(F.min_by(F.struct("r", "g", "b"), "pos").alias("at"))
        found = settled(first.select("image_id", F.lit(cluster).alias("cluster"), "at.*"), "centres")
        centres.append(found)
    forget(position, counts, images, colours)
    return reduce(DataFrame.union, centres)
