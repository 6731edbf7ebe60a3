"""Palettes: replacing threads, capping and merging colours, and what a palette needs.

catalogue: brand, thread_id, ord, c_l, c_a, c_b (see colour.colours); palettes
are ids with counts. Loops run over palettes, which are small for each chart, as
joins over all charts at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import colour as c
from tessella.operators import nearby
from tessella.operators.colour import lab
from tessella.plans.rounds import settled


def proposals(sources: DataFrame, conversions: DataFrame, candidates: DataFrame, most: float = 10.0) -> DataFrame:
    """For each source (id, l, a, b): its charted conversion, else the nearest candidate within reach, else a near miss within half as much again.

    conversions: src_id, dst_id, confidence. Candidates are thread_id, ord, c_*.
    """
    charted = sources.join(conversions, sources["id"] == F.col("src_id")).select("id", F.col("dst_id").alias("thread_id"), F.lit(None).cast("double").alias("delta"), F.concat(F.lit("charted-"), "confidence").alias("how"))
    rest = sources.join(charted.select("id"), "id", "left_anti")
    pairs = nearby.nearest_by_ciede2000(rest.select("l", "a", "b").distinct(), candidates)
    best = pairs.groupBy("l", "a", "b").agg(F.min_by(F.struct("thread_id", "delta"), F.struct("delta", "ord")).alias("m"))
    how = F.when(F.col("m.delta") <= most, "nearest").when(F.col("m.delta") <= 1.5 * most, "near-miss").otherwise("none")
    near = rest.join(best, ["l", "a", "b"], "left").select("id", F.when(how != "none", F.col("m.thread_id")).alias("thread_id"), F.col("m.delta").alias("delta"), how.alias("how"))
    return charted.unionByName(near)


def in_stock_first(sources: DataFrame, candidates: DataFrame, most: float = 10.0) -> DataFrame:
    """The nearest candidate in reach with enough in stock, else the nearest in reach; sources have needed, candidates owned."""
    near = nearby.within_ciede2000(sources, candidates, F.lit(float(most)))
    pairs = near.withColumn("delta", c.ciede2000(lab(""), lab("c_"))).where(F.col("delta") <= most).withColumn("enough", F.col("owned") >= F.col("needed"))
    best = pairs.groupBy("id").agg(F.min_by(F.struct("thread_id", "delta", "enough"), F.struct((~F.col("enough")).alias("x"), "delta", "ord")).alias("m"), F.count(F.lit(1)).alias("n_in_reach"))
    return best.select("id", "m.thread_id", "m.delta", "m.enough", "n_in_reach")


def with_locked(proposed: DataFrame, previous: DataFrame) -> DataFrame:
    """New proposals, but the previous one where it is locked."""
    before = previous.where("locked").select("id", F.col("thread_id").alias("kept_id"))
    return proposed.join(before, "id", "left").select("id", F.coalesce("kept_id", "thread_id").alias("thread_id"), F.col("kept_id").isNotNull().alias("locked"))


def remap(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """cells with thread_id replaced where mapping (old_id, new_id) has it; each part of a blend by itself."""
    parts = cells.select("project_id", "idx", F.posexplode(F.split("thread_id", r"\+")).alias("i", "old_id"))
    mapped = parts.join(mapping, "old_id", "left").groupBy("project_id", "idx").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("new_id", "old_id").alias("t")))).alias("p"))
    return mapped.select("project_id", "idx", F.array_join(F.transform("p", lambda x: x["t"]), "+").alias("thread_id"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with i, their number in this order over the whole table, from 0: ranges are numbered each by itself, and the counts of the ranges before are added."""
    dealt = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = settled(dealt.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1), "ranges")
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.range") < F.col("a.range"), "left").groupBy(F.col("a.range").alias("range")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return dealt.join(F.broadcast(before), "range").withColumn("i", F.col("at") + F.col("before")).drop("range", "at", "before")  # a row for each range


def by_lightness(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The i-th darkest source with the i-th darkest target, from the first again when these run out."""
    s = ranked(sources.select("thread_id", "c_l", "ord"), "c_l", "ord")
    t = ranked(targets.select(F.col("thread_id").alias("target_id"), "c_l", "ord"), "c_l", "ord").select("target_id", F.col("i").alias("j"))
    n = targets.agg(F.count(F.lit(1)).alias("n"))
    return s.crossJoin(F.broadcast(n)).withColumn("j", F.col("i") % F.col("n")).join(t, "j").select("thread_id", "target_id")  # one row is broadcast


def counts(cells: DataFrame) -> DataFrame:
    return cells.where(~F.col("thread_id").isin("__skip__", "__empty__")).groupBy("project_id", "thread_id").agg(F.count(F.lit(1)).alias("n"))


def _nearest_kept(losers: DataFrame, kept: DataFrame, colours: DataFrame) -> DataFrame:
    """Each losing id of a chart with the nearest kept one: project_id, thread_id, new_id. colours: thread_id, ord, c_*."""
    a = losers.join(colours, "thread_id").select("project_id", "thread_id", *(F.col(f"c_{x}").alias(f"x_{x}") for x in ("l", "a", "b")))
    b = kept.join(colours, "thread_id").select("project_id", F.col("thread_id").alias("new_id"), "ord", "c_l", "c_a", "c_b")
    d = c.delta_e2(lab("x_"), lab("c_"))
    return a.join(b, "project_id").groupBy("project_id", "thread_id").agg(F.min_by("new_id", F.struct(d, "ord")).alias("new_id"))


def capped(cells: DataFrame, colours: DataFrame, most: int) -> DataFrame:
    """Counts after only the most used ids stay and each other goes to the nearest of them."""
    n = counts(cells)
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "thread_id"))
    ranked = n.withColumn("rank", rank)
    moves = _nearest_kept(ranked.where(F.col("rank") > most), ranked.where(F.col("rank") <= most), colours)
    moved = n.join(moves, ["project_id", "thread_id"], "left").select("project_id", F.coalesce("new_id", "thread_id").alias("thread_id"), "n")
    return moved.groupBy("project_id", "thread_id").agg(F.sum("n").alias("n"))


def without_rare(cells: DataFrame, colours: DataFrame, least: int, passes: int = 3) -> DataFrame:
    """Counts after ids under least cells go to the nearest other id, in at most so many passes."""
    n = counts(cells)
    for _ in range(passes):
        moves = _nearest_kept(n.where(F.col("n") < least), n.where(F.col("n") >= least), colours)
        n = n.join(moves, ["project_id", "thread_id"], "left").select("project_id", F.coalesce("new_id", "thread_id").alias("thread_id"), "n").groupBy("project_id", "thread_id").agg(F.sum("n").alias("n"))
    return n


def worst_status(cells: DataFrame, stock: DataFrame) -> DataFrame:
    """The status of each id of a chart is that of its worst thread: owned, low or missing. stock: thread, owned."""
    parts = counts(cells).select("project_id", "thread_id", F.explode(F.split("thread_id", r"\+")).alias("thread"))
    owned = F.coalesce("owned", F.lit(0))
    severity = F.when(owned <= 0, 2).when(owned <= 2, 1).otherwise(0)
    worst = parts.join(stock, "thread", "left").groupBy("project_id", "thread_id").agg(F.max(severity).alias("s"))
    return worst.select("project_id", "thread_id", F.element_at(F.array(F.lit("owned"), F.lit("low"), F.lit("missing")), F.col("s") + 1).alias("status"))


def with_zero_rows(now: DataFrame, before: DataFrame) -> DataFrame:
    """Counts now, with 0 for ids that were there before and are gone."""
    gone = before.join(now.select("project_id", "thread_id"), ["project_id", "thread_id"], "left_anti").select("project_id", "thread_id", F.lit(0).cast("long").alias("n"))
    return now.select("project_id", "thread_id", "n").unionByName(gone)


#: Upper hue bounds of the buckets of the gap report; from the last on it is red again.
BUCKETS = ((30, "Red"), (60, "Orange"), (90, "Yellow"), (170, "Green"), (200, "Cyan"), (260, "Blue"), (330, "Purple"), (361, "Red"))
#: Colours of less saturation are grey; those darker or lighter have no hue to speak of.
LEAST_SATURATION, DARK, LIGHT = 0.12, 0.08, 0.92


def hue_bucket(r: Column, g: Column, b: Column, any_lightness: bool = False) -> Column:
    """The bucket of a colour; null for grey ones and, unless any will do, for very dark and very light ones."""
    h, s, light = c.hsl(r, g, b)
    out = F.when(h < BUCKETS[0][0], BUCKETS[0][1])
    for upper, name in BUCKETS[1:]:
        out = out.when(h < upper, name)
    told = s >= LEAST_SATURATION
    return F.when(told if any_lightness else told & light.between(DARK, LIGHT), out)


def hue_gaps(wanted: DataFrame, stock: DataFrame) -> DataFrame:
    """Hues that take much of what is wanted (r, g, b, n) and little of the stock (r, g, b)."""
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    told = wanted.select(hue_bucket(*rgb).alias("hue"), "n").where("hue is not null")
    total = told.agg(F.sum("n").alias("all"))
    share = told.groupBy("hue").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select("hue", (F.col("n") / F.col("all")).alias("share"))  # one row is broadcast
    have = stock.groupBy(hue_bucket(*rgb, any_lightness=True).alias("hue")).agg(F.count(F.lit(1)).alias("n_threads"))
    j = share.join(have, "hue", "left").fillna(0, ["n_threads"])
    gap = F.when((F.col("share") > 0.15) & (F.col("n_threads") == 0), "high").when((F.col("share") > 0.08) & (F.col("n_threads") <= 1), "medium").otherwise("none")
    return j.withColumn("gap", gap)


def finished_sizes(charts: DataFrame, fabrics: tuple[int, ...] = (11, 14, 16, 18, 20, 22, 25, 28, 32)) -> DataFrame:
    """Width and height in inches and centimetres on each fabric; a count of 28 is worked as 14."""
    f = charts.withColumn("fabric", F.explode(F.array(*map(F.lit, fabrics))))
    per_inch = F.when(F.col("fabric") == 28, 14).otherwise(F.col("fabric"))
    inch = lambda n: F.floor(F.col(n) / per_inch * 10 + 0.5) / 10
    return f.select("project_id", "fabric", inch("w").alias("w_in"), inch("h").alias("h_in"), (F.floor(F.col("w") / per_inch * 2.54 * 10 + 0.5) / 10).alias("w_cm"), (F.floor(F.col("h") / per_inch * 2.54 * 10 + 0.5) / 10).alias("h_cm"))


#: Weights of the five factors of difficulty; steps of a factor as (up to, base, from, slope).
WEIGHTS = {"colour": 0.25, "confetti": 0.28, "changes": 0.17, "size": 0.15, "technique": 0.15}
PALETTE_STEPS = ((5, 0.05, 0, 0.0), (15, 0.05, 5, 0.027), (30, 0.32, 15, 0.022), (50, 0.65, 30, 0.012), (None, 0.89, 50, 0.006))
FABRIC_STEPS = ((14, 0.0, 0, 0.0), (18, 0.0, 14, 0.04), (22, 0.16, 18, 0.06), (None, 0.4, 22, 0.03))
BACKSTITCH_STEPS = ((0, 0.0, 0, 0.0), (10, 0.0, 0, 0.02), (50, 0.2, 10, 0.012), (None, 0.68, 50, 0.004))
#: Of the logarithm to 10 of the size.
SIZE_STEPS = ((3.0, 0.02, 0, 0.0), (math.log10(5000), 0.02, 3.0, 0.12), (math.log10(20000), 0.1, math.log10(5000), 0.35), (math.log10(80000), 0.35, math.log10(20000), 0.45), (None, 0.75, math.log10(80000), 0.4))


def stepped(x: Column, steps) -> Column:
    """Piecewise linear in x."""
    out = None
    for upper, base, start, slope in steps:
        value = F.lit(base) + (x - start) * slope
        out = F.when(x <= upper, value) if out is None else out.otherwise(value) if upper is None else out.when(x <= upper, value)
    return out


def difficulty(metrics: DataFrame) -> DataFrame:
    """A score from 0 to 100 and its tier. metrics: n_threads, n_blends, total, fabric, n_backstitches, isolation, change_rate."""
    one = F.lit(1.0)
    c = {name: F.col(name) for name in ("n_threads", "n_blends", "total", "fabric", "n_backstitches", "isolation", "change_rate")}
    blends = F.when(c["n_blends"] <= 0, 0.0).when(c["n_blends"] <= 3, 0.08).when(c["n_blends"] <= 8, 0.15).otherwise(0.22)
    precise = F.when(c["fabric"] >= 25, 0.2).when(c["fabric"] >= 20, 0.1).otherwise(0.0)
    size = F.least(one, stepped(F.log10(F.greatest(c["total"], F.lit(1)).cast("double")), SIZE_STEPS))
    factors = {
        "colour": F.least(one, F.least(one, stepped(c["n_threads"], PALETTE_STEPS)) * 0.78 + blends * 0.22),
        "confetti": F.least(one, F.greatest(F.lit(0.0), c["isolation"])),
        "changes": F.least(one, F.greatest(F.lit(0.0), c["change_rate"])),
        "size": F.least(one, size * 0.8 + F.least(F.lit(0.5), stepped(c["fabric"], FABRIC_STEPS)) * 0.2),
        "technique": F.least(one, F.least(one, stepped(c["n_backstitches"], BACKSTITCH_STEPS)) * 0.7 + precise * 0.3),
    }
    mixed = sum((weight * factors[name] for name, weight in WEIGHTS.items()), F.lit(0.0))
    # Very scattered charts are never easy.
    mixed = F.when((factors["confetti"] > 0.7) & (mixed < 0.3), 0.3).otherwise(mixed)
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(mixed * 100 + 0.5))).cast("long")
    tier = F.when(score <= 25, "Beginner").when(score <= 50, "Intermediate").when(score <= 75, "Advanced").otherwise("Expert")
    return metrics.select("project_id", score.alias("score"), tier.alias("tier"))
