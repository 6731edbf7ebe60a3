"""Closed rings around regions of a chart, in order, and their simpler and smoother forms.

A ring is a cycle of cell edges. Edges find their successor by a join on the
corner where they end, and their ring and place on it by pointer doubling: every
round doubles the stretch that an edge knows, for all rings of all charts
together, so rounds grow with the logarithm of the longest ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import grid
from tessella.plans.rounds import AT_ONCE, GROUP_LINKS, forget, settled

#: Where the edge of a direction (0 above, 1 right, 2 below, 3 left of its cell) starts and ends, clockwise.
STARTS = ((0, 0), (1, 0), (1, 1), (0, 1))


def _corner(table: tuple[tuple[int, int], ...], axis: int, direction: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p[axis]) for p in table)), direction + 1)


def directed(edges: DataFrame) -> DataFrame:
    """edges (project_id, x, y, dir) with edge, a number, and the corners x0, y0 and x1, y1 between which they run, the region on their right."""
    ends = STARTS[1:] + STARTS[:1]
    number = F.shiftleft(F.col("y").cast("long"), 32) + F.shiftleft(F.col("x").cast("long"), 2) + F.col("dir")
    return edges.select("project_id", number.alias("edge"), "dir", *((F.col(v) + _corner(t, k, F.col("dir"))).cast("long").alias(f"{v}{i}") for i, t in enumerate((STARTS, ends)) for k, v in enumerate("xy")))


def successors(edges: DataFrame) -> DataFrame:
    """project_id, edge, next: where two edges go on from a corner, the one of the same cell is next, so cells that touch in a corner only have rings of their own. edges: as directed() gives them."""
    # Every edge answers at the corner where it starts and asks at the one where it ends; dealt by chart, edges stay where they are.
    both = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.struct("dir", "edge").alias("out"), F.lit(None).alias("row")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(None).alias("out"), F.struct("dir", "edge").alias("row")))
    met = edges.select("project_id", F.explode(both).alias("b")).select("project_id", "b.*")
    met = met.withColumn("outs", F.collect_list("out").over(Window.partitionBy("project_id", "x", "y"))).where("row is not null and size(outs) > 0")
    # A turn to the right first, then straight on, then to the left.
    turns = F.transform("outs", lambda o: F.struct(F.pmod(F.col("row.dir") + 1 - o["dir"], F.lit(4)).alias("turn"), o["edge"].alias("edge")))
    return met.select("project_id", F.col("row.edge").alias("edge"), F.array_min(turns)["edge"].alias("next"))


def _ahead(rows: DataFrame, *columns: str) -> DataFrame:
    """rows (project_id, edge, to and others) with there: the columns of the row whose edge is to, for rows of one chart each edge once."""
    own = [c for c in rows.columns if c != "project_id"]
    # Every row asks at its to and answers at its edge, so rows that are dealt by chart stay where they are.
    both = F.array(F.struct(F.col("edge").alias("at"), F.struct(*columns).alias("said"), F.lit(None).alias("row")), F.struct(F.col("to").alias("at"), F.lit(None).alias("said"), F.struct(*own).alias("row")))
    met = rows.select("project_id", F.explode(both).alias("b")).select("project_id", "b.*")
    met = met.withColumn("there", F.max("said").over(Window.partitionBy("project_id", "at")))
    return met.where("row is not null").select("project_id", "row.*", "there")


def ordered(links: DataFrame) -> DataFrame:
    """project_id, edge, ring (its least edge) and pos (steps from that one) for links (project_id, edge, next) that form cycles.

    Reaches double AT_ONCE times between writes; links that are dealt by chart
    move once for all of these, and with a chart of more than GROUP_LINKS links
    they are dealt by edge.
    """
    links = settled(links, "links")
    largest = links.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    dealt = lambda df: df.repartition("project_id") if largest <= GROUP_LINKS else df
    known, last = links.select("project_id", "edge", F.col("next").alias("to"), F.least("edge", "next").alias("ring")), None
    while True:
        after = dealt(known).withColumn("moved", F.lit(False))
        for _ in range(AT_ONCE):
            less = F.col("there.ring") < F.col("ring")
            after = _ahead(after, "to", "ring").select("project_id", "edge", F.col("there.to").alias("to"), F.least("ring", "there.ring").alias("ring"), less.alias("moved"))
        after = settled(after, "rings")
        if last is not None:
            forget(last)
        known, last = after.drop("moved"), after
        # Once a round changes nothing, each edge knows the least of as many edges as its ring has.
        if after.where("moved").isEmpty():
            break
    # Backwards to the ring's first edge, which stays where it is: links turned round, with the ring of the edge that they now start from.
    turned = dealt(links.select("project_id", "edge", "next").unionByName(known.select("project_id", "edge", "ring"), allowMissingColumns=True))
    turned = turned.groupBy("project_id", "edge").agg(F.max("next").alias("next"), F.max("ring").alias("ring"))
    first = F.col("next") == F.col("ring")
    steps = settled(turned.select("project_id", F.col("next").alias("edge"), "ring", F.when(first, F.col("next")).otherwise(F.col("edge")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("pos")), "steps")
    while not steps.where("to <> ring").isEmpty():
        after = dealt(steps)
        for _ in range(AT_ONCE):
            after = _ahead(after, "to", "pos").select("project_id", "edge", "ring", F.col("there.to").alias("to"), (F.col("pos") + F.col("there.pos")).alias("pos"))
        after = settled(after, "steps")
        forget(steps)
        steps = after
    forget(links, last)
    return steps.select("project_id", "edge", "ring", "pos")


def rings(cells: DataFrame, thread: str) -> DataFrame:
    """project_id, ring, pos, x, y: the corners of every ring around cells of the id, from its least edge on, clockwise around regions and the other way around holes."""
    edges = settled(directed(grid.outline(cells, thread)), "edges")
    rows = ordered(successors(edges.repartition("project_id"))).unionByName(edges.select("project_id", "edge", "x0", "y0"), allowMissingColumns=True).repartition("project_id")
    return rows.groupBy("project_id", "edge").agg(*(F.max(c).alias(c) for c in ("ring", "pos", "x0", "y0"))).select("project_id", "ring", "pos", F.col("x0").alias("x"), F.col("y0").alias("y"))


def _around(points: DataFrame, *offsets: int) -> DataFrame:
    """points with x and y at the places so many steps on, as x{offset} and y{offset}; rings are closed."""
    ring = Window.partitionBy("project_id", "ring")
    along = ring.orderBy("pos")
    out = points.withColumns({"n": F.count(F.lit(1)).over(ring), "i": F.row_number().over(along) - 1, "xs": F.struct("x", "y")})
    for k in offsets:
        ahead = F.lead("xs", k).over(along) if k > 0 else F.lag("xs", -k).over(along)
        # Beyond either end the ring goes on: at most three places, so the first and last three serve.
        wrapped = F.nth_value("xs", k).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if k > 0 else F.first("xs").over(ring.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        if k == 2:
            one = F.first("xs").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            wrapped = F.when(F.col("i") == F.col("n") - 2, one).otherwise(wrapped)
        out = out.withColumn(f"p{k}", F.coalesce(ahead, wrapped))
    return out.drop("xs")


def corners(points: DataFrame) -> DataFrame:
    """The points of rings (project_id, ring, pos, x, y) at which they turn, numbered anew."""
    a = _around(points, -1, 1)
    cross = (F.col("x") - F.col("p-1.x")) * (F.col("p1.y") - F.col("y")) - (F.col("y") - F.col("p-1.y")) * (F.col("p1.x") - F.col("x"))
    order = Window.partitionBy("project_id", "ring").orderBy("pos")
    return a.where(cross != 0).select("project_id", "ring", (F.row_number().over(order) - 1).cast("long").alias("pos"), "x", "y")


def smoothed(points: DataFrame, segments: int = 4) -> DataFrame:
    """Closed Catmull-Rom curves through the points of rings: segments points from each point on, the first one at the point itself. Rings of under four points stay as they are."""
    a = _around(points, -1, 1, 2)
    steps = a.where("n >= 4").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))).withColumn("f", F.col("s") / F.lit(float(segments)))
    f = F.col("f")

    def at(v: str) -> Column:
        p, q, r, t = F.col(f"p-1.{v}"), F.col(v), F.col(f"p1.{v}"), F.col(f"p2.{v}")
        return (0.5 * (2 * q + (r - p) * f + (2 * p - 5 * q + 4 * r - t) * f * f + (3 * q - p - 3 * r + t) * f * f * f)).alias(v)

    curved = steps.select("project_id", "ring", (F.col("i") * segments + F.col("s")).cast("long").alias("pos"), at("x"), at("y"))
    return curved.unionByName(a.where("n < 4").select("project_id", "ring", F.col("i").cast("long").alias("pos"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))


def thinned(points: DataFrame, tolerance: float) -> DataFrame:
    """The points of rings that lie farther than the tolerance from the one kept before, in order; the first always stays. A ring is one array, as long as a region's border."""
    listed = points.groupBy("project_id", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("ps"))

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        dx, dy = p["x"] - last["x"], p["y"] - last["y"]
        return F.when(dx * dx + dy * dy > tolerance * tolerance, F.concat(kept, F.array(p))).otherwise(kept)

    kept = F.aggregate(F.slice("ps", F.lit(2), F.size("ps")), F.slice("ps", 1, 1), step)
    return listed.select("project_id", "ring", F.explode(kept).alias("p")).select("project_id", "ring", "p.*")
