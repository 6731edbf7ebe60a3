"""Selections of cells and edits inside them: masks are tables of project_id, idx."""

from __future__ import annotations


import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import colour as c
from tessella.functions.skeins import skeins_estimate
from tessella.operators import grid
from tessella.operators.colour import lab
from tessella.operators.image import NINE, PLACES, around, full

KEY = ["project_id", "idx"]


def masked(old: DataFrame, new: DataFrame, how: str) -> DataFrame:
    """The mask after a new one is added, subtracted, intersected, or put in its place."""
    if how == "add":
        return old.select(KEY).union(new.select(KEY)).distinct()
    if how == "subtract":
        return old.select(KEY).join(new, KEY, "left_anti")
    if how == "intersect":
        return old.select(KEY).join(new, KEY, "left_semi")
    return new.select(KEY).distinct()


def everything(cells: DataFrame) -> DataFrame:
    return grid.stitchable(cells).select(KEY)


def inverted(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """The stitchable cells outside the mask."""
    return everything(cells).join(mask, KEY, "left_anti")


def coloured(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """Stitchable cells with c_l, c_a, c_b of their id; colours: thread_id, ord, c_*."""
    return grid.stitchable(cells).join(colours.select("thread_id", "c_l", "c_a", "c_b"), "thread_id")


def near_seed(cells: DataFrame, colours: DataFrame, seeds: DataFrame, tolerance: float) -> DataFrame:
    """All cells of a chart within a Lab distance of the seed's colour; seeds: project_id, idx. At tolerance 0 the seed's id alone."""
    at = coloured(cells, colours)
    seed = at.join(seeds.select(KEY), KEY, "left_semi").select("project_id", F.col("thread_id").alias("seed_id"), *(F.col(f"c_{x}").alias(f"s_{x}") for x in ("l", "a", "b")))
    j = at.join(seed, "project_id")
    if tolerance <= 0:
        return j.where("thread_id = seed_id").select("project_id", "idx", "x", "y")
    return j.where(F.sqrt(c.delta_e2(lab("s_"), lab("c_"))) <= tolerance).select("project_id", "idx", "x", "y")


def flooded(cells: DataFrame, colours: DataFrame, seeds: DataFrame, tolerance: float) -> DataFrame:
    """Of the cells near the seed's colour those that steps on four sides reach from the seed."""
    near = near_seed(cells, colours, seeds, tolerance)
    labels = grid.components(near.withColumns({"thread_id": F.lit("near"), "done": F.lit(0)}))
    hit = labels.join(seeds.select(KEY), KEY, "left_semi").select("project_id", "label")
    return labels.join(hit, ["project_id", "label"], "left_semi").select(KEY)


def statistics(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Ids inside the mask with their cells, share of it and skeins."""
    n = grid.stitchable(cells).join(mask, KEY, "left_semi").groupBy("project_id", "thread_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("project_id").agg(F.sum("n").alias("all"))
    return n.join(total, "project_id").select("project_id", "thread_id", "n", (F.col("n") / F.col("all")).alias("share"), skeins_estimate(F.col("n")).alias("skeins"))


def small_clusters(cells: DataFrame, mask: DataFrame, least: int) -> DataFrame:
    """Cells of the mask in clusters of like cells, inside it, of fewer than least."""
    inside = grid.stitchable(cells).join(mask.hint("merge"), KEY, "left_semi")
    size = F.count(F.lit(1)).over(Window.partitionBy("project_id", "label"))
    return grid.components(inside).withColumn("n", size).where(F.col("n") < least).select(KEY)


def tidied(cells: DataFrame, mask: DataFrame, least: int) -> DataFrame:
    """Changes that give every cell of a small cluster the commonest id on its four sides, the least of equal ones: project_id, idx, old_id, new_id."""
    flagged = small_clusters(cells, mask, least)
    flags = flagged.select("project_id", "idx", F.lit(True).alias("flagged"))
    # Flags come to their cells as rows, so that cells move once and their neighbours are a stencil.
    rows = grid.stitchable(cells).select("project_id", "idx", "x", "y", "thread_id").unionByName(flags, allowMissingColumns=True).repartition("project_id")
    own = rows.groupBy(F.col("project_id").alias("image_id"), "idx").agg(*(F.max(c).alias(c) for c in ("x", "y", "thread_id", "flagged"))).where("x is not null")
    near = around(full(own), "thread_id", held=False).where("flagged")
    ids = F.array_compact(F.array(*(F.col(f"{at}.thread_id") for at, (dx, dy) in zip(NINE, PLACES, strict=True) if (dx, dy) in grid.FOUR)))
    votes = F.transform(F.array_distinct(ids), lambda t: F.struct((-F.size(F.filter(ids, lambda v: v == t))).alias("n"), t.alias("id")))
    best = near.select(F.col("image_id").alias("project_id"), "idx", F.col("thread_id").alias("old_id"), F.array_min(votes)["id"].alias("new_id"))
    return best.where("old_id <> new_id")


def changed(before: DataFrame, after: DataFrame, n: int = 4) -> DataFrame:
    """How many cells of each chart differ, and the n ids that lost most."""
    j = before.select("project_id", "idx", "thread_id").join(after.select("project_id", "idx", F.col("thread_id").alias("new_id")), KEY).where("thread_id <> new_id")
    per = j.groupBy("project_id", "thread_id").agg(F.count(F.lit(1)).alias("n"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "thread_id"))), 1, n)
    return per.groupBy("project_id").agg(F.sum("n").alias("n_changed"), F.array_join(F.transform(listed, lambda x: x["thread_id"]), ",").alias("top"))


def edge_strength(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """The greatest Lab distance of a cell's colour to those on its four sides; 0 without any."""
    at = coloured(cells, colours)
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in grid.FOUR)))
    asking = at.withColumn("s", steps).select(*KEY, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), *(F.col(f"c_{k}").alias(f"a_{k}") for k in ("l", "a", "b")))
    met = asking.join(at.select("project_id", "x", "y", "c_l", "c_a", "c_b"), ["project_id", "x", "y"])
    strong = met.groupBy(KEY).agg(F.max(F.sqrt(c.delta_e2(lab("a_"), lab("c_")))).alias("strength"))
    return at.select(KEY).join(strong, KEY, "left").select(*KEY, F.coalesce("strength", F.lit(0.0)).alias("strength"))


def collisions(proposals: DataFrame) -> DataFrame:
    """Destinations that several sources of a chart go to: project_id, src_id, dst_id."""
    return proposals.groupBy("project_id", "dst_id").agg(F.count_distinct("src_id").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("src_id")), ",").alias("sources")).where("n_sources > 1")


def substituted(cells: DataFrame, proposals: DataFrame) -> DataFrame:
    """cells with every thread of an id replaced where a chart's proposal has it, blends in canonical order, and all progress cleared."""
    part = cells.select("project_id", "idx", "x", "y", F.posexplode(F.split("thread_id", r"\+")).alias("i", "src_id"))
    mapped = part.join(proposals, ["project_id", "src_id"], "left").groupBy("project_id", "idx", "x", "y").agg(F.array_sort(F.collect_list(F.coalesce("dst_id", "src_id"))).alias("ids"))
    return mapped.select("project_id", "idx", "x", "y", F.array_join("ids", "+").alias("thread_id"), F.lit(0).alias("done"))


def reduced(cells: DataFrame, colours: DataFrame, target: int) -> DataFrame:
    """project_id, thread_id, new_id after the closest pairs of a chart's ids are merged, the rarer into the commoner, until target ids are left.

    A chart's palette, not its cells, comes to one task: a row for each id.
    """
    n = grid.stitchable(cells).groupBy("project_id", "thread_id").agg(F.count(F.lit(1)).alias("n")).join(colours, "thread_id")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "ord"], ascending=[False, True], ignore_index=True)
        ids, count, at = pdf["thread_id"].tolist(), pdf["n"].tolist(), pdf[["c_l", "c_a", "c_b"]].to_numpy()
        goes = list(range(len(ids)))
        alive = list(range(len(ids)))
        while len(alive) > target:
            points = at[alive]
            d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
            d[np.tril_indices(len(alive))] = np.inf
            i, j = np.unravel_index(d.argmin(), d.shape)
            keep, lose = (alive[i], alive[j]) if count[alive[i]] > count[alive[j]] else (alive[j], alive[i])
            count[keep] += count[lose]
            goes = [keep if g == lose else g for g in goes]
            alive.remove(lose)
        return pd.DataFrame({"project_id": pdf["project_id"], "thread_id": ids, "new_id": [ids[g] for g in goes]})

    return n.groupBy("project_id").applyInPandas(one, "project_id long, thread_id string, new_id string")


def neighbours(x: np.ndarray, y: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """Of every place, each once, the numbers of those on its four and on its eight sides."""
    x, y = x - x.min() + 1, y - y.min() + 1
    wide = int(x.max()) + 2
    code = y * wide + x
    order = np.argsort(code)
    there = code[order]
    found = []
    for steps in (grid.FOUR, grid.EIGHT):
        wanted = code[:, None] + np.array([dy * wide + dx for dx, dy in steps])
        slot = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
        hit = there[slot] == wanted
        ends = np.cumsum(hit.sum(axis=1)).tolist()
        flat = order[slot[hit]].tolist()
        found.append([flat[i:j] for i, j in zip([0, *ends], ends)])
    return found[0], found[1]


def without_orphans(cells: DataFrame, colours: DataFrame, most: int, tie: float = 1.0, flat: float = 2.0) -> DataFrame:
    """cells of charts after clusters of at most so many cells took the id around them, on eight sides, that is nearest in colour; of ids within a tie of the nearest the commonest.

    A column saliency (0 to 1) lets clusters in flat parts be larger, up to 1 +
    flat times; a cluster with an edge cell (column edge) stays. Clusters are
    taken in the order of their first cell, and a later one sees what became
    of those before it, so a chart is worked by one task; charts are dealt
    over the cluster. project_id, idx, thread_id come back.
    """
    weighed, edged = "saliency" in cells.columns, "edge" in cells.columns
    flags = [k for k, given in (("saliency", weighed), ("edge", edged)) if given]
    at = cells.join(colours.select("thread_id", "c_l", "c_a", "c_b"), "thread_id", "left").select("project_id", "idx", "x", "y", "thread_id", "c_l", "c_a", "c_b", *flags)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf["idx"].to_numpy(), kind="stable")]
        first = pdf["thread_id"].tolist()
        saliency = pdf["saliency"].to_numpy() if weighed else None
        edge = pdf["edge"].to_numpy() if edged else None
        four, eight = neighbours(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        lab_of = dict(zip(first, zip(*(pdf[f"c_{k}"].tolist() for k in ("l", "a", "b")), strict=True), strict=True))
        apart: dict[tuple[str, str], float] = {}
        ids, seen = list(first), [t in grid.SENTINELS for t in first]
        for begin, own in enumerate(first):
            if seen[begin]:
                continue
            cluster = [begin]
            seen[begin] = True
            for i in cluster:  # grows while it is read
                for k in four[i]:
                    if not seen[k] and first[k] == own:
                        seen[k] = True
                        cluster.append(k)
            if len(cluster) > (most * (1 + (1 - saliency[cluster].mean()) * flat) if weighed else most) or edged and edge[cluster].any():
                continue
            border: dict[str, int] = {}
            for i in cluster:
                for k in eight[i]:
                    t = ids[k]
                    if t != own and t not in grid.SENTINELS:
                        border[t] = border.get(t, 0) + 1
            if border:
                distance = {}
                for t in border:
                    if (own, t) not in apart:
                        apart[own, t] = math.dist(lab_of[own], lab_of[t])
                    distance[t] = apart[own, t]
                near = min(distance.values()) + tie
                new = min((t for t in border if distance[t] <= near), key=lambda t: (-border[t], distance[t], t))
                for i in cluster:
                    ids[i] = new
        return pd.DataFrame({"project_id": pdf["project_id"], "idx": pdf["idx"], "thread_id": pd.Series(ids, index=pdf.index, dtype=object)})

    return at.groupBy("project_id").applyInPandas(one, "project_id long, idx long, thread_id string")
