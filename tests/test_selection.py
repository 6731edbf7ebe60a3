from collections import Counter

from conftest import SF

from tessella.adapters import cells
from tessella.catalog.palette import colours
from tessella.catalog.selection import selection_reduced
from tessella.operators import grid, selection


def chart(spark, rows, **more):
    data = [(1, y * len(row) + x, x, y, t, 0) for y, row in enumerate(rows) for x, t in enumerate(row.split())]
    return spark.createDataFrame(data, "project_id long, idx long, x long, y long, thread_id string, done int")


COLOURS = [("a", 1, 10.0, 0.0, 0.0), ("b", 2, 12.0, 0.0, 0.0), ("c", 3, 90.0, 0.0, 0.0), ("d", 4, 12.5, 0.0, 0.0)]


def palette(spark):
    return spark.createDataFrame(COLOURS, "thread_id string, ord int, c_l double, c_a double, c_b double")


def grid_of(df, w):
    ids = [r.thread_id for r in df.orderBy("idx").collect()]
    return [" ".join(ids[i : i + w]) for i in range(0, len(ids), w)]


def test_orphans_take_the_nearest_colour_around(spark):
    rows = ["c c c c c", "c a b b c", "c b b b c", "c c c c c"]
    got = selection.without_orphans(chart(spark, [" ".join(r.split()) for r in rows]).drop("n"), palette(spark), 1)
    assert grid_of(got, 5) == ["c c c c c", "c b b b c", "c b b b c", "c c c c c"]


def test_later_clusters_see_earlier_edits(spark):
    # The first a becomes b; the d below it then has two b around it within a tie.
    rows = ["a b c", "d c c", "c c c"]
    got = selection.without_orphans(chart(spark, rows), palette(spark), 1)
    assert grid_of(got, 3)[0].split()[0] == "b"
    assert grid_of(got, 3)[1].split()[0] == "b"


def test_edges_and_flat_parts(spark):
    from pyspark.sql import functions as F

    rows = ["c c c c", "c a a c", "c c c c"]
    c = chart(spark, rows)
    assert grid_of(selection.without_orphans(c, palette(spark), 1), 4) == rows
    flat = selection.without_orphans(c.withColumn("saliency", F.lit(0.0)), palette(spark), 1)
    assert grid_of(flat, 4) == ["c c c c"] * 3
    kept = selection.without_orphans(c.withColumns({"saliency": F.lit(0.0), "edge": F.col("thread_id") == "a"}), palette(spark), 1)
    assert grid_of(kept, 4) == rows
    skipped = chart(spark, ["__skip__ a __skip__"])
    assert grid_of(selection.without_orphans(skipped, palette(spark), 1), 3) == ["__skip__ a __skip__"]


def test_colours_are_merged_like_a_plain_loop(spark):
    at = {r.thread_id: (r.c_l, r.c_a, r.c_b, r.ord) for r in colours(spark).collect()}
    counts = {}
    for r in grid.stitchable(cells(spark, SF)).collect():
        counts.setdefault(r.project_id, Counter())[r.thread_id] += 1
    want = set()
    for p, n in counts.items():
        ids = sorted(n, key=lambda t: (-n[t], at[t][3]))
        goes, n = {t: t for t in ids}, dict(n)
        while len(ids) > 3:
            _, i, j = min((sum((u - v) ** 2 for u, v in zip(at[a][:3], at[b][:3], strict=True)), i, j) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j)
            keep, lose = (ids[i], ids[j]) if n[ids[i]] > n[ids[j]] else (ids[j], ids[i])
            n[keep] += n.pop(lose)
            goes = {t: keep if g == lose else g for t, g in goes.items()}
            ids.remove(lose)
        want |= {(p, t, g) for t, g in goes.items()}
    assert {tuple(r) for r in selection_reduced(spark, SF).collect()} == want
