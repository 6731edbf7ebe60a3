import math

import pytest

from tessella.operators import contours as op
from tessella.operators import grid

CELLS = "project_id long, idx long, x long, y long, thread_id string, done int"
PICTURES = ("###\n#.#\n###", "#..\n.#.\n..#", "####\n#..#\n#.##\n###.", "#", "..\n..", "#.#.#\n#####\n.#.#.")


@pytest.fixture(scope="module")
def charts(spark):
    rows = [(p, y * 9 + x, x, y, "a" if c == "#" else "b", 0) for p, text in enumerate(PICTURES) for y, line in enumerate(text.split("\n")) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, CELLS)


@pytest.fixture(scope="module")
def rings(charts):
    out = {}
    for r in op.rings(charts, "a").orderBy("project_id", "ring", "pos").collect():
        out.setdefault((r.project_id, r.ring), []).append((r.pos, r.x, r.y))
    return out


def area(points):
    return sum(x * y2 - x2 * y for (x, y), (x2, y2) in zip(points, points[1:] + points[:1], strict=True)) / 2


def test_rings_are_closed_ordered_and_whole(charts, rings):
    edges = charts.sparkSession.createDataFrame(op.directed(grid.outline(charts, "a")).collect())
    n_edges = {r["project_id"]: r["n"] for r in edges.groupBy("project_id").count().withColumnRenamed("count", "n").collect()}
    for (p, _), points in rings.items():
        assert [pos for pos, *_ in points] == list(range(len(points)))
        xy = [q[1:] for q in points]
        assert all(abs(x - x2) + abs(y - y2) == 1 for (x, y), (x2, y2) in zip(xy, xy[1:] + xy[:1], strict=True))
        n_edges[p] -= len(points)
    assert set(n_edges.values()) == {0}


def test_regions_and_holes(rings):
    """Rings around regions have a positive area, holes a negative one; together they give the number of cells."""
    areas = {}
    for (p, _), points in rings.items():
        areas.setdefault(p, []).append(area([q[1:] for q in points]))
    assert sorted(areas[0]) == [-1, 9]
    assert areas[1] == [1, 1, 1]  # cells that touch in corners are regions of their own
    assert areas[3] == [1] and 4 not in areas
    assert {p: sum(v) for p, v in areas.items()} == {p: t.count("#") for p, t in enumerate(PICTURES) if "#" in t}


def test_corners_are_where_rings_turn(charts):
    got = {}
    for r in op.corners(op.rings(charts, "a")).orderBy("project_id", "ring", "pos").collect():
        got.setdefault((r.project_id, r.ring), []).append((r.x, r.y))
    assert sorted(len(v) for (p, _), v in got.items() if p == 0) == [4, 4]
    assert sorted(next(v for (p, _), v in got.items() if p == 3)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert {p: sum(area(v) for (q, _), v in got.items() if q == p) for p in (0, 2, 5)} == {p: PICTURES[p].count("#") for p in (0, 2, 5)}


def test_curves_like_a_loop(spark):
    points = [(0.0, 0.0), (4.0, 0.0), (5.0, 3.0), (2.0, 6.0), (-1.0, 2.0)]
    df = spark.createDataFrame([(1, 7, i, *p) for i, p in enumerate(points)] + [(1, 8, i, float(i), 0.0) for i in range(3)], "project_id long, ring long, pos long, x double, y double")
    got = {(r.ring, r.pos): (r.x, r.y) for r in op.smoothed(df, 3).collect()}
    n = len(points)
    for i in range(n):
        p, q, r, t = (points[(i + k) % n] for k in (-1, 0, 1, 2))
        for s in range(3):
            f = s / 3
            want = [0.5 * (2 * q[k] + (r[k] - p[k]) * f + (2 * p[k] - 5 * q[k] + 4 * r[k] - t[k]) * f**2 + (3 * q[k] - p[k] - 3 * r[k] + t[k]) * f**3) for k in (0, 1)]
            assert math.dist(got[7, 3 * i + s], want) < 1e-12
    assert [got[8, i] for i in range(3)] == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]


def test_thinned_keeps_far_points(spark):
    df = spark.createDataFrame([(1, 1, i, float(x), 0.0) for i, x in enumerate((0, 1, 2, 2.5, 5, 5.5, 9))], "project_id long, ring long, pos long, x double, y double")
    assert sorted(r.x for r in op.thinned(df, 1.9).collect()) == [0, 2, 5, 9]
    assert op.thinned(df, 0).count() == 7


def test_a_long_ring(spark):
    """A comb, whose one ring has over two hundred edges."""
    rows = [(1, y * 99 + x, x, y, "a", 0) for x in range(40) for y in range(5) if y == 0 or x % 2 == 0]
    got = op.rings(spark.createDataFrame(rows, CELLS), "a").collect()
    assert len({r.ring for r in got}) == 1
    assert sorted(r.pos for r in got) == list(range(len(got))) and len(got) > 200
