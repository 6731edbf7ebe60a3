import math
import random

import pytest

from tessella.operators import harmony as op

SCHEMA = "project_id long, ord int, r int, g int, b int"
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(rgb):
    lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in rgb]
    roots = [math.cbrt(sum(m * v for m, v in zip(row, lin, strict=True))) for row in LMS]
    return [sum(m * v for m, v in zip(row, roots, strict=True)) for row in LAB]


def to_rgb(lab):
    light, a, b = lab
    cubes = [(light + 0.3963377774 * a + 0.2158037573 * b) ** 3, (light - 0.1055613458 * a - 0.0638541728 * b) ** 3, (light - 0.0894841775 * a - 1.2914855480 * b) ** 3]
    rows = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
    out = []
    for row in rows:
        v = sum(m * x for m, x in zip(row, cubes, strict=True))
        v = 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055
        out.append(max(0, min(255, math.floor(v * 255 + 0.5))))
    return tuple(out)


def loop_expanded(colours, count):
    if count <= len(colours):
        return colours[:count]
    out = sorted(colours, key=lambda x: oklab(x)[0])
    while len(out) < count and len(out) > 1:
        gaps = [math.dist(oklab(p), oklab(q)) for p, q in zip(out, out[1:], strict=False)]
        i = gaps.index(max(gaps))
        out.insert(i + 1, to_rgb([(x + y) / 2 for x, y in zip(oklab(out[i]), oklab(out[i + 1]), strict=True)]))
    return out if len(out) >= count else out * count


def loop_reduced(colours, count):
    chosen = [0]
    while len(chosen) < min(count, len(colours)):
        rest = [i for i in range(len(colours)) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (min(math.dist(oklab(colours[i]), oklab(colours[j])) for j in chosen), -i)))
    return sorted(chosen) if count > 0 else []


@pytest.fixture(scope="module")
def palettes(spark):
    rng = random.Random(1)
    made = {p: [tuple(rng.randrange(256) for _ in range(3)) for _ in range(n)] for p, n in enumerate((1, 2, 3, 7, 12, 20))}
    made[6] = [(10, 10, 10)] * 3 + [(200, 0, 0)]
    return made, spark.createDataFrame([(p, i, *x) for p, v in made.items() for i, x in enumerate(v)], SCHEMA)


@pytest.mark.parametrize("count", [1, 4, 15])
def test_expanded_like_a_loop(palettes, count):
    made, df = palettes
    got = {}
    for r in op.expanded(df, count).orderBy("project_id", "place").collect():
        got.setdefault(r.project_id, []).append((r.r, r.g, r.b))
    assert got == {p: loop_expanded(v, count) for p, v in made.items()}


@pytest.mark.parametrize("count", [0, 1, 3, 12, 50])
def test_reduced_like_a_loop(palettes, count):
    made, df = palettes
    got = {p: [] for p in made}
    for r in op.reduced(df, count).orderBy("project_id", "ord").collect():
        got[r.project_id].append(r.ord)
    assert got == {p: loop_reduced(v, count) for p, v in made.items()}


def test_turning(palettes):
    made, df = palettes
    same = {(r.project_id, r.ord): (r.r, r.g, r.b) for r in op.turned(df, 360).collect()}
    assert same == {(p, i): x for p, v in made.items() for i, x in enumerate(v)}
    greys = df.where("r = g and g = b")
    assert op.turned(greys, 77).collect() == greys.collect()


@pytest.mark.parametrize("kind", op.HARMONIES)
def test_harmony(spark, kind):
    base = spark.createDataFrame([(1, 180, 60, 90), (2, 128, 128, 128)], "id long, r int, g int, b int")
    m = 1 + len(op.HARMONIES[kind])
    got = {(r.id, r.place): (r.r, r.g, r.b) for r in op.harmony(base, kind, 9).collect()}
    assert sorted(got) == [(i, k) for i in (1, 2) for k in range(9)]
    assert got[1, 0] == (180, 60, 90)
    light = lambda k: oklab(got[1, k])[0]
    assert all(light(m + 2 * i) > light(i % m) > light(m + 2 * i + 1) for i in range((9 - m) // 2 - 1) if i < m)
    assert {(r.id, r.place) for r in op.harmony(base, kind).collect()} == {(i, k) for i in (1, 2) for k in range(m)}
    assert all(got[2, k] == (128, 128, 128) for k in range(m))


def test_locked_entries_and_collisions(spark):
    palette = spark.createDataFrame([(1, 0, 200, 30, 30, "keep", True), (1, 1, 200, 30, 30, None, False), (1, 2, 201, 30, 30, None, False), (1, 3, 20, 20, 200, None, False)], SCHEMA + ", thread_id string, locked boolean")
    catalogue = spark.createDataFrame([("green", 0, 60.0, -50.0, 45.0), ("red", 1, 45.0, 65.0, 45.0), ("blue", 2, 30.0, 30.0, -80.0)], "thread_id string, ord int, c_l double, c_a double, c_b double")
    got = {r.ord: (r.thread_id, r.locked) for r in op.turned_onto(palette, catalogue, 120).collect()}
    assert got[0] == ("keep", True)
    assert got[1] == got[2] == ("green", False)
    assert [tuple(r) for r in op.collisions(op.turned_onto(palette, catalogue, 120)).collect()] == [(1, "green", 2)]
