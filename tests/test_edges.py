import math
from collections import deque

import pytest

from tessella.operators import edges as op

PIXELS = "image_id long, idx long, x long, y long, r int, g int, b int"


def image(spark, *pictures):
    rows = [(i, y * w + x, x, y, *paint(x, y)) for i, (w, h, paint) in enumerate(pictures) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, PIXELS)


def grey(f):
    return lambda x, y: (f(x, y),) * 3


def loop_canny(w, h, paint, sigma=1.4, low=30, high=80):
    """The textbook loops, on one picture."""
    reach = math.ceil(3 * sigma)
    taps = [math.exp(-t * t / (2 * sigma * sigma)) for t in range(-reach, reach + 1)]
    taps = [t / sum(taps) for t in taps]
    held = lambda v, top: max(0, min(top - 1, v))
    v = {(x, y): sum(k * c for k, c in zip((0.2126, 0.7152, 0.0722), paint(x, y), strict=True)) for x in range(w) for y in range(h)}
    v = {(x, y): sum(v[held(x + t - reach, w), y] * k for t, k in enumerate(taps)) for x, y in v}
    v = {(x, y): sum(v[x, held(y + t - reach, h)] * k for t, k in enumerate(taps)) for x, y in v}
    mag, turn = {}, {}
    for x in range(1, w - 1):
        for y in range(1, h - 1):
            p = lambda dx, dy, x=x, y=y: v[x + dx, y + dy]
            gx = p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)
            gy = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
            mag[x, y], turn[x, y] = round(math.hypot(gx, gy), 6), abs(math.degrees(math.atan2(gy, gx)))
    thin = {}
    for (x, y), m in mag.items():
        a = turn[x, y]
        dx, dy = (1, 0) if a < 22.5 or a >= 157.5 else (1, -1) if a < 67.5 else (0, 1) if a < 112.5 else (1, 1)
        if m > 0 and m >= mag.get((x + dx, y + dy), 0) and m >= mag.get((x - dx, y - dy), 0):
            thin[x, y] = m
    found = {p for p, m in thin.items() if m >= high}
    todo = deque(found)
    while todo:
        x, y = todo.popleft()
        for q in [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
            if q not in found and thin.get(q, 0) >= low:
                found.add(q)
                todo.append(q)
    return found


SMOOTH = (24, 17, lambda x, y: (int(127 + 120 * math.sin(x / 3) * math.cos(y / 4)), (x * x + 3 * y) % 256, (17 * y + x) % 200))
LINE = (30, 30, grey(lambda x, y: 0 if x == 15 else 255))
THIN = (30, 30, grey(lambda x, y: 0 if y in (14, 15) else 255))
SLANTED = (25, 25, grey(lambda x, y: 0 if abs(x - y) <= 1 else 255))
STEP = (20, 20, grey(lambda x, y: 255 if x < 10 else 0))
FLAT = (20, 20, grey(lambda x, y: 128))
FADING = (40, 20, grey(lambda x, y: min(255, 20 + 5 * y) if x < 20 else 20))
TINY = (2, 2, grey(lambda x, y: 255 * (x ^ y)))
ALL = (SMOOTH, LINE, THIN, SLANTED, STEP, FLAT, FADING, TINY)


@pytest.fixture(scope="module")
def found(spark):
    out = {i: set() for i in range(len(ALL))}
    for r in op.canny(image(spark, *ALL)).collect():
        assert (r.x, r.y) not in out[r.image_id]
        out[r.image_id].add((r.x, r.y))
    return out


@pytest.mark.parametrize("i", range(len(ALL)))
def test_canny_like_loops(found, i):
    assert found[i] == loop_canny(*ALL[i])


def test_weak_edges_stay_only_with_strong_ones(found):
    """The fading step is weak at its upper end, and is kept there because it goes on to where it is strong."""
    assert found[ALL.index(FADING)]
    assert not found[ALL.index(FLAT)] and not found[ALL.index(TINY)]


def test_edge_map_covers_thin_lines(spark):
    w, h, _ = LINE
    maps = {k: {(r.image_id, r.idx) for r in op.edge_map(image(spark, LINE, THIN, SLANTED, STEP, FLAT), k).collect() if r.edge} for k in (0, 1, 2)}
    assert maps[0] < maps[1] < maps[2]
    # The edges of a line of one pixel lie two pixels from it, those of a line of two one pixel.
    assert {y * w + 15 for y in range(2, h - 2)} <= {i for n, i in maps[2] if n == 0}
    assert {y * 30 + x for y in (14, 15) for x in range(1, 29)} <= {i for n, i in maps[1] if n == 1}
    assert not any(n == 4 for n, _ in maps[2])


def test_one_place_widens_to_a_square(spark):
    one = spark.createDataFrame([(1, 2, 2)], "image_id long, x long, y long")
    assert {(r.x, r.y) for r in op.widened(one, 1).collect()} == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)}
    assert op.widened(one.where("false"), 1).count() == 0


def test_lab_gradient_sees_colours_of_equal_grey(spark):
    df = image(spark, (9, 7, lambda x, y: (200, 60, 60) if x < 4 else (60, 101, 60)), FLAT)
    got = {(r.image_id, r.idx): r.magnitude for r in op.lab_sobel(df).collect()}
    assert len(got) == 63 + 400
    assert got[0, 2 * 9 + 4] > 100 and got[0, 2 * 9 + 1] < 1e-9
    assert max(m for (i, _), m in got.items() if i == 1) < 1e-9
    assert got[0, 4] == 0.0
