import random

import pytest

from tessella.operators import image

PIXELS = "image_id long, idx long, x long, y long, r int, g int, b int"


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-*(0123456789)").startswith("Exchange") for line in plan.splitlines())


@pytest.fixture(scope="module")
def holed(spark):
    """Pictures with places missing, the last row cut short."""
    draw = random.Random(3)
    rows = [(i, y * 7 + x, x, y, *(draw.randrange(256) for _ in "rgb")) for i in range(3) for y in range(6) for x in range(7) if (x, y) not in ((2, 3), (3, 3), (0, 1)) and y * 7 + x < 39]
    return spark.createDataFrame(rows, PIXELS)


@pytest.mark.parametrize("stencil", [image.gaussian, image.median, image.sobel, image.saliency])
def test_a_stencil_moves_each_pixel_once(spark, holed, stencil):
    assert exchanges(stencil(holed.repartition(4, "image_id"))) == 1


def test_gaussian_leaves_out_missing_places(holed):
    at = {(r.image_id, r.x, r.y): r.r for r in holed.collect()}
    # The last row goes on with its last pixel.
    at |= {(i, x, 5): at[i, 3, 5] for i in range(3) for x in (4, 5, 6)}
    got = {(r.image_id, r.idx): r.r for r in image.gaussian(holed).collect()}
    assert len(got) == len(at)
    for (i, x, y), _ in at.items():
        near = [(image.GAUSSIAN[k], at.get((i, max(0, min(6, x + dx)), max(0, min(5, y + dy))))) for k, (dx, dy) in enumerate(image.PLACES)]
        assert got[i, y * 7 + x] == sum(w * v for w, v in near if v is not None) / 16
