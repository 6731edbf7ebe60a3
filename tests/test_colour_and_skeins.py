import pytest
from pyspark.sql import functions as F

from tessella.functions import colour as c
from tessella.functions import skeins as sk

#: Published pairs of Sharma, Wu and Dalal (2005).
VECTORS = [
    ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425),
    ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615),
    ((50, 2.8361, -74.0200), (50, 0, -82.7485), 3.4412),
    ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0000),
    ((50, -1.1848, -84.8006), (50, 0, -82.7485), 1.0000),
    ((50, -0.9009, -85.5211), (50, 0, -82.7485), 1.0000),
    ((50, 0, 0), (50, -1, 2), 2.3669),
    ((50, -1, 2), (50, 0, 0), 2.3669),
    ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792),
    ((50, 2.49, -0.001), (50, -2.49, 0.0010), 7.1792),
    ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195),
    ((50, 2.49, -0.001), (50, -2.49, 0.0012), 7.2195),
    ((50, -0.001, 2.49), (50, 0.0009, -2.49), 4.8045),
    ((50, -0.001, 2.49), (50, 0.0011, -2.49), 4.7461),
    ((50, 2.5, 0), (50, 0, -2.5), 4.3065),
    ((50, 2.5, 0), (73, 25, -18), 27.1492),
    ((50, 2.5, 0), (61, -5, 29), 22.8977),
    ((50, 2.5, 0), (56, -27, -3), 31.9030),
    ((50, 2.5, 0), (58, 24, 15), 19.4535),
    ((50, 2.5, 0), (50, 3.1736, 0.5854), 1.0000),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((63.0109, -31.0961, -5.8663), (62.8187, -29.7946, -4.0864), 1.2630),
    ((22.7233, 20.0904, -46.6940), (23.0331, 14.9730, -42.5619), 2.0373),
    ((36.4612, 47.8580, 18.3852), (36.2715, 50.5065, 21.2231), 1.4146),
    ((90.9257, -0.5406, -0.9208), (88.6381, -0.8985, -0.7239), 1.5381),
    ((6.7747, -0.2908, -2.4247), (5.8714, -0.0985, -2.2286), 0.6377),
    ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082),
]


def test_published_differences(spark):
    rows = [(*map(float, (*p, *q)), d) for p, q, d in VECTORS]
    df = spark.createDataFrame(rows, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    side = lambda k: tuple(F.col(f"{x}{k}") for x in "lab")
    for r in df.select("want", c.ciede2000(side(1), side(2)).alias("there"), c.ciede2000(side(2), side(1)).alias("back")).collect():
        assert r.there == pytest.approx(r.want, abs=1e-4)
        assert r.back == pytest.approx(r.there, abs=1e-9)


def test_black_and_white(spark):
    df = spark.range(1).select(*(F.lit(v).cast("int").alias(n) for n, v in (("r", 255), ("g", 255), ("b", 255))))
    light, a, b = c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    r = df.select(light.alias("l"), a.alias("a"), b.alias("b"), c.ciede2000((light, a, b), (F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("d")).first()
    assert r.l == pytest.approx(100, abs=0.01)
    assert abs(r.a) < 0.02
    assert abs(r.b) < 0.02
    assert r.d > 90


@pytest.mark.parametrize(("stitches", "fabric", "strands", "metres", "waste", "exact", "buy"), [(5000, 14, 2, 8, 0.2, 2.27, 3), (1000, 14, 2, 8, 0.2, 0.45, 1), (1000, 18, 2, 8, 0.2, 0.35, 1), (1000, 14, 3, 8, 0.2, 0.68, 1), (5000, 14, 2, 10, 0.2, 1.81, 2), (5000, 14, 2, 8, 0.1, 2.02, 3), (5000, 14, 2, 8, 0.3, 2.59, 3), (0, 14, 2, 8, 0.2, 0, 0)])
def test_skeins(spark, stitches, fabric, strands, metres, waste, exact, buy):
    kw = {"fabric": fabric, "strands": strands, "metres": metres, "waste": waste}
    r = spark.range(1).select(sk.skeins_exact(F.lit(stitches), **kw).alias("e"), sk.skeins_needed(F.lit(stitches), **kw).alias("n")).first()
    assert r.e == pytest.approx(exact, abs=0.05)
    assert r.n == buy
