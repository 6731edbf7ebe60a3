import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import colour as c
from tessella.operators import colour as search
from tessella.operators import nearby


def rgb_lab(spark, rows, names):
    df = spark.createDataFrame(rows, "id long, r int, g int, b int")
    light, a, b = c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return df.select("id", light.alias(names[0]), a.alias(names[1]), b.alias(names[2]))


@pytest.fixture(scope="module")
def sides(spark):
    """Points all over Lab, some beyond any colour, and a catalogue with crowds and gaps."""
    rng = random.Random(8)
    colour = lambda: tuple(rng.randrange(256) for _ in range(3))
    points = rgb_lab(spark, [(i, *colour()) for i in range(60)], "lab").drop("id")
    points = points.unionByName(spark.createDataFrame([(50.0, 300.0, -300.0), (0.0, 0.0, 0.0), (100.0, 0.0, 0.0), (500.0, 0.0, 0.0)], "l double, a double, b double")).distinct()
    crowd = [tuple(min(255, 100 + rng.randrange(12)) for _ in range(3)) for _ in range(150)]
    rows = [(i, *x) for i, x in enumerate(dict.fromkeys([*crowd, *(colour() for _ in range(250))]))]
    stock = rgb_lab(spark, rows, ("c_l", "c_a", "c_b")).select(F.col("id").alias("thread_id"), F.col("id").cast("int").alias("ord"), "c_l", "c_a", "c_b")
    points, stock = points.cache(), stock.cache()
    pairs = points.crossJoin(stock).withColumn("d2", c.delta_e2(search.lab(""), search.lab("c_"))).withColumn("delta", c.ciede2000(search.lab(""), search.lab("c_"))).collect()
    by_point = {}
    for p in pairs:
        by_point.setdefault((p.l, p.a, p.b), []).append(p)
    return points, stock, by_point


@pytest.mark.parametrize(("k", "few", "side"), [(1, 0, 12.0), (5, 0, 3.0), (5, 1000, 12.0), (1000, 0, 60.0)])
def test_nearest_like_all_pairs(sides, k, few, side):
    points, stock, by_point = sides
    got = {}
    for r in nearby.nearest_in_lab(points, stock, k, side, few).collect():
        got.setdefault((r.l, r.a, r.b), []).append((r["rank"], r.thread_id))
    want = {p: [(i + 1, x.thread_id) for i, x in enumerate(sorted(v, key=lambda x: (x.d2, x.ord))[:k])] for p, v in by_point.items()}
    assert {p: sorted(v) for p, v in got.items()} == want


@pytest.mark.parametrize("most", [0.5, 3.0, 9.0, 40.0])
def test_no_pair_within_ciede2000_is_missed(sides, most):
    points, stock, by_point = sides
    got = {(r.l, r.a, r.b, r.thread_id) for r in nearby.within_ciede2000(points, stock, F.lit(most)).collect()}
    want = {(*p, x.thread_id) for p, v in by_point.items() for x in v if x.delta <= most}
    assert want <= got
    assert most > 9 or len(got) < 0.6 * sum(map(len, by_point.values()))


def test_the_bound_holds_for_strong_colours(spark):
    """Near pairs anywhere in Lab, blues above all, where the rotation term counts."""
    rng = random.Random(3)
    rows = []
    for _ in range(20_000):
        p = (rng.uniform(0, 100), rng.uniform(-110, 110), rng.uniform(-128, 110))
        rows.append((*p, *(x + rng.gauss(0, rng.choice([0.5, 4, 15])) for x in p)))
    df = spark.createDataFrame(rows, "l double, a double, b double, c_l double, c_a double, c_b double").withColumn("delta", c.ciede2000(search.lab(""), search.lab("c_")))
    apart = F.sqrt((F.col("a") - F.col("c_a")) * (F.col("a") - F.col("c_a")) + (F.col("b") - F.col("c_b")) * (F.col("b") - F.col("c_b")))
    reach = nearby.plane_reach(c.chroma(F.col("a"), F.col("b")), F.col("delta"))
    assert df.where(apart > reach + 1e-9).count() == 0
    farthest = F.greatest(F.abs(F.col("l") - 50), F.abs(F.col("c_l") - 50))
    assert df.where(F.abs(F.col("l") - F.col("c_l")) > nearby.light_reach(farthest, F.col("delta")) + 1e-9).count() == 0
    assert df.where(reach.isNotNull()).count() > 10_000


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_by_ciede2000(sides, k):
    points, stock, by_point = sides
    got = {}
    for r in nearby.nearest_by_ciede2000(points, stock, k).collect():
        got.setdefault((r.l, r.a, r.b), []).append((r.delta, r.thread_id))
    for p, v in by_point.items():
        assert [t for _, t in sorted(got[p])[:k]] == [x.thread_id for x in sorted(v, key=lambda x: (x.delta, x.thread_id))[:k]]


def test_large_catalogues_join_on_boxes(spark):
    """No plan compares all colours of a large catalogue."""
    stock = spark.range(50_000).selectExpr("id as thread_id", "cast(id as int) as ord", "cast(id % 100 as double) as c_l", "cast(id % 211 - 105 as double) as c_a", "cast(id % 199 - 99 as double) as c_b")
    points = spark.range(300).selectExpr("id", "id % 97 + 0.5 as l", "id % 150 - 75.25 as a", "id % 140 - 70.75 as b")
    for found in (search.nearest(points, stock), search.substitutes(points, stock, 3), search.covered(points, stock, 3.0), search.near_pairs(stock, 0.5)):
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert search.nearest(points, stock).count() == 300


def _sorted_in_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort ")


def test_few_colours_are_not_sorted_by_point(spark):
    """The nearest of few colours are found where a point stands, ties by ord, whatever k; no pair is sorted or shuffled."""
    rng = random.Random(4)
    catalogue = [(i, i, float(rng.randrange(4) * 30), float(rng.randrange(4) * 20), 0.0) for i in range(60)]
    points = [(float(rng.randrange(100)), float(rng.randrange(90)), 0.0) for _ in range(40)]
    c = spark.createDataFrame(catalogue, "thread_id long, ord long, c_l double, c_a double, c_b double")
    p = spark.createDataFrame(sorted(set(points)), "l double, a double, b double")
    for k in (1, 5, 70):
        df = nearby.nearest_in_lab(p, c, k)
        got = {(r.l, r.a, r["rank"]): (r.thread_id, r.d2) for r in df.collect()}
        want = {}
        for x, y, _ in set(points):
            best = sorted(((x - cl) ** 2 + (y - ca) ** 2, o, t) for t, o, cl, ca, _ in catalogue)[:k]
            want |= {(x, y, n + 1): (t, d) for n, (d, _, t) in enumerate(best)}
        assert got == want
        assert _sorted_in_plan(df) == 0
    assert nearby.nearest_in_lab(p, c.limit(0)).count() == 0


def test_few_colours_are_not_met_by_boxes(spark):
    """A far reach with few colours makes no row for each box."""
    c = spark.createDataFrame([(i, i, i * 10.0, i * 9.0 - 40, 40 - i * 8.0) for i in range(10)], "thread_id long, ord long, c_l double, c_a double, c_b double")
    p = spark.createDataFrame([(50.0, 1.0, 2.0), (10.0, 90.0, -90.0)], "l double, a double, b double")
    found = nearby.within_ciede2000(p, c, F.lit(60.0))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    pair = lambda df: {(r.l, r.thread_id) for r in df.withColumn("d", nearby.c.ciede2000(nearby._lab(""), nearby._lab("c_"))).where("d <= 60").collect()}
    assert pair(found) == pair(p.crossJoin(c)) == pair(nearby.within_ciede2000(p, c, F.lit(60.0), few=0))
