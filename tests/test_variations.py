import random

from pyspark.sql import functions as F

from tessella.functions import seeded
from tessella.operators import image, variations

MASK = 0xFFFFFFFF


def numbers(seed):
    """The generator in plain integers."""
    while True:
        seed = (seed + seeded.STEP) & MASK
        t = ((seed ^ seed >> 15) * (seed | 1)) & MASK
        t ^= (t + (t ^ t >> 7) * (t | 61)) & MASK
        yield t ^ t >> 14


def test_numbers_of_any_seed(spark):
    seeds = [0, 1, 1337, 2**31 - 1, 2**31, MASK]
    df = spark.createDataFrame([(s,) for s in seeds], "seed long").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200))))
    got = {(r.seed, r.n): r.b for r in df.select("seed", "n", seeded.bits(F.col("seed"), F.col("n")).alias("b")).collect()}
    for s in seeds:
        source = numbers(s)
        assert [got[s, n] for n in range(1, 201)] == [next(source) for _ in range(200)]
    far = spark.range(1).select(seeded.bits(F.lit(7), F.lit(2**32 + 5)).alias("x"), seeded.bits(F.lit(7), F.lit(5)).alias("y")).first()
    assert far.x == far.y


def test_shuffles_like_a_loop(spark):
    pools = {0: [], 1: ["a"], 2: ["b", "c"], 3: [f"t{i}" for i in range(97)], 4: ["same", "same", "x"]}
    seeds = {g: 4_294_967_290 + g for g in pools}
    df = spark.createDataFrame([(g, i, t) for g, pool in pools.items() for i, t in enumerate(pool)], "g long, ord long, item string")
    seed = spark.createDataFrame(list(seeds.items()), "g long, seed long")
    got = variations.shuffled(df, "g", seed, "greatest(2, floor(n * 0.75 + 0.5))").orderBy("g", "place").collect()
    for g, pool in pools.items():
        arr, source = list(pool), numbers(seeds[g])
        for i in range(len(arr) - 1, 0, -1):
            j = int(next(source) / 2**32 * (i + 1))
            arr[i], arr[j] = arr[j], arr[i]
        keep = max(2, int(len(arr) * 0.75 + 0.5))
        assert [(r.place, r.item) for r in got if r.g == g] == list(enumerate(arr[:keep]))
    assert variations.shuffled(df.limit(0), "g", seed, "n").count() == 0


def test_entries_are_taken_once(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for image in range(30):
        taken = set()
        entries = list(range(rng.randint(1, 9)))
        for cluster in range(1, 7):
            order = rng.sample(entries, len(entries))[:6]
            rows += [(image, cluster, i + 1, e) for i, e in enumerate(order)]
            if free := [e for e in order if e not in taken]:
                taken.add(free[0])
                want[image, cluster] = free[0]
    near = spark.createDataFrame(rows, "image_id long, cluster int, rank int, id long")
    got = variations.each_once(near, "image_id").collect()
    assert {(r.image_id, r.cluster): r.id for r in got} == want and len(got) == len(want)


def test_centres_get_different_threads(spark):
    catalogue = spark.createDataFrame([("a", 1, 50.0, 0.0, 0.0), ("b", 2, 52.0, 0.0, 0.0), ("c", 3, 90.0, 0.0, 0.0)], "thread_id string, ord int, c_l double, c_a double, c_b double")
    centres = spark.createDataFrame([(1, 1, 50.5, 0.0, 0.0), (1, 2, 50.4, 0.0, 0.0), (1, 3, 50.5, 0.0, 0.0), (1, 4, 50.0, 0.0, 0.0), (2, 1, 50.5, 0.0, 0.0)], "image_id int, cluster int, l double, a double, b double")
    got = variations.each_once(variations.nearest_entries(centres, catalogue, 4), "image_id").orderBy("image_id", "cluster").collect()
    assert [(r.image_id, r.cluster, r.id) for r in got] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a")]


def test_centres_are_drawn_like_a_loop(spark, monkeypatch):
    monkeypatch.setattr(variations, "BLOCK", 7)
    rng = random.Random(3)
    colours = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(30)]
    images = {0: [rng.choice(colours) for _ in range(200)], 1: [colours[0]] * 5, 2: colours[:2], 3: [rng.choice(colours[:3]) for _ in range(40)]}
    df = spark.createDataFrame([(i, n, *p) for i, px in images.items() for n, p in enumerate(px)], "image_id long, idx long, r int, g int, b int")
    light, a, b = variations.c.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    lab = {(r.r, r.g, r.b): (r.l, r.a, r.bb) for r in df.select("r", "g", "b", light.alias("l"), a.alias("a"), b.alias("bb")).distinct().collect()}
    seeds = spark.createDataFrame([(i, 1337 + i) for i in images], "image_id long, seed long")
    centres = variations.seeded_centres(df, seeds, 6)
    got = centres.orderBy("image_id", "cluster").collect()
    for i, px in images.items():
        source = numbers(1337 + i)
        want = [px[int(next(source) / 2**32 * len(px))]]
        weights = [2**62] * len(px)
        while len(want) < min(6, len(px)):
            new = [int(sum((x - y) ** 2 for x, y in zip(lab[p], lab[want[-1]], strict=True)) * 1e6 + 0.5) for p in px]
            weights = [min(w, n) for w, n in zip(weights, new, strict=True)]
            aim, acc = next(source) * sum(weights), 0
            for p, w in zip(px, weights, strict=True):
                acc += w
                if acc * 2**32 >= aim:
                    want.append(p)
                    break
        assert [(r.r, r.g, r.b) for r in got if r.image_id == i] == want
        assert [r.cluster for r in got if r.image_id == i] == list(range(1, len(want) + 1))
    grouped = image.quantised(df, 6, start=centres).groupBy("image_id").agg(F.sum("n").alias("n"), F.count("*").alias("clusters")).collect()
    assert {r.image_id: (r.n, r.clusters) for r in grouped} == {0: (200, 6), 1: (5, 5), 2: (2, 2), 3: (40, 6)}
