"""Shuffles draw each place once; centres are the same by image and by blocks."""

import random
import time

from pyspark.sql import functions as F

from tessella.operators import variations


def test_a_large_palette_is_shuffled_in_time(spark):
    """Places drawn again for every item of every swap took minutes."""
    n, groups = 300, 12
    items = spark.range(n * groups).select((F.col("id") % groups).alias("g"), F.col("id").alias("ord"), F.col("id").alias("item"))
    seeds = spark.range(groups).select(F.col("id").alias("g"), (F.col("id") + 5).alias("seed"))
    began = time.monotonic()
    got = variations.shuffled(items, "g", seeds, "n").collect()
    assert time.monotonic() - began < 60
    for g in range(groups):
        assert sorted(r["item"] for r in got if r.g == g) == list(range(g, n * groups, groups))


def test_centres_by_image_and_by_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, n, *(rng.randrange(0, 256, 51) for _ in range(3))) for i in range(6) for n in range(rng.choice([1, 3, 50]))]
    df = spark.createDataFrame(rows, "image_id long, idx long, r int, g int, b int")
    seeds = df.select("image_id").distinct().withColumn("seed", F.col("image_id") + 99)
    monkeypatch.setattr(variations, "BLOCK", 7)
    found = []
    for most in (1_000_000, 0):
        monkeypatch.setattr(variations, "IMAGE", most)
        found.append(sorted(map(tuple, variations.seeded_centres(df, seeds, 5).collect())))
    assert found[0] == found[1] and len(found[0]) > 6
