import random

from pyspark.sql import functions as F

from tessella.plans.ranks import placed


def test_numbers_within_groups(spark):
    """One group holds most rows and so spans several ranges; a null group is a group."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, v int")
    got = {r.id: r.place for r in placed(df, ["g"], [F.desc("v"), F.col("id")], "place").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r[1]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])))}
    assert got == want
    assert placed(df.where("false"), ["g"], [F.col("id")], "place").collect() == []
