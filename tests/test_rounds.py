import pytest
from pyspark.sql import functions as F
from test_stencils import PIXELS, exchanges

from tessella.operators import edges
from tessella.plans import rounds


@pytest.mark.parametrize("most", [rounds.GROUP_LINKS, 1])
def test_roots_are_the_least_reached_however_links_are_dealt(spark, monkeypatch, most):
    monkeypatch.setattr(rounds, "GROUP_LINKS", most)
    chains = [(g, i + 1, i) for g in range(4) for i in range(40) if i % 10]
    links = spark.createDataFrame([*chains, (9, 70, 3), (9, 70, 5), (9, 5, 4)], "g long, u long, v long")
    got = {(r.g, r.node): r.root for r in rounds.least_reached(links, "g").collect()}
    want = {(g, n): 1 + (n - 1) // 10 * 10 for g in range(4) for n in range(1, 41)} | dict.fromkeys([(9, 70), (9, 3), (9, 5), (9, 4)], 3)
    assert got == want


def test_a_round_moves_links_once(spark):
    """Windows over links that are dealt by group, instead of joins and aggregates that each move them."""
    links = spark.range(3000).select((F.col("id") % 30).alias("g"), (F.col("id") + 30).alias("u"), F.col("id").alias("v"))
    assert exchanges(rounds.starred(links, "g", True)) == 1


def test_a_gradient_moves_each_pixel_once(spark):
    pixels = spark.createDataFrame([(1, y * 5 + x, x, y, x, y, 9) for y in range(4) for x in range(5)], PIXELS)
    assert exchanges(edges.lab_sobel(pixels.repartition(4, "image_id"))) == 1


def test_a_dealt_table_is_grouped_and_joined_where_it_is(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), "id")
    table = rounds.dealt(df, "g")
    few = spark.createDataFrame([(1, 2)], "g long, k long")
    assert table.count() == 100
    assert exchanges(table.groupBy("g").count()) == 0
    assert exchanges(table.join(few.hint("merge"), "g")) == 1
