"""Tables that are small on the disks only do not go through the driver."""

from tessella.operators import contours, grid, selection


def chart(spark):
    return spark.createDataFrame([(1, i, i % 6, i // 6, "ABAABC"[i * i % 6], 0) for i in range(48)], "project_id long, idx long, x long, y long, thread_id string, done int")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_like(spark):
    assert "Broadcast" not in plan(grid.nearest_like(chart(spark)))


def test_colour_metrics(spark):
    cells = chart(spark)
    assert "Broadcast" not in plan(grid.colour_metrics(cells, grid.components(cells)))


def test_tidied(spark):
    cells = chart(spark)
    assert "Broadcast" not in plan(selection.tidied(cells, selection.everything(cells), 3))


def test_rings(spark):
    assert "Join" not in plan(grid.outline(chart(spark), "A"))
    assert "Join" not in plan(contours.rings(chart(spark), "A"))
