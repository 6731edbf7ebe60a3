"""Partners and variants are worked once for each distinct colour."""

from tessella.operators import harmony


def test_each_colour_is_worked_once(spark):
    rows = [(i, i % 3 * 80, 40, 200) for i in range(30)] + [(99, None, 1, 2)]
    df = harmony.harmony(spark.createDataFrame(rows, "id long, r int, g int, b int"), "triadic", 9)
    assert "HashAggregate" in df._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in df.collect():
        by.setdefault(r.id, {})[r.place] = (r.r, r.g, r.b)
    assert len(by) == 31 and all(sorted(v) == list(range(9)) for v in by.values())
    assert all(by[i] == by[i % 3] for i in range(30)) and by[0] != by[1]
