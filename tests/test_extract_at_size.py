"""Pages: no pair of a colour and a legend row is sorted, and lines of text are read in order across batches."""

import random

import pytest

from tessella.operators import extract


def test_no_pair_with_a_legend_row_is_sorted(spark, monkeypatch):
    plans, settled = [], extract.settled

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df, name)

    monkeypatch.setattr(extract, "settled", kept)
    rng = random.Random(2)
    cells = [(p, i, 0, *(rng.randrange(6) * 9 for _ in range(3))) for p in range(3) for i in range(40)]
    legend = [(p, f"c{i}", *(rng.randrange(6) * 9 for _ in range(3)), (i * 7) % 20) for p in range(2) for i in range(20)]
    threads = [(1, 0, 0, 0, 1), (2, 50, 50, 50, 2)]
    got = extract.matched(
        spark.createDataFrame(cells, "page_id long, col long, row long, r int, g int, b int"),
        spark.createDataFrame(legend, "page_id long, code string, r int, g int, b int, ord long"),
        spark.createDataFrame(threads, "id long, r int, g int, b int, ord long"),
        10.0,
    )
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    want = {}
    for page, col, _, *rgb in cells:
        d, _, code = min(((apart(rgb, v[2:5]), v[5], v[1]) for v in legend if v[0] == page), default=(1e9, 0, None))
        thread = min((apart(rgb, t[1:4]), t[4], str(t[0])) for t in threads)[2]
        want[page, col] = (code, "legend-exact" if d == 0 else "legend-nearest") if d < 100 else (thread, "catalogue")
    assert {(r.page_id, r.col): (r.code, r.kind) for r in got.collect()} == want
    assert plans and not any("SortAggregate" in p for p in plans)


@pytest.mark.parametrize("colours", [0, 1000])
def test_tables_of_pages_are_not_broadcast(spark, monkeypatch, colours):
    """Small files do not make a broadcast of what grows with the pages; the threads of few colours may be one."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, settled = [], extract.settled
    monkeypatch.setattr(extract, "settled", lambda df, name: plans.append(plan(df)) or settled(df, name))
    monkeypatch.setattr(extract, "BROADCAST_COLOURS", colours)
    cells = [(1, 0, 0, 9, 9, 9), (1, 1, 0, 9, 9, 9), (1, 2, 0, 12, 9, 9), (2, 0, 0, 9, 9, 9), (2, 1, 0, 200, 9, 9), (2, 2, 0, None, 9, 9)]
    threads = [(1, 8, 9, 9, 1), (2, 190, 9, 9, 3), (3, 190, 9, 9, 2), (4, None, 9, 9, 0)]
    got = extract.matched(
        spark.createDataFrame(cells, "page_id long, col long, row long, r int, g int, b int"),
        spark.createDataFrame([(1, "a", 9, 9, 9, 2), (1, "b", 9, 9, 9, 1), (1, "c", 60, 9, 9, 0)], "page_id long, code string, r int, g int, b int, ord long"),
        spark.createDataFrame(threads, "id long, r int, g int, b int, ord long"),
    )
    want = {(1, 0): ("b", "legend-exact"), (1, 1): ("b", "legend-exact"), (1, 2): ("b", "legend-nearest"), (2, 0): ("1", "catalogue"), (2, 1): ("3", "catalogue"), (2, 2): (None, "unknown")}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    assert plan(got).count("BroadcastHashJoin") == (colours > 0)
    assert {(r.page_id, r.col): (r.code, r.kind) for r in got.collect()} == want


def test_bands_across_batches(spark):
    rng = random.Random(1)
    rows = [(p, i, float(rng.randrange(9)), rng.choice([None, *(x * 0.9 for x in range(40))]), f"w{i}") for p in range(12) for i in range(rng.randrange(1, 30))]
    want = {}
    for page in {r[0] for r in rows}:
        band, first = -1, 0.0
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (r[3] is None, -(r[3] or 0), r[1])):
            y = float("nan") if r[3] is None else r[3]
            if band < 0 or first - y > 2.5:
                band, first = band + 1, y
            want.setdefault((page, band), []).append((r[2], r[1], r[4]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = extract.bands(spark.createDataFrame(rows, "page_id long, item long, x double, y double, text string"))
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
        got = {(r.page_id, r.band): r.text for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: " ".join(t for _, _, t in sorted(v)) for k, v in want.items()}
