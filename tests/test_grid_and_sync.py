import pytest

from tessella.operators import grid, sync


def chart(spark, w, ids):
    return spark.createDataFrame([(1, i, i % w, i // w, t, 0) for i, t in enumerate(ids)], "project_id long, idx long, x long, y long, thread_id string, done int")


@pytest.mark.parametrize(("w", "ids", "labels"), [(3, "AAA", [0, 0, 0]), (2, "ABBA", [0, 1, 2, 3]), (3, "ABA", [0, 1, 2]), (4, "AAAABBBAAAAA", [0, 0, 0, 0, 4, 4, 4, 0, 0, 0, 0, 0])])
def test_components(spark, w, ids, labels):
    got = {r.idx: r.label for r in grid.components(chart(spark, w, ids)).collect()}
    assert [got[i] for i in range(len(ids))] == labels


def test_skipped_cells_part_components(spark):
    got = grid.components(chart(spark, 3, ["A", "__skip__", "A"])).collect()
    assert {(r.idx, r.label) for r in got} == {(0, 0), (2, 2)}


@pytest.mark.parametrize(("w", "ids", "counts"), [(1, "A", [0]), (3, "AAA", [1, 2, 1]), (2, "AAAA", [3, 3, 3, 3])])
def test_like_neighbours(spark, w, ids, counts):
    got = {r.idx: r.n for r in grid.like_neighbours(chart(spark, w, ids)).collect()}
    assert [got[i] for i in range(len(ids))] == counts


def test_nearest_like(spark):
    assert grid.nearest_like(chart(spark, 1, "A")).first().distance == 999
    assert {round(r.distance, 4) for r in grid.nearest_like(chart(spark, 2, "ABBA")).collect()} == {1.4142}


def test_confetti(spark):
    c = chart(spark, 3, "ABB")
    r = grid.confetti(c, grid.components(c)).first()
    assert (r.singles, r.small_cluster_cells, r.percent) == (1, 2, 100.0)


def test_empty_chart(spark):
    empty = chart(spark, 1, "A").where("false")
    assert grid.components(empty).count() == 0
    assert grid.summary(empty).count() == 0


def test_done_on_either_side(spark):
    a, b = chart(spark, 3, "AAA"), chart(spark, 3, "AAA")
    got = sync.merge_done(a.selectExpr("project_id", "idx", "int(idx = 0) done"), b.selectExpr("project_id", "idx", "int(idx = 2) done"))
    assert {r.idx: r.done for r in got.collect()} == {0: 1, 1: 0, 2: 1}


def test_stash_merge(spark):
    schema = "id long, owned long, tobuy boolean, min_stock long, added_at string"
    local = spark.createDataFrame([(310, 2, False, 0, "a"), (550, 1, True, 0, "b")], schema)
    remote = spark.createDataFrame([(310, 3, True, 1, "c"), (666, 1, False, 0, "d")], schema)
    merged = sync.merge_stash(local, remote)
    got = {r.id: (r.owned, r.tobuy, r.min_stock, r.added_at) for r in merged.collect()}
    assert got == {310: (3, True, 1, "a"), 550: (1, True, 0, "b"), 666: (1, False, 0, "d")}
    assert {tuple(r) for r in sync.merge_stash(merged, remote).collect()} == {tuple(r) for r in merged.collect()}


def test_a_local_project_is_claimed_once(spark):
    schema = "project_id string, fingerprint string, ord long"
    got = sync.match(spark.createDataFrame([("r1", "f", 1), ("r2", "f", 2)], schema), spark.createDataFrame([("a", "f", 1)], schema))
    assert {r.project_id: (r.local_id, r.how, r.canonical_id) for r in got.collect()} == {"r1": ("a", "fingerprint", "a"), "r2": (None, "new", "r2")}
