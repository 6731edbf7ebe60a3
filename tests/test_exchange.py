import pytest
from pyspark.sql import functions as F

from tessella.operators import exchange as op
from tessella.operators import sync

PROJECT = "project_id string, fingerprint string, ord int, name string, state string, seconds long, created_at string, updated_at string"


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def imported(spark, local, remote, choices=()):
    matches = sync.match(remote, local)
    plan = sync.import_plan(matches, remote, local)
    return plan, op.new_ids(matches, plan, local, table(spark, "project_id string, choice string", *choices), lambda i: F.concat(i, F.lit("+")))


@pytest.fixture
def sides(spark):
    """A conflict (p1), a new project (p2), one under two ids (a5 here, p5 there), an identical (p6) and a local one (p7)."""
    local = table(spark, PROJECT, ("p1", "x", 1, "Mine", "active", 10, "c1", "2024-01-02"), ("p5x", "y", 2, "Here", "active", 20, "c2", "2024-01-02"), ("p6", "z", 3, "Same", "active", 5, "c3", "2024-01-01"), ("p7", "q", 4, "Only", "active", 1, "c4", "2024-01-01"))
    remote = table(spark, PROJECT, ("p1", "other", 1, "Theirs", "paused", 7, "r1", "2024-01-03"), ("p2", "n", 2, "New", "active", 3, "r2", "2024-01-03"), ("p5", "y", 3, "There", None, 30, "r3", "2024-01-09"), ("p6", "z", 4, "Same", "active", 5, "r4", "2024-01-01"))
    return local, remote


DONE = "project_id string, idx int, done int"
NO_FIELDS = "project_id string, field string, choice string"


@pytest.mark.parametrize("choice", [None, "keep-local", "keep-remote", "keep-both"])
def test_each_choice(spark, sides, choice):
    local, remote = sides
    plan, ids = imported(spark, local, remote, [("p1", choice)] if choice else [])
    names = {r.project_id: (r.name, r.state, r.seconds, r.created_at) for r in op.merged_projects(local, remote, ids, table(spark, NO_FIELDS)).collect()}
    mine, theirs = ("Mine", "active", 10, "c1"), ("Theirs", "paused", 7, "r1")
    want = {"p2": ("New", "active", 3, "r2"), "p5": ("There", "active", 50, "c2"), "p6": ("Same", "active", 5, "c3"), "p7": ("Only", "active", 1, "c4"), "p1": theirs if choice == "keep-remote" else mine}
    if choice == "keep-both":
        want["p1+"] = ("Theirs (synced)", "paused", 7, None)
    assert names == want
    cells = {s: table(spark, DONE, *((p, i, int((i + len(s)) % 2)) for p in ps for i in range(4))) for s, ps in (("local", ["p1", "p5x", "p7"]), ("remote", ["p1", "p2", "p5"]))}
    got = sorted((r.project_id, r.idx, r.done) for r in op.merged_rows(cells["local"], cells["remote"], ids, ["idx"], greatest=("done",)).collect())
    mine_done, theirs_done = [(i + 5) % 2 for i in range(4)], [(i + 6) % 2 for i in range(4)]
    done = {"p5": [1] * 4, "p7": mine_done, "p2": theirs_done, "p1": theirs_done if choice == "keep-remote" else mine_done} | ({"p1+": theirs_done} if choice == "keep-both" else {})
    assert got == sorted((p, i, x) for p, v in done.items() for i, x in enumerate(v))
    assert {r.project_id for r in op.synced(ids, plan).collect()} == {"p1", "p2", "p5"}
    assert op.counts(plan).first() == (1, 1, 1)


def test_choice_for_each_field(spark, sides):
    local, remote = sides
    _, ids = imported(spark, local, remote)
    row = lambda *fields: next((r.name, r.state) for r in op.merged_projects(local, remote, ids, table(spark, NO_FIELDS, *fields)).collect() if r.project_id == "p5")
    assert row(("p5x", "name", "keep-local")) == ("Here", "active")
    assert row(("p5x", "name", "keep-remote"), ("p5x", "state", "keep-local")) == ("There", "active")
    assert row(("p5x", "state", "keep-remote")) == ("There", "active")  # a missing state never replaces one


def test_second_import_changes_nothing(spark, sides):
    """Once both devices hold the merged chart under the lesser id, an import of it is a merge under that id or identical."""
    local, remote = sides
    _, ids = imported(spark, local, remote)
    after = op.merged_projects(local, remote, ids, table(spark, NO_FIELDS)).where("project_id = 'p5'").selectExpr("project_id", "'y' as fingerprint", "1 as ord", "name", "state", "seconds", "created_at", "updated_at")
    plan, again = imported(spark, after, remote.where("project_id = 'p5'"))
    assert [r.kind for r in plan.collect()] == ["identical"]
    assert {(r.side, r.new_id, r.role) for r in again.collect()} == {("local", "p5", "keep"), ("remote", "p5", "drop")}


def test_half_stitches_by_corner_and_sessions(spark, sides):
    local, remote = sides
    _, ids = imported(spark, local, remote)
    half = "project_id string, idx int, TL string, TR string, BL string, BR string"
    got = op.merged_half_stitches(table(spark, half, ("p5x", 1, "a", None, None, "b"), ("p7", 1, None, None, "k", None)), table(spark, half, ("p5", 1, "z", "y", None, None), ("p5", 2, None, None, None, "w")), ids)
    assert sorted(tuple(r) for r in got.collect()) == [("p5", 1, "a", "y", None, "b"), ("p5", 2, None, None, None, "w"), ("p7", 1, None, None, "k", None)]
    session = "project_id string, start string, date string, duration int, net int, note string"
    mine = table(spark, session, ("p5x", "t1", "d1", 5, 9, "m"), ("p5x", None, "d2", 5, 9, "m"), ("p7", "t1", "d1", 1, 1, "m"), ("p7", "t1", "d1", 1, 1, "m"))
    other = table(spark, session, ("p5", "t1", "d9", 1, 1, "r"), ("p5", None, "d2", 5, 9, "r"), ("p5", None, "d2", 5, 8, "r"), ("p6", "t", "d", 1, 1, "r"))
    got = sorted(((r.project_id, r.start, r.date, r.net, r.note) for r in op.merged_sessions(mine, other, ids).collect()), key=repr)
    assert got == sorted([("p5", "t1", "d1", 9, "m"), ("p5", None, "d2", 9, "m"), ("p5", None, "d2", 8, "r"), ("p7", "t1", "d1", 1, "m"), ("p7", "t1", "d1", 1, "m")], key=repr)


def test_deletions_are_capped(spark, sides):
    local, remote = sides
    _, ids = imported(spark, local, remote)
    log = lambda *names: table(spark, "project_id string, pos int", *((n, i) for i, n in enumerate(names)))
    got = {r.pos: r.project_id for r in op.deletion_log(log("a", "b"), log("b", "c", "d"), ids).collect()}
    assert got == dict(enumerate(["a", "b", "p5x", "c", "d"]))
    assert [r.project_id for r in op.deletion_log(log("a", "b"), log("b", "c", "d"), ids, 3).orderBy("pos").collect()] == ["p5x", "c", "d"]
    assert op.deletion_log(log(), log(), ids.where("false")).collect() == []


def test_nothing_to_import(spark, sides):
    local, remote = sides
    plan, ids = imported(spark, local, remote.where("false"))
    assert sorted(r.project_id for r in op.merged_projects(local, remote.where("false"), ids, table(spark, NO_FIELDS)).collect()) == ["p1", "p5x", "p6", "p7"]
    assert op.counts(plan).first() == (0, 0, 0)
