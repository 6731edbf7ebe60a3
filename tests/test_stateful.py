import datetime
import json
import random
import time

import pytest

from tessella.operators import progress
from tessella.streaming import stateful

CHANGES = "project_id long, period date, at timestamp, ord long, net long"
START = datetime.datetime(2024, 1, 1, 10)


@pytest.fixture
def state_store(spark):
    for k, v in stateful.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in stateful.STATE_STORE:
        spark.conf.unset(k)


def lines(rows):
    return "".join(json.dumps(r, default=str) + "\n" for r in rows)


def changes():
    """Two projects over two days; totals fall below the goal and cross it again."""
    rng = random.Random(4)
    rows = []
    for p in (1, 2):
        for i in range(60):
            at = START + datetime.timedelta(minutes=29 * i, seconds=p)
            rows.append({"project_id": p, "period": at.date(), "at": at, "ord": i, "net": rng.choice([30, 25, -40, 10, -15])})
    return rows


def test_goal_rearms_and_equals_the_batch(spark, state_store, tmp_path):
    rows = changes()
    (tmp_path / "in").mkdir()
    mixed = [rows[i::4] for i in range(4)]  # every file has changes of all times but none is later than the watermark allows
    far = [{"project_id": 3, "period": "2024-02-01", "at": "2024-02-01 00:00:00", "ord": 0, "net": 0}]
    farther = [{"project_id": 3, "period": "2024-03-01", "at": "2024-03-01 00:00:00", "ord": 0, "net": 0}]
    for i, part in enumerate([*mixed, far, farther]):
        (tmp_path / f"in/{i}.json").write_text(lines(part))
        time.sleep(0.02)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stateful.goal_crossings(stream, 50, "10 days").writeStream.format("memory").queryName("crossed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.project_id, r.period, r.at, r.total) for r in spark.table("crossed").collect())
    batch = progress.goal_crossings(spark.createDataFrame([(r["project_id"], r["period"], r["at"], r["ord"], r["net"]) for r in rows], CHANGES), 50)
    want = sorted((r.project_id, r.period, r.at, r.total) for r in batch.collect())
    assert got == want
    days = [(p, day) for p, day, *_ in got]
    assert len(days) > len(set(days))  # at least one goal was reached twice in a day


def test_one_export_after_a_pause(spark, state_store, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / f"in/{name}.json").write_text(lines(rows))
    change = lambda p, s: {"project_id": p, "at": str(START + datetime.timedelta(seconds=s))}
    stream = spark.readStream.schema("project_id long, at timestamp").json(str(tmp_path / "in"))
    query = stateful.paused_exports(stream, 12).writeStream.format("memory").queryName("exported").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    found = lambda: sorted((r.project_id, r.n_changes, r.last_change) for r in spark.table("exported").collect())
    until = lambda met: next((True for _ in range(180) if met() or time.sleep(0.5)), False)
    read = lambda: sum(p["numInputRows"] for p in query.recentProgress)
    try:
        put("a", [change(1, 0), change(2, 0)])
        assert until(lambda: read() == 2)
        put("b", [change(1, 3), change(1, 1)])  # puts the export of 1 off, if its pause is not over yet
        assert until(lambda: read() == 4 and sum(n for _, n, _ in found()) == 4)
        first = found()
        put("c", [change(1, 60)])
        assert until(lambda: len(found()) > len(first))
        last = found()
    finally:
        query.stop()
    assert sum(n for p, n, _ in last if p == 1) == 4
    assert [x for x in last if x[0] == 2] == [(2, 1, START)]
    assert (1, 1, START + datetime.timedelta(seconds=60)) in last
    assert len(last) == len(first) + 1


def test_batch_exports(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(39)), (1, at(100)), (2, at(5))], "project_id long, at timestamp")
    got = sorted((r.project_id, r.export_at, r.n_changes) for r in progress.paused_exports(df).collect())
    assert got == [(1, at(69), 3), (1, at(130), 1), (2, at(35), 1)]
