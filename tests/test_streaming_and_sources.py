import datetime
import json

from tessella.operators import insights
from tessella.sources import documents
from tessella.streaming import live


def test_stream_gives_the_batch_sessions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, 10)
    minutes = {1: [0, 4, 9, 40, 45, 200], 2: [0, 11, 22]}
    rows = [(p, start + datetime.timedelta(minutes=m), 3, 1) for p, ms in minutes.items() for m in ms]
    (tmp_path / "in").mkdir()
    text = "".join(json.dumps({"project_id": p, "ts": t.isoformat(), "completed": c, "undone": u}) + "\n" for p, t, c, u in rows)
    far = json.dumps({"project_id": 9, "ts": "2024-01-05T00:00:00", "completed": 0, "undone": 0}) + "\n"  # moves the watermark on
    (tmp_path / "in/a.json").write_text(text)
    (tmp_path / "in/b.json").write_text(far)
    stream = live.live_sessions(live.activity_stream(spark, str(tmp_path / "in"), 1))
    query = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.project_id, r.start_time, r.net, r.seconds) for r in spark.table("found").collect()}
    batch = insights.live_sessions(spark.createDataFrame(rows, "project_id long, ts timestamp, completed long, undone long"))
    assert got == {(r.project_id, r.start_time, r.net, r.seconds) for r in batch.collect()}
    assert len(got) == 6


def test_counters_replace_by_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"project_id": 1, "ts": f"2024-01-01T1{i}:00:00", "completed": 5, "undone": 1}) + "\n")
    state = {}
    query = live.upserts(live.daily_counters(live.activity_stream(spark, str(tmp_path / "in"), 1)), lambda b: state.update({(r.project_id, str(r.date)): r.net for r in b.collect()}), str(tmp_path / "cp"))
    query.awaitTermination()
    assert state == {(1, "2024-01-01"): 12}


def test_chart_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<chart><properties chartwidth="2" chartheight="2"/><palette><palette_item number="DMC 310" name="Black" color="000000"/></palette><fullstitches><stitch x="0" y="0" palindex="1"/><stitch x="1" y="1" palindex="1"/><stitch x="5" y="0" palindex="1"/></fullstitches></chart>')
    got = documents.read_chart_xml(spark, str(tmp_path / "a.xml"))
    assert sorted(r.idx for r in got["cells"].collect()) == [0, 3]
    assert got["palette"].first()["name"] == "Black"


def test_json_projects_and_backup(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"id": "x", "w": 2, "h": 1, "p": [{"id": "310"}, {"id": "550"}]}))
    cells = documents.cells_of(documents.read_projects_json(spark, str(tmp_path / "p.json")))
    assert sorted((r.idx, r.thread_id) for r in cells.collect()) == [(0, "310"), (1, "550")]
    documents.write_backup({"cells": cells}, str(tmp_path / "backup"))
    assert documents.read_backup(spark, str(tmp_path / "backup"), {"cells": "project_id string, idx long, thread_id string"})["cells"].count() == 2


def test_notes_keep_their_quotes(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 'say "hi", twice')], "start_time string, note string")
    documents.write_sessions_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"say ""hi"", twice"' in text
