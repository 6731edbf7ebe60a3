import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.sources import charts, codec, documents


def test_charts_come_back_from_their_files(spark, tmp_path):
    rng = random.Random(4)
    ids = ["310", 'B&W "<1>"', "550+310", "__skip__", "__empty__", "é"]
    grids = {name: [rng.choice(ids) for _ in range(w * h)] for name, (w, h) in {"a": (5, 4), "b": (1, 1), "c": (30, 20)}.items()}
    width = {"a": 5, "b": 1, "c": 30}
    rows = [(name, i, i % width[name], i // width[name], t) for name, grid in grids.items() for i, t in enumerate(grid)]
    cells = spark.createDataFrame(rows, "chart string, idx long, x long, y long, thread_id string")
    palette = spark.createDataFrame([("a", "é", 0, 1, 2, 255), ("a", "unused", 1, 9, 9, 9), ("c", "310", None, 16, 0, 1)], "chart string, id string, place int, r int, g int, b int")
    sizes = spark.createDataFrame([("a", 5, 4), ("b", 1, 1), ("c", 30, 20), ("bare", 2, 2), ("none", 0, 3)], "chart string, w int, h int")
    charts.write_charts(charts.chart_lines(cells, palette, sizes), str(tmp_path / "out"))
    files = {p.parent.name.split("=")[1]: p for p in tmp_path.glob("out/chart=*/part-*")}
    assert set(files) == {"a", "b", "c", "bare"}
    assert len(list(tmp_path.glob("out/chart=*/part-*"))) == 4

    def expected(name):
        order = ["é", "unused"] if name == "a" else []
        cells = []
        for i, t in enumerate(grids.get(name, [])):
            if not t.startswith("__"):
                t = t.split("+")[0]
                if t not in order:
                    order.append(t)
                cells.append((i, order.index(t) + 1))
        return order, cells

    got = documents.read_chart_xml(spark, str(tmp_path / "out"))
    chart = F.regexp_extract("file", "chart=([a-z]+)", 1).alias("chart")
    read = got["cells"].select(chart, "idx", "palette").collect()
    entries = got["palette"].select(chart, "palette", "number", "color").orderBy("chart", "palette").collect()
    for name in files:
        order, cells = expected(name)
        assert sorted((r.idx, r.palette) for r in read if r.chart == name) == cells
        assert [(r.palette, r.number) for r in entries if r.chart == name] == list(enumerate(order, 1))
    assert {(r.chart, r.number): r.color for r in entries}[("a", "é")] == "0102FF"
    assert {(r.chart, r.number): r.color for r in entries}.get(("c", "310")) == "100001"


@pytest.mark.parametrize(
    "xml, cells, entries",
    [
        ('<chart w="2" h="1"><colors><thread code="5" hex="#a0b1c2"/><thread name="only"/></colors><fullstitches><stitch x="1" y="0" palindex="0"/></fullstitches></chart>', [1], [(0, "5", "A0B1C2"), (1, None, None)]),
        ('<chart><size width="3" height="2"/><palette><entry idx="7" number=" 9 " r="1" g="2" b="3"/></palette><fullstitches><stitch x="2" y="1" palindex="7"/><stitch x="3" y="1" palindex="7"/></fullstitches></chart>', [5], [(7, "9", "010203")]),
        ('<chart width="5001" height="1"><fullstitches><stitch x="0" y="0" palindex="1"/></fullstitches></chart>', [], []),
        ("no chart", [], []),
    ],
)
def test_other_spellings(spark, tmp_path, xml, cells, entries):
    (tmp_path / "x.xml").write_text(xml)
    got = documents.read_chart_xml(spark, str(tmp_path / "x.xml"))
    assert sorted(r.idx for r in got["cells"].collect()) == cells
    assert sorted((r.palette, r.number, r.color) for r in got["palette"].collect()) == entries


def test_coded_texts_come_back(spark):
    texts = ["", "x", "é\n " * 1000, json.dumps({"a": [1] * 50_000}), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    both = df.select("i", "t", codec.deflated("t").alias("d"), codec.tagged(F.col("t"), "TAG\n").alias("g"))
    rows = both.withColumns({"back": codec.inflated("d"), "untagged": codec.untagged(F.col("g"), "TAG\n"), "plain": codec.untagged(F.col("t"), "TAG\n")}).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        assert r.back == r.untagged == r.plain == t
        assert t is None or zlib.decompress(r.d).decode() == t
    bad = spark.createDataFrame([("TAG\n!!",), ("TAG\nAAAA",), ("TAG\n",)], "t string")
    assert [r[0] for r in bad.select(codec.untagged(F.col("t"), "TAG\n")).collect()] == [None] * 3


def test_folders_of_devices(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 2, "b"), ("d1", 1, "a"), ("d2", 3, None)], "device string, id int, name string")
    codec.write_documents(codec.device_documents(rows, "device", "id", "name"), "device", str(tmp_path / "in"))
    (one,) = tmp_path.glob("in/device=d1/part-*")
    assert json.loads(zlib.decompress(one.read_bytes())) == [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]
    (tmp_path / "in/own.dat").write_bytes(zlib.compress(json.dumps({"_format": "f", "_version": 1, "_deviceId": "d3", "_createdAt": "2024-01-02T03:04:05Z"}).encode()))
    (tmp_path / "in/cut.dat").write_bytes(one.read_bytes()[:10])
    (tmp_path / "in/text.dat").write_bytes(zlib.compress(b"not json {"))
    got = {r.file.rsplit("/", 1)[1]: r for r in codec.scan_folder(spark, str(tmp_path / "in"), "*.dat").collect()}
    assert set(got) == {"own.dat", "cut.dat", "text.dat"}
    assert (got["own.dat"].device_id, got["own.dat"].version, str(got["own.dat"].created_at)) == ("d3", 1, "2024-01-02 03:04:05")
    assert got["cut.dat"].document is None and got["text.dat"].document is None
    assert codec.scan_folder(spark, str(tmp_path / "in")).where("document is not null").count() == 3
    news = documents.new_files(codec.scan_folder(spark, str(tmp_path / "in"), "*.dat"), "d1", "2024-01-01")
    assert [r.device_id for r in news.collect()] == ["d3"]


def test_restoring_replaces_all_or_nothing(spark, tmp_path):
    schemas = {"cells": "idx long, thread_id string", "stash": "id string, owned int"}
    cells = spark.createDataFrame([(0, "1"), (1, None)], schemas["cells"])
    stash = spark.createDataFrame([("1", 4)], schemas["stash"])
    documents.write_backup({"cells": cells, "stash": stash}, str(tmp_path / "backup"))
    spark.createDataFrame([(9, "old")], schemas["cells"]).write.parquet(str(tmp_path / "live/cells"))
    assert codec.restore_backup(spark, str(tmp_path / "backup"), str(tmp_path / "live"), schemas) == {"cells": 2, "stash": 1}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "live/cells")).collect())) == [(0, "1"), (1, None)]
    (tmp_path / "damaged/cells").mkdir(parents=True)
    (tmp_path / "damaged/cells/a.json").write_text('{"idx": 1, "thread_id": "x"}\n{"idx": ')
    (tmp_path / "damaged/stash").mkdir()
    (tmp_path / "damaged/stash/a.json").write_text('{"id": "2", "owned": 1}\n')
    with pytest.raises(ValueError):
        codec.restore_backup(spark, str(tmp_path / "damaged"), str(tmp_path / "live"), schemas)
    assert spark.read.parquet(str(tmp_path / "live/stash")).first().id == "1"
