import corpus_pipeline
from conftest import SF

from tessella.llm import packing

from .conftest import variant


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, last = docs.columns, None
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
        assert docs.columns == names
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids, name
        ids = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(last.doc_id) == ids
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert last.groupby("doc_id").length.sum().to_dict() == {i: len(packing.token_ids(t)) for i, t in texts.items()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_awkward_documents(spark, awkward, empty):
    more = [c for c in awkward.columns if c not in empty.columns]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, SF)
        assert out.columns == awkward.columns, name
        rows = out.collect()
        assert rows or name == "quality rules"
        # Columns of the caller keep their values, whatever their names.
        assert all(r[c] == "x" for r in rows for c in more), name
        assert stage(spark, empty, SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in last(spark, awkward, SF).collect()} == {r.doc_id for r in awkward.collect()}
    assert last(spark, empty, SF).count() == 0


def test_near_copies_of_shared_ids(spark):
    """Different texts under one id are judged each by itself; rows that differ in other columns leave the least one."""
    a, b, c = variant(1), variant(2), variant(3)
    rows = [(1, a, "p"), (5, b, "p"), (5, a + " more", "p"), (7, c, "z"), (7, c, "y"), (7, c, None), (None, b + " tail", "p"), (None, variant(4), "q"), (9, "", "p"), (10, None, "p"), (3, a + " x", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, a, "p"), (5, b, "p"), (7, c, None), (None, variant(4), "q"), (9, "", "p"), (10, None, "p")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_run_on_an_empty_table(spark, empty, tmp_path):
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
