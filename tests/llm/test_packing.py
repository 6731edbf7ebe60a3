import zlib
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessella.llm import packing, queries


def valid(df: pd.DataFrame, capacity: int) -> None:
    df = df.sort_values(["sequence_id", "offset"])
    ends = df.offset + df.length
    assert ends.max() <= capacity
    before = ends.shift(1).where(df.sequence_id == df.sequence_id.shift(1), 0)
    assert (df.offset == before).all()


@pytest.mark.parametrize("seed", range(40))
def test_bounds_and_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 21, rng.integers(1, 7)))[::-1]
    best = len(lengths)
    for order in permutations(lengths.tolist()):
        bins, room = 1, 20
        for n in order:
            if n > room:
                bins, room = bins + 1, 20
            room -= n
        best = min(best, bins)
    _, _, used = packing.best_fit_decreasing(lengths, 20)
    assert packing.lower_bound(lengths, 20) <= best <= used


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()] + ["", "a  b\n\n\tc", "<|endoftext|> x", "a <|endoftext|><|endoftext|>b<|endoftext", "漢字 é", "x" * 5000]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.token_ids(text).tolist() == [*e.ids, 0]


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "word" + " \n" * 700_000])
def test_long_white_space(spark, text):
    """The fast encoder fails on these; ids are the tokenizers library's all the same, in a query too."""
    with pytest.raises(ValueError, match="."):
        packing.encoder().encode(text, allowed_special="all")
    want = [*packing.slow_encoder().encode(text, add_special_tokens=False).ids, 0]
    assert packing.token_ids(text).tolist() == want
    rows = packing.tokenize(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(want)


@pytest.mark.parametrize("task", [40_000, 30])
def test_whole_table(spark, task):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.best_fit_pack(docs, capacity=256, task_pieces=task).toPandas()
    valid(got, 256)
    assert got.sequence_id.nunique() <= packing.lower_bound(got.length.to_numpy(), 256) * 1.03 + 1
    for doc_id, text in {r.doc_id: r.text for r in docs.limit(20).collect()}.items():
        ids = packing.token_ids(text)
        mine = got[got.doc_id == doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids)
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            assert p.piece == 0 or p.length == 256


def test_query_like_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op1_best_fit_packing(spark, SF).toPandas()
    valid(got, 2048)
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.append((r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    assert got.sequence_id.nunique() <= packing.lower_bound(got.length.to_numpy(), 2048) + 1


def test_repeated_rows_are_dealt_over_parts(spark):
    docs = spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("some words " * 9).alias("text"))
    got = packing.best_fit_pack(docs, capacity=64, task_pieces=50).toPandas()
    valid(got, 64)
    assert len(got) == 400
    per = 64 // int(got.length.iloc[0])
    # At most one sequence more for each of the eight parts.
    assert got.sequence_id.nunique() <= -(-400 // per) + 8
    assert got.groupby(got.sequence_id // packing._SPAN).size().max() < 100


def test_awkward(spark, awkward, empty):
    got = packing.best_fit_pack(awkward).toPandas()
    valid(got, 2048)
    assert got[got.doc_id == 1].length.tolist() == [1]
    assert len(got[got.doc_id == 4]) == 2
    assert packing.best_fit_pack(empty).count() == 0
