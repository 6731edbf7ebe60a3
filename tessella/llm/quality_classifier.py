"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

Features are hashed word uni- and bigrams of the whole text, and n-grams that
only say that a word comes again; each counts with its number over the root of
all n-grams. One more feature is constant. Training reads a bounded
sample of labelled rows in one task, several times in a fixed order; a score is
one sparse dot product and the logistic function.

Edge cases: a null or empty text has the constant only and gets its score;
labels other than 0 and 1, null ids and repeated labels of an id (the greatest
counts) do not disturb; without labelled rows every score is 0.5; repeated rows
score alike. Other columns pass through; one with the name of an added column
gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import fresh

BUCKETS = 1 << 18
#: The labelled rows that training reads at most: those with the least hash of their id.
SAMPLE_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.05, 0.5
CUTOFF = 0.7
#: A word that comes again so many words later makes a feature of its own.
BACK = 4
FOLDS, HELD_OUT_FOLD = 4, 2
#: The last weight belongs to the constant.
BIAS = BUCKETS


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def features(b: wordhash.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and owner of each n-gram, and each text's scale."""
    words = b.words()
    owners = b.owners()
    pairs, at = wordhash.windows(words, b.word_offsets, 2)
    grams = [words, pairs]
    whose = [owners, owners[at]]
    for back in range(1, BACK + 1):  # n-grams in which a word comes again: which word it is does not matter
        again = np.flatnonzero((words[back:] == words[:-back]) & (owners[back:] == owners[:-back])) if len(words) > back else np.zeros(0, np.int64)
        grams.append(np.full(len(again), wordhash.mix(np.array([back], dtype=np.uint64))[0]))
        whose.append(owners[again])
    both = np.concatenate(whose)
    buckets = ((np.concatenate(grams) >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return buckets, both, 1 / np.sqrt(np.maximum(np.bincount(both, minlength=b.n), 1))


def sparse_rows(docs: DataFrame, label: str, text: str, order: str) -> DataFrame:
    """order, label and the text's features as index and value arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in wordhash.blocks(batch.column(2)):
                buckets, owners, scale = features(b)
                keys, counts = np.unique(owners * BUCKETS + buckets, return_counts=True)
                ends = np.concatenate(([0], np.cumsum(np.bincount(keys // BUCKETS, minlength=b.n))))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.rows.start, b.n), batch.column(1).slice(b.rows.start, b.n), lists(pa.array(keys % BUCKETS, pa.int32())), lists(pa.array(counts * scale[keys // BUCKETS]))], names=["ord", "label", "index", "value"])

    return docs.select(F.col(order).alias("ord"), F.col(label).cast("double").alias("label"), F.col(f"`{text}`").cast("string")).mapInArrow(run, "ord long, label double, index array<int>, value array<double>")


def follow_the_regularised_leader(rows: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after so many passes; rows: label, indexes (without repeats), values."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for label, index, value in rows:
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA * w
            n[index] += g * g
    return weights(np.arange(BUCKETS + 1))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from the labelled rows outside the held-out fold, at most sample_rows of them."""
    usable = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("label")).where("id is not null and label in (0, 1)").where(fold(F.col("id")) != HELD_OUT_FOLD)
    sample = usable.groupBy("id").agg(F.max("label").alias("label")).withColumn("ord", F.xxhash64("id")).orderBy("ord", "id").limit(sample_rows)
    # At most sample_rows rows of three numbers.
    joined = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "id")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for pdf in batches:
            rows += [(y, np.append(i, BIAS).astype(np.int64), np.append(v, 1.0)) for y, i, v in zip(pdf["label"], pdf["index"], pdf["value"], strict=True)]
        w = follow_the_regularised_leader(rows)
        used = np.flatnonzero(w)
        yield pd.DataFrame({"index": used, "weight": w[used]})

    one = sparse_rows(joined, "label", "text", "ord").repartition(1).sortWithinPartitions("ord")
    table = one.mapInPandas(fit, "index long, weight double").toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1)
    out[table["index"]] = table["weight"]
    return out


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == "score" and c != text))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # BUCKETS + 1 numbers
    (copy,) = fresh(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for b in wordhash.blocks(batch.column(batch.num_columns - 1)):
                buckets, owners, scale = features(b)
                dot = np.bincount(owners, weights=shared.value[buckets], minlength=b.n) * scale + float(shared.value[BIAS])
                parts.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(parts))], names=[*batch.schema.names[:-1], "score"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])
    return docs.withColumn(copy, F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", cutoff: float = CUTOFF) -> DataFrame:
    """docs with held_out, score and predicted."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("held_out", "predicted") and c != text))
    scored = score(docs, train(docs, labels, text, doc_id), text)
    return scored.withColumns({"held_out": F.coalesce(fold(F.col(f"`{doc_id}`")) == HELD_OUT_FOLD, F.lit(False)), "predicted": (F.col("score") >= cutoff).cast("int")})
