"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over hashed word uni- and bigrams are counted: one over the
trusted texts, one over the whole corpus without the document in question: its
own n-grams would otherwise make every rare one look like a mark of raw text. A
document's score is the mean over its n-grams of log p_trusted - log p_raw, so it
does not depend on the length.
Word statistics that need no model come out of the same scan.

Edge cases: a null text counts as empty; a text without words has score 0 and
fails the base rules; with no trusted rows at all every ratio is 0 and only the
base rules decide. Repeated rows are scored alike. Other columns of the input pass
through unread; one with the name of an added column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import fresh, shuffles_removed

#: Of the multinomials; also the number of rows that reach the driver.
BUCKETS = 1 << 16
#: N-grams that the raw corpus is taken to have in every bucket beforehand, and the trusted texts in proportion.
PRIOR = 10.0
#: Documents that score less are rejected.
THRESHOLD = -0.2
MIN_WORDS = 20
#: In per cent of the words.
MAX_REPEATED = 30
REPEAT_WINDOW = 8

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINE = ord("\n")

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(b: wordhash.Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each uni- and bigram, and the text (index into the block) that it is in."""
    words = b.words()
    owners = b.owners()
    pairs, at = wordhash.windows(words, b.word_offsets, 2)
    buckets = np.concatenate((words, pairs)) & np.uint64(BUCKETS - 1)
    return buckets.astype(np.int64), np.concatenate((owners, owners[at]))


def count_ngrams(docs: DataFrame, text: str, trusted: str) -> DataFrame:
    """One row for each bucket in use: its n-grams in trusted texts and in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            marks = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for b in wordhash.blocks(batch.column(0)):
                buckets, owners = features(b)
                counts[1] += np.bincount(buckets, minlength=BUCKETS)
                counts[0] += np.bincount(buckets[marks[b.rows][owners]], minlength=BUCKETS)
        used = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, counts[0][used], counts[1][used])], names=["bucket", "trusted", "raw"])

    parts = docs.select(F.col(f"`{text}`").cast("string"), F.col(f"`{trusted}`").cast("boolean"))
    return parts.mapInArrow(counted, "bucket long, trusted long, raw long").groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


def totals(counts: DataFrame) -> np.ndarray:
    """Of all buckets, trusted and raw; at most BUCKETS rows come to the driver."""
    with shuffles_removed(counts.sparkSession):
        table = counts.toPandas()
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    out[0, table["bucket"]] = table["trusted"]
    out[1, table["bucket"]] = table["raw"]
    return out


def mean_ratios(buckets: np.ndarray, owners: np.ndarray, n: int, counts: np.ndarray) -> np.ndarray:
    """The mean log ratio of each of n texts whose n-grams these are, as if it were not trusted (first row) and as if it were; all 0 without trusted texts."""
    trusted, raw = counts
    share = trusted.sum() / max(raw.sum(), 1)
    if not share:
        return np.zeros((2, n))
    keys, own = np.unique(owners * BUCKETS + buckets, return_counts=True)
    of, at = keys // BUCKETS, keys % BUCKETS
    others = np.log(share * (np.maximum(raw[at] - own, 0) + PRIOR))
    size = np.maximum(np.bincount(owners, minlength=n), 1)
    return np.stack([np.bincount(of, weights=(np.log(np.maximum(trusted[at] - mine, 0) + PRIOR * share) - others) * own, minlength=n) / size for mine in (0, own)])


def text_stats(b: wordhash.Block) -> dict[str, np.ndarray]:
    """What the base rules count in each text of the block."""
    owners = b.owners()
    lead = wordhash.LEADS[b.data]
    in_word = np.cumsum(np.bincount(b.starts, minlength=len(b.data) + 1) - np.bincount(b.ends, minlength=len(b.data) + 1))[:-1] > 0
    seeds = wordhash.mix(np.arange(1, b.n + 1, dtype=wordhash.U64))

    breaks = np.flatnonzero(b.data == _NEWLINE)
    first = np.sort(np.concatenate((b.offsets[:-1], breaks + 1)))
    doc_of = np.searchsorted(b.offsets, first, side="right") - 1
    last = np.append(first[1:], len(b.data))
    last = np.minimum(last, b.offsets[np.clip(doc_of, 0, b.n - 1) + 1])
    # A line ends before its newline; the line after a text's last newline ends with the text.
    last = np.where((last > first) & (last <= len(b.data)) & (b.data[np.maximum(last - 1, 0)] == _NEWLINE if len(b.data) else False), last - 1, last)
    worded = np.searchsorted(b.starts, last) > np.searchsorted(b.starts, first)
    first, last, doc_of = first[worded], last[worded], doc_of[worded]
    keys = b.hashes(first, last) ^ seeds[doc_of]
    repeated = np.ones(len(keys), dtype=bool)
    repeated[np.unique(keys, return_index=True)[1]] = False

    found, at = wordhash.windows(b.words(), b.word_offsets, REPEAT_WINDOW)
    found ^= seeds[owners[at]]
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    twice = np.zeros(len(found), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(owners) + 1, dtype=np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + REPEAT_WINDOW, -1)
    return {
        "n_words": b.n_words.astype(np.int64),
        "word_chars": b.sums(lead & in_word),
        "n_symbols": b.sums(_SYMBOLS[b.data]),
        "n_dup_lines": np.bincount(doc_of[repeated], minlength=b.n).astype(np.int64),
        "n_repeat_words": b.sums(np.cumsum(edges[:-1]) > 0, b.word_offsets),
    }


def score_documents(docs: DataFrame, counts: np.ndarray, text: str = "text", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """docs with the statistics, base_failed, llr and llr_trusted: the score of the document if it is not trusted, and if it is."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # twice BUCKETS numbers
    out_text, *_ = fresh(docs, "__text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for b in wordhash.blocks(batch.column(batch.num_columns - 1)):
                stats = text_stats(b)
                buckets, owners = features(b)
                stats["llr"], stats["llr_trusted"] = mean_ratios(buckets, owners, b.n, shared.value)
                parts.append(pd.DataFrame(stats))
            if parts:
                stats = pd.concat(parts)
                failed = (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > max_repeated * stats["n_words"])
                more = [pa.array(stats[c].to_numpy()) for c in (*STATS, "llr", "llr_trusted")] + [pa.array(failed.to_numpy())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], *STATS, "llr", "llr_trusted", "base_failed"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{c} long" for c in STATS), "llr double, llr_trusted double, base_failed boolean"])
    return docs.withColumn(out_text, F.col(f"`{text}`").cast("string")).mapInArrow(scored, schema)


def mark_trusted(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a boolean column, true where doc_id is among the ids; and that column's name."""
    key, mark = fresh(docs, "__trusted_id", "__trusted")
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    joined = docs.join(ids.hint("shuffle_hash"), docs[doc_id] == F.col(key), "left")
    return joined.withColumn(mark, F.col(key).isNotNull()).drop(key), mark


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, **limits) -> DataFrame:
    """docs with the statistics, llr (the score against the multinomials of trusted and of all documents), base_failed and kept.

    trusted_ids: one column, the ids of trusted documents.
    """
    added = {c.lower() for c in (*STATS, "llr", "llr_trusted", "base_failed", "kept")}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added and c not in (text, doc_id)))
    marked, mark = mark_trusted(docs.select(doc_id, text), trusted_ids, doc_id)
    scored = score_documents(docs, totals(count_ngrams(marked, text, mark)), text, **limits)
    # Joined behind the scan, where a caller that drops the text need not move it.
    scored, mark = mark_trusted(scored, trusted_ids, doc_id)
    llr = F.when(F.col(mark), F.col("llr_trusted")).otherwise(F.col("llr"))
    return scored.withColumn("llr", llr).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop(mark, "llr_trusted")


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids of the documents that are labelled as good and not as toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
