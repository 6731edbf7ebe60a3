"""Best-fit packing with certified bounds and exchange between partitions.

Texts become token ids, a separator id behind each. A document longer than a
sequence is cut into full pieces, each a sequence of its own, and one shorter
piece in front. Short pieces are dealt over partitions of bounded size and
packed best-fit decreasing. Dual feasible functions give a lower bound on a
partition's sequences: where it is met, no packing of these rows is better and
the partition is done. The other partitions give their sequences with gaps,
which are dealt anew, so that each group mixes gaps of many partitions; a group
runs best-fit decreasing on its documents and keeps the result if it saves a
sequence. Rounds end when one saves nothing or when all fits one group.

Edge cases: a null or empty text is one separator; repeated rows are packed
once each; equal lengths are ordered by id, so a lost task gives the same
sequences when it runs again; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
SEPARATOR_ID = 0
#: Pieces that one task packs; a few dozen bytes each.
TASK_PIECES = 40_000
#: A partition's sequences are numbered from its index times this.
_SPAN = 1 << 32

_encoding = None


def encoder():
    """The vocabulary of byte_bpe_50k.json, whose ids tiktoken gives at several times the speed; its added tokens count wherever a text holds them."""
    global _encoding
    if _encoding is None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        _encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encoding


@cache
def slow_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str | None) -> np.ndarray:
    """Ids of the text and the separator, as little-endian 32-bit numbers.

    The pattern of the fast encoder gives up, with an error, on runs of white
    space of some hundred thousand characters; such texts go to the slower one,
    whose ids are the same.
    """
    try:
        ids = encoder().encode(text or "", allowed_special="all")
    except ValueError:
        ids = slow_encoder().encode(text, add_special_tokens=False).ids
    return np.array([*ids, SEPARATOR_ID], dtype="<u4")


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids; only the first can be short."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(value.as_py())
                rows += [(key, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut_pieces(len(ids), capacity))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, which must come in descending order; and the number of bins.

    Bins are kept by free space, and a bit for each free space that some bin
    has, so the fullest bin with room is found without a search over bins.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0
    used = 0
    for i, n in enumerate(lengths.tolist()):
        fits = have >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = by_free[free].pop()
            if not by_free[free]:
                have &= ~(1 << free)
        else:
            free, bin_ = capacity, used
            used += 1
        bins[i], offsets[i] = bin_, capacity - free
        if free > n:
            by_free[free - n].append(bin_)
            have |= 1 << (free - n)
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound of two families of dual feasible functions.

    For a threshold t: lengths over capacity - t count as a whole sequence,
    lengths under t as nothing, others as themselves. For a divisor k: a length
    counts as the whole multiples of capacity / (k + 1) that lie strictly below
    it, over k (a multiple itself counts as its share). The plain sum is t = 0.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    total = counts * sizes
    below = np.concatenate(([0], np.cumsum(total)))  # below[x]: of lengths < x
    over = np.concatenate((np.cumsum(counts[::-1])[::-1], [0]))  # over[x]: lengths >= x
    best = 0
    for t in range(capacity // 2 + 1):
        whole = int(over[capacity - t + 1])
        rest = int(below[capacity - t + 1] - below[t])
        best = max(best, whole + -(-rest // capacity))
    for k in range(1, 33):
        share = sizes * (k + 1)
        exact = share % capacity == 0
        # In units of 1 / (k * capacity).
        value = np.where(exact, sizes * k, (share // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _pack(pieces: pd.DataFrame, base: int, capacity: int) -> tuple[pd.DataFrame, int]:
    pieces = pieces.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
    bins, offsets, used = best_fit_decreasing(pieces["length"].to_numpy(), capacity)
    return pieces.assign(sequence_id=base + bins, offset=offsets), used


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long, part long, bound long, bins long, free long"


def _packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing of each part by itself, with the part's bound and bins and each sequence's free space."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        placed, used = _pack(pdf, part * _SPAN, capacity)
        kept_old = "old_sequence" in pdf and used >= pdf["old_sequence"].nunique()
        if kept_old:
            placed = pdf.assign(sequence_id=pdf["old_sequence"], offset=pdf["old_offset"])
            used = placed["sequence_id"].nunique()
        fill = placed.groupby("sequence_id")["length"].transform("sum")
        placed = placed.assign(bound=lower_bound(pdf["length"].to_numpy(), capacity), bins=used, free=capacity - fill)
        return placed[[x.split()[0] for x in PLACED.split(", ")]]

    return pieces.groupBy("part").applyInPandas(pack, PLACED)


def best_fit_pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, task_pieces: int = TASK_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = cut(tokenize(docs, text, doc_id, capacity), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    names = [x.split()[0] for x in PIECE.split(", ")] + ["sequence_id", "offset"]
    n = short.count()
    if not n:
        return full.select(names)
    parts = -(-n // task_pieces)
    # By the row's number in the table just written, so that rows that are alike are dealt over all parts.
    placed = cut(_packed(short.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))), capacity), "packed")
    done = []
    gives = (F.col("bins") > F.col("bound")) & (F.col("free") > 0)
    used = F.count_distinct("sequence_id")
    for turn in count(1):
        rows, sequences, givers = placed.where(gives).agg(F.count(F.lit(1)), used, F.count_distinct("part")).first()
        groups = -(-2 * rows // task_pieces)
        if givers < 2:  # nobody to exchange with
            break
        done.append(placed.where(~gives).select(names))
        dealt = F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)) + parts
        mixed = placed.where(gives).select(*(x.split()[0] for x in PIECE.split(", ")), F.col("sequence_id").alias("old_sequence"), F.col("offset").alias("old_offset"), dealt.alias("part"))
        placed = cut(_packed(mixed, capacity), "packed")
        parts += groups
        if groups == 1 or placed.agg(used).first()[0] == sequences:
            break
    out = full.select(names).unionByName(placed.select(names))
    for d in done:
        out = out.unionByName(d)
    return out
