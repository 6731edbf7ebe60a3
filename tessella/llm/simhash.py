"""Near-duplicate documents by SimHash, joined on pigeonhole blocks of the fingerprint.

Two fingerprints that differ in at most d bits, split into d + 2 blocks, agree
in two blocks at least: the pairs of blocks, kept under a mask, are the keys of
a join, and every pair that shares a key is verified by its Hamming distance. A
bucket of many fingerprints is split again by the same rule: its members agree in
the bits of the key, so at most d of the other bits differ, and these are cut
into blocks in turn. Once so few bits are left that a bucket is small by their
number, it is compared as it is; so all pairs of a large group are never tested,
and none that differ in at most d bits is missed.

Equal fingerprints are one node; links join nodes, and components follow.

Words are runs of bytes other than a space and 0x09-0x0D, A-Z lower-cased; a
shingle is so many words joined by one space, hashed by XXH64 with seed 42.
Repeated shingles count each time. A bit is 1 if it is set in over half of the
hashes.

Edge cases: null, empty and wordless texts have fingerprint zero and are linked
like any other; a text shorter than a shingle is one shingle; rows are nodes, so
repeated rows and rows of one id with different texts each keep their own
fingerprint; a row without id links, but a component has the least id of those
that have one (null if none); a very long text is hashed in pieces that overlap
by a shingle's words less one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .components import connected_components
from .naming import join_common

SHINGLE = 3
SEED = 42
DIFFERING = 2
#: A bucket of more fingerprints is split again, as long as more bits than LEAST_BITS differ inside it.
BUCKET = 64
LEAST_BITS = 8
#: Bytes of text that are split into words at once, and hashes whose bits are counted at once.
PIECE_BYTES = 1 << 20
PIECE_HASHES = 1 << 16

_BREAK = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: bytes, size: int = SHINGLE, piece: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """The hashes of all shingles of a text, in pieces."""
    digest, held, at, any_yet = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        end = len(text) if at + piece >= len(text) else (m.start() if (m := _BREAK.search(text, at + piece)) else len(text))
        # bytes.lower() changes A-Z alone, and bytes.split() splits at a space and 0x09-0x0D.
        words = held + text[at:end].lower().split()
        at = end
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1]
            bounds = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
            yield np.array([digest(joined[a:b], SEED) for a, b in bounds], dtype=np.uint64)
            any_yet, words = True, words[len(words) - size + 1 :]
        held = words
    if held and not any_yet:
        yield np.array([digest(b" ".join(held), SEED)], dtype=np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, from the least on."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; 0 without words."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size):
        n += len(hashes)
        for at in range(0, len(hashes), PIECE_HASHES):
            counts += _bit_counts(hashes[at : at + PIECE_HASHES])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(open_bits: list[int], differing: int) -> list[int]:
    """Masks of two of differing + 2 blocks of the bits; the last blocks are the longer ones."""
    n = differing + 2
    cuts = [len(open_bits) * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in open_bits[cuts[i] : cuts[i + 1]]) for i in range(n)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _finer(mask: Column, table: dict[int, list[int]]) -> Column:
    entries = [x for m, finer in table.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(f)) for f in finer)))]
    return F.explode(F.create_map(*entries)[mask])


def near_pairs(fps: DataFrame, differing: int = DIFFERING, bucket: int = BUCKET) -> DataFrame:
    """a, b (a < b) of the distinct fingerprints in column fp that differ in at most so many bits, each pair once."""
    table = {0: _masks(list(range(64)), differing)}
    members = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    found: DataFrame | None = None
    written: list[DataFrame] = []
    while True:
        # Some masks of finer blocks come from several coarser ones; distinct members count once.
        members = members.select("fp", _finer(F.col("mask"), table).alias("mask")).distinct() if written else members.select("fp", _finer(F.col("mask"), table).alias("mask"))
        members = members.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut(members.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "block_sizes")
        written.append(sizes)
        finest = all(64 - m.bit_count() <= LEAST_BITS for finer in table.values() for m in finer)
        total, most = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
        few = sizes if finest else sizes.where(F.col("c") <= bucket)
        lists = members.join(few, ["mask", "value"]).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"))
        near = lambda a: F.filter("fps", lambda b: (b > a) & (F.bit_count(b.bitwiseXOR(a)) <= differing))
        pairs = lists.select(F.explode(F.flatten(F.transform("fps", lambda a: F.transform(near(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.*")
        found = pairs if found is None else found.unionByName(pairs)
        if finest or most <= bucket:
            break
        members = cut(join_common(members, sizes.where(F.col("c") > bucket), ["mask", "value"], "c", total).select("fp", "mask"), "block_members")
        written.append(members)
        table = {m: [m | f for f in _masks([b for b in range(64) if not m >> b & 1], differing)] for finer in table.values() for m in finer}
    out = cut(found.distinct(), "near_pairs")
    discard(*written)
    return out


def simhash_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, differing: int = DIFFERING) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (the least id reachable by links) and n_links (other fingerprints near its own)."""
    signed = cut(fingerprints(docs, text, doc_id, size), "fingerprints")
    nodes = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprint_nodes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = near_pairs(nodes, differing)
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    roots = connected_components(pairs).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(degrees, "fp", "left")
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "root").select("fp", "n", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return join_common(signed, placed, ["fp"], "n", total).select("doc_id", "fp", "component_id", "n_links")
