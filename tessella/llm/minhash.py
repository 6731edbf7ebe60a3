"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its least
and its greatest, so half the hash evaluations serve the same number of values.
Bands of values make buckets; documents of a bucket are compared on their full
shingle sets, and links join into components.

Equal shingle sets form one class and are compared once. Two sets count as
equal if their sizes and two hashes of 64 bits agree; sets that share the first
hash only stay apart. Shingles are compared by 64-bit hashes.

With 24 bands of 4 values a pair at the threshold of 0.8 misses every bucket
with probability (1 - 0.8**4)**24, about 3 in a million, and closer pairs less.
Pairs of a bucket are read in full only if their sketches are near: a pair at
the threshold fails that with a probability below one in a million (five
deviations), closer ones far less often. Sizes and bitmaps give exact bounds.

Edge cases: null, empty and wordless texts have no shingles, link with nothing
and are kept; a text shorter than a shingle is one shingle; repeated rows belong
to one class, the row with the least id is kept (all of them if the id repeats);
a row without id never stands for others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import cut, discard
from .components import link_buckets

SHINGLE = 5
#: Linked at so many hundredths of Jaccard similarity.
PERCENT = 80
PERMUTATIONS = 64
BANDS = 24
BAND_VALUES = 4
#: Sketch bits in which two documents at the threshold may differ: 25.6 on average, and 5 deviations of 5.8.
SKETCH_WORDS = 4
SKETCH_SLACK = 55
#: 64-bit words of a set's bitmap.
MAP_WORDS = 32

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_BAND_FACTORS = _random.integers(0, 1 << 64, BAND_VALUES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(b: wordhash.Block, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text of the block, sorted."""
    words = b.words()
    grams, at = wordhash.windows(words, b.word_offsets, size)
    cuts = np.searchsorted(at, b.word_offsets)
    sets = []
    for i in range(b.n):
        first, last = b.word_offsets[i], b.word_offsets[i + 1]
        if last - first >= size:
            sets.append(np.unique(grams[cuts[i] : cuts[i + 1]]))
        elif last > first:
            whole = np.uint64(last - first)
            for w in words[first:last]:
                whole = wordhash.mix(np.array([whole ^ w], dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))[0]
            sets.append(np.array([whole], dtype=np.uint64))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set, of which none must be empty."""
    if not sets:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    x = wordhash.mix(np.concatenate(sets))
    node = wordhash.mix(np.add.reduceat(x, starts) + sizes * np.uint64(0x9E3779B97F4A7C15))
    # Independent of the sum of x: the values are mixed again under another constant.
    check = wordhash.mix(np.add.reduceat(wordhash.mix(x ^ np.uint64(0xA24BAED4963EE407)), starts))
    return node, check


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """For each set, which must not be empty: least and greatest value under each permutation."""
    x = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * permutations), dtype=np.uint64)
    for k in range(permutations):
        v = x * _FACTORS[k] + _SHIFTS[k]
        out[:, 2 * k] = np.minimum.reduceat(v, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, starts)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    keys = np.empty((len(signature), bands), dtype=np.uint64)
    for j in range(bands):
        part = signature[:, BAND_VALUES * j : BAND_VALUES * (j + 1)]
        keys[:, j] = wordhash.mix((part * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) ^ np.uint64(j + 1))
    return keys


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each of the 128 signature values, in four 64-bit words."""
    bits = (wordhash.mix(signature)[:, :, None] >> np.array([11, 37], dtype=np.uint64)) & np.uint64(1)
    return np.ascontiguousarray(np.packbits(bits.reshape(len(signature), 2 * signature.shape[1]).astype(np.uint8), axis=1)).view(np.uint64)


def bitmaps(sets: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set in so many 64-bit words, and how many of its bits are set."""
    bits = np.zeros((len(sets), 64 * words), dtype=np.uint8)
    if sets:
        values = np.concatenate(sets)
        bits[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), ((values >> np.uint64(20)) % np.uint64(64 * words)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64), bits.sum(axis=1, dtype=np.int64)


def _shingled(text: str, size: int, rows: str, schema: str, made, docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in wordhash.blocks(batch.column(1), lower=True):
                yield from made(batch.column(0).slice(b.rows.start, b.n), shingle_sets(b, size))

    return docs.select(F.col(f"`{rows}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def sign_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, node and check (hashes of the set; null if empty), bands, sketch."""

    def made(ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        full = np.array([len(s) > 0 for s in sets], dtype=bool)
        keys, checks = np.zeros((2, len(sets)), dtype=np.uint64)
        bands = np.zeros((len(sets), BANDS), dtype=np.uint64)
        sketch = np.zeros((len(sets), SKETCH_WORDS), dtype=np.uint64)
        if full.any():
            own = [s for s in sets if len(s)]
            signature = signatures(own)
            keys[full], checks[full] = set_keys(own)
            bands[full], sketch[full] = band_keys(signature), sketches(signature)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys.view(np.int64), mask=~full), pa.array(checks.view(np.int64), mask=~full), lists(bands), lists(sketch)], names=["doc_id", "n_shingles", "node", "check", "bands", "sketch"])

    return _shingled(text, size, doc_id, "doc_id long, n_shingles long, node long, check long, bands array<long>, sketch array<long>", made, docs)


def sets_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """node, n, check, shingles (distinct hashes) and a bitmap of them, of documents with any."""

    def made(ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = [s for s in sets if len(s)]
        lengths = np.concatenate(([0], np.cumsum([len(s) for s in own], dtype=np.int64)))
        values = np.concatenate(own) if own else np.zeros(0, np.uint64)
        keys, checks = set_keys(own)
        maps, bits = bitmaps(own, MAP_WORDS)
        lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(np.diff(lengths)), pa.array(checks.view(np.int64)), lists(lengths, values.view(np.int64)), lists(np.arange(len(own) + 1) * MAP_WORDS, maps.reshape(-1)), pa.array(bits)],
            names=["node", "n", "check", "shingles", "map", "bits"],
        )

    return _shingled(text, size, doc_id, "node long, n long, check long, shingles array<long>, map array<long>, bits long", made, docs)


def verifier(sets: DataFrame, percent: int):
    """Keeps the pairs of nodes whose full sets are similar enough."""

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return both.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")

    return verify


def similar_enough(percent: int, sketch_words: int = SKETCH_WORDS, slack: int = SKETCH_SLACK, map_words: int = 0):
    """Sizes near each other and, with columns of a small bitmap, its bound, which every linked pair meets; and few sketch bits apart, which all but one in a million of linked pairs are."""

    def condition(a: str, b: str) -> Column:
        small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
        apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(sketch_words)), F.lit(0))
        fits = (100 * small >= percent * large) & (apart <= slack)
        if map_words:
            fits &= _enough(a, b, sum((F.bit_count(F.col(f"{a}.m{i}").bitwiseAND(F.col(f"{b}.m{i}"))) for i in range(map_words)), F.lit(0)), percent)
        return fits

    return condition


def bitmap_bound(percent: int):
    """What every linked pair meets: shingles whose bit the other lacks are not shared, and so many may not be."""

    def condition(a: str, b: str) -> Column:
        # An interpreted loop: 32 unrolled words would make a join that takes the JVM's compiler gigabytes.
        both = F.aggregate(F.zip_with(f"{a}.map", f"{b}.map", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda x, y: x + y)
        return _enough(a, b, both, percent)

    return condition


def _enough(a: str, b: str, both: Column, percent: int) -> Column:
    """Whether so many common bits, and the shingles that share bits, allow the similarity."""
    most = both + F.least(F.col(f"{a}.n") - F.col(f"{a}.bits"), F.col(f"{b}.n") - F.col(f"{b}.bits"))
    return 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def second_sets(classes: DataFrame) -> DataFrame | None:
    """Of different sets with one node all but the first, with a node of their own; None if there are none, as nearly always."""
    least = classes.groupBy("node").agg(F.min(F.struct("n", "check")).alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    twins = cut(least, "twins")
    if twins.isEmpty():
        return None
    others = classes.join(twins, "node").where((F.col("n") != F.col("least.n")) | (F.col("check") != F.col("least.check")))
    return cut(others.select("node", "n", "check", F.xxhash64("node", "n", "check").alias("own")), "twins")


def apart(sets: DataFrame, twins: DataFrame | None) -> DataFrame:
    """sets (node, n, check and more) with the nodes that twins gives."""
    if twins is None:
        return sets
    return sets.join(twins, ["node", "n", "check"], "left").withColumn("node", F.coalesce("own", "node")).drop("own")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the least id reachable by links) and kept."""
    signed = cut(sign_documents(docs, text, doc_id, size), "signed")
    classes = cut(signed.where("node is not null").groupBy("node", F.col("n_shingles").alias("n"), "check").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    slim = cut(signed.select("doc_id", "n_shingles", "node", "check"), "signed")
    discard(signed)
    twins = second_sets(classes)
    classes = apart(classes, twins)
    members = classes.select("node", F.explode("bands").alias("key"))
    traits = classes.select("node", "n", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = members.join(shared, "key", "left_semi").select("node").distinct()
    wanted = classes.select("node", "rep").join(met, "node", "left_semi").select(F.col("rep").alias(doc_id)).distinct()
    read_again = apart(sets_of(docs.join(wanted, doc_id, "left_semi"), text, doc_id, size), twins)
    sets = cut(read_again.dropDuplicates(["node"]), "sets")
    roots = link_buckets(members, traits, verifier(sets, percent), similar_enough(percent), sets.select("node", "map", "bits"), bitmap_bound(percent))
    placed = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = placed.join(least, "root").select("node", "component_id")
    found = apart(slim.withColumnRenamed("n_shingles", "n"), twins).join(component, "node", "left")
    found = found.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
