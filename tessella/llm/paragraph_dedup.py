"""Repeated passages by MinHash banding of paragraphs.

Paragraphs are of two kinds, and both are sets of shingles.

Lines of at least LINE_WORDS words, with five-word shingles, have a MinHash
signature in twelve bands of four values, with which a pair at the threshold
misses every bucket once in five hundred times. Lines of a bucket are compared
by exact Jaccard similarity, 0.8 or more, and links join into components.

Sliding paragraphs are all stretches of PASSAGE_WORDS words, wherever lines
break, with shingles of SPAN_WORDS words and one MinHash value, the least
shingle hash (the seed), as their only band: equal stretches have the same one
at the same place. Neighbours mostly share it, so a text has a seed for every
fourteen words. The stretches around a seed are compared as a whole first, by a
hash of all their words; where those differ between the places of a seed, the
words are read again and every stretch is compared by itself. Whatever runs on
without a gap is one passage, so a passage is maximal: each of its stretches
comes at least twice, and the stretch before and the one behind do not. Passages
that share a stretch join into components. Changed words end a passage, so inside
longer lines copies are found where PASSAGE_WORDS words in a row are unchanged.

Of each group the occurrence in the least document stays; the others are marked
for removal. A passage of which a part comes first in one document and a part in
another is reported in such parts.

Edge cases: null and empty texts and texts of fewer words have no paragraph;
rows with equal id and text are one document and one occurrence; a passage that
comes twice in one document is repeated; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import minhash, wordhash
from .common import bucketed, cut, discard
from .components import connected_components, link_buckets

SHINGLE = 5
PERCENT = 80
BANDS = 12
LINE_WORDS = 25
PASSAGE_WORDS = 51
SPAN_WORDS = 25
#: Of a line's bitmap and its sketch; bits that the sketches of two lines at the threshold may differ in: 9.6 on average, and 5 deviations of 3.5.
MAP_WORDS, SKETCH_WORDS, SKETCH_SLACK = 8, 2, 27

#: Lines: start and stop in code points, node the hash of the set. Seeds, which have no bands: start the seed's word, stop the first
#: stretch (by its first word) that has it, n_words the number of these, node the seed, context the hash of all their words.
UNITS = "doc_id long, dk long, start long, stop long, n_words long, node long, context long, n_shingles long, bands array<long>, facts array<long>"


def line_bounds(b: wordhash.Block) -> tuple[np.ndarray, np.ndarray]:
    """First word, and the one after the last, of each line of the block with words."""
    n = len(b.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.concatenate(([0], np.cumsum(b.data == 10)))[b.starts]
    owners = b.owners()
    first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (owners[1:] != owners[:-1]))))
    return first, np.append(first[1:], n)


def seeds(b: wordhash.Block, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every seed: its word, the first stretch that has it and the number of these, all in words of the block, the seed and the context."""
    grams, at = wordhash.windows(words, b.word_offsets, SPAN_WORDS)
    cuts = np.searchsorted(at, b.word_offsets)
    size = PASSAGE_WORDS - SPAN_WORDS + 1
    found = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if j - i >= size:
            seen = np.lib.stride_tricks.sliding_window_view(grams[i:j], size)
            # The leftmost of equal ones, so that a stretch's seed depends on its own words alone.
            chosen, first, n = np.unique(seen.argmin(axis=1) + np.arange(len(seen)), return_index=True, return_counts=True)
            found.append((chosen + i, first + i, n))
    if not found:
        return *(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2))
    chosen, first, n = (np.concatenate(x) for x in zip(*found, strict=True))
    place, begin = at[chosen], at[first]
    contexts = wordhash.sequences(words, begin, begin + n + PASSAGE_WORDS - 1)
    shape = wordhash.mix((place - begin).astype(np.uint64) * np.uint64(64) + n.astype(np.uint64))
    return place, begin, n, grams[chosen], contexts ^ shape


def _array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _array(values.reshape(-1)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """The lines and seeds of docs (doc_id, dk, text), with UNITS as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in wordhash.blocks(batch.column(2), lower=True):
                words = b.words()
                owners = b.owners()
                first, last = line_bounds(b)
                keep = last - first >= LINE_WORDS
                grams, at = wordhash.windows(words, np.append(first, len(words)), SHINGLE)
                first, last = first[keep], last[keep]
                begin = np.searchsorted(at, first)
                sets = [np.unique(grams[i : i + n - SHINGLE + 1]) for i, n in zip(begin.tolist(), (last - first).tolist(), strict=True)]
                signature = minhash.signatures(sets, 2 * BANDS) if sets else np.zeros((0, 4 * BANDS), np.uint64)
                maps, bits = minhash.bitmaps(sets, MAP_WORDS)
                facts = np.concatenate((maps, minhash.sketches(np.pad(signature, ((0, 0), (0, 64 * SKETCH_WORDS // 2 - signature.shape[1])))).view(np.int64), bits[:, None]), axis=1)
                place, stretch, n, seed, context = seeds(b, words)
                point = np.concatenate(([0], np.cumsum(wordhash.LEADS[b.data])))
                whose, seed_of = owners[first], owners[place]
                base, word0 = point[b.offsets[whose]], b.word_offsets[seed_of]
                rows = pa.array(b.rows.start + np.concatenate((whose, seed_of)))
                full, none = len(first), len(place)
                ends = np.concatenate((np.arange(full + 1), np.full(none, full)))
                both = lambda x, y: _array(np.concatenate((x, y)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        both(point[b.starts[first]] - base, place - word0),
                        both(point[b.ends[last - 1]] - base, stretch - word0),
                        both(last - first, n),
                        both(minhash.set_keys(sets)[0], seed),
                        both(np.zeros(full, np.uint64), context),
                        both(np.array([len(s) for s in sets], dtype=np.int64), np.zeros(none, np.int64)),
                        _lists(ends * BANDS, minhash.band_keys(signature, BANDS)),
                        _lists(ends * facts.shape[1], facts),
                    ],
                    names=[x.split()[0] for x in UNITS.split(", ")],
                )

    return docs.select("doc_id", "dk", "text").mapInArrow(run, UNITS)


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the wanted lines (dk, start, stop), read again from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in wordhash.blocks(batch.column(0), lower=True):
                own = [s for s in minhash.shingle_sets(b, SHINGLE) if len(s)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in own], dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([_array(minhash.set_keys(own)[0]), _lists(ends, np.concatenate(own) if own else np.zeros(0, np.uint64))], names=["node", "shingles"])

    lines = docs.select("dk", "text").join(wanted, "dk").select(F.expr("substring(text, int(start) + 1, int(stop - start))"))
    return lines.mapInArrow(run, "node long, shingles array<long>")


def similar_lines(lines: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The lines that come more than once, equal or similar; classes has a row for each set of shingles."""
    place = F.struct("doc_id", "dk", "start", "stop")
    names = [f"m{i}" for i in range(MAP_WORDS)] + [f"s{i}" for i in range(SKETCH_WORDS)] + ["bits"]
    members = classes.select("node", F.explode("bands").alias("key"))
    traits = classes.select("node", "n", *(F.col("facts")[i].alias(name) for i, name in enumerate(names)))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = members.join(shared, "key", "left_semi").select("node").distinct()
    wanted = classes.join(met, "node", "left_semi").select("first.dk", "first.start", "first.stop")
    sets = cut(line_sets(docs, wanted).dropDuplicates(["node"]), "paragraph_sets")
    roots = link_buckets(members, traits, minhash.verifier(sets, PERCENT), minhash.similar_enough(PERCENT, SKETCH_WORDS, SKETCH_SLACK, MAP_WORDS))
    discard(sets)
    # The least and the greatest place of a class tell whether it has two.
    placed = classes.select("node", "first", "last").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    totals = placed.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last")
    repeated = placed.select("node", "root").join(totals.select("root", "first"), "root")
    found = lines.join(repeated, "node")
    return found.select("doc_id", "start", "stop", "n_words", F.lit("line").alias("kind"), F.col("root").alias("component_id"), F.col("first.doc_id").alias("first_doc_id"), (place == F.col("first")).alias("kept")).distinct()


def stretches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, context and the hashes of the stretches of the wanted contexts (dk, start, stop, n_words, node, context), read again from their documents."""
    fields = ("start", "stop", "n_words", "node", "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            of = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            _, begin, n, node, context = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(len(fields)))
            row = np.repeat(np.arange(batch.num_rows), of)
            for b in wordhash.blocks(batch.column(0), lower=True):
                mine = np.flatnonzero((row >= b.rows.start) & (row < b.rows.stop))
                ends = np.concatenate(([0], np.cumsum(n[mine])))
                within = np.arange(ends[-1]) - np.repeat(ends[:-1], n[mine])
                at = np.repeat(begin[mine] + b.word_offsets[row[mine] - b.rows.start], n[mine]) + within
                hashes = wordhash.sequences(b.words(), at, at + PASSAGE_WORDS)
                yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(context[mine]), _lists(ends, hashes)], names=["node", "context", "hashes"])

    # A document's list is no longer than its text.
    per_doc = wanted.groupBy("dk").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    return docs.select("dk", "text").join(per_doc, "dk").select("text", "wanted").mapInArrow(run, "node long, context long, hashes array<long>")


def points(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (dk, first and last stretch and more) with start and stop in code points and n_words."""
    own = [c for c in runs.columns if c not in ("dk", "first", "last")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for b in wordhash.blocks(batch.column(0)):
                mine = np.flatnonzero((row >= b.rows.start) & (row < b.rows.stop))
                of = row[mine] - b.rows.start
                point = np.concatenate(([0], np.cumsum(wordhash.LEADS[b.data])))
                base, word0 = point[b.offsets[of]], b.word_offsets[of]
                start = point[b.starts[first[mine] + word0]] - base
                stop = point[b.ends[last[mine] + word0 + PASSAGE_WORDS - 1]] - base
                yield pa.RecordBatch.from_arrays([_array(start), _array(stop), _array(last[mine] - first[mine] + PASSAGE_WORDS), *(flat.field(2 + i).take(pa.array(mine)) for i in range(len(own)))], names=["start", "stop", "n_words", *own])

    per_doc = runs.groupBy("dk").agg(F.collect_list(F.struct("first", "last", *own)).alias("runs"))
    schema = ", ".join(["start long, stop long, n_words long", *(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields if f.name in own)])
    return docs.select("dk", "text").join(per_doc, "dk").select("text", "runs").mapInArrow(run, schema)


def shared_seeds(units: DataFrame) -> DataFrame:
    """The seeds that stand in more than one place."""
    every = units.where(F.size("bands") == 0).select("doc_id", "dk", "start", "stop", "n_words", "node", "context")
    spot = F.xxhash64("dk", "start")
    # As a table of its own, so that the join can split the rows of a very common seed.
    twice = cut(every.groupBy("node").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).where("x <> y").select("node"), "shared_seeds")
    return every.join(twice, "node")


def equal_stretches(single: DataFrame) -> DataFrame:
    """node, context and marks (at, n, keeper): runs of stretches of a context that have their least place around one seed, and come twice.

    single: node, context, at (number of the stretch), place (words before the seed), stretch (its hash), keeper and last (the
    context's least and greatest place).
    """
    equal = single.groupBy("node", "place", "stretch").agg(F.min("keeper").alias("keeper"), F.max("last").alias("last")).where("keeper <> last").drop("last")
    marked = single.select("node", "context", "place", "stretch", "at").join(equal, ["node", "place", "stretch"]).select("node", "context", "at", "keeper")
    # All that follows stays with node and context.
    marked = marked.repartition("node", "context")
    run = F.col("at") - F.row_number().over(Window.partitionBy("node", "context", "keeper").orderBy("at"))
    runs = marked.withColumn("run", run).groupBy("node", "context", "keeper", "run").agg(F.min("at").cast("long").alias("at"), F.count(F.lit(1)).alias("n"))
    # As many marks as a context has stretches, 27 at most.
    return runs.groupBy("node", "context").agg(F.collect_list(F.struct("at", "n", "keeper")).alias("marks"))


def equal_passages(live: DataFrame, docs: DataFrame) -> DataFrame:
    """The maximal passages of which every stretch of PASSAGE_WORDS words comes more than once; live: the shared seeds."""
    contexts = live.groupBy("node", "context").agg(F.min(F.struct("doc_id", "dk", "start")).alias("keeper"), F.max(F.struct("doc_id", "dk", "start")).alias("last"), F.first("n_words").alias("n_words"), F.first(F.col("start") - F.col("stop")).alias("ahead"))
    several = contexts.groupBy("node").agg((F.count(F.lit(1)) > 1).alias("several"))
    contexts = cut(contexts.join(several, "node"), "passage_contexts")
    # One context: it comes twice as a whole. Several: each stretch by itself.
    whole = contexts.where("not several and keeper <> last").select("node", "context", F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n_words").alias("n"), "keeper")).alias("marks"))
    wanted = contexts.where("several").select("keeper.dk", "keeper.start", (F.col("keeper.start") - F.col("ahead")).alias("stop"), "n_words", "node", "context")
    hashes = stretches(docs, wanted).join(contexts.select("node", "context", "ahead", "keeper", "last"), ["node", "context"])
    single = hashes.select("node", "context", "ahead", "keeper", "last", F.posexplode("hashes").alias("at", "stretch")).withColumn("place", F.col("ahead") - F.col("at"))
    single = cut(single.drop("ahead"), "passage_stretches")
    marks = cut(whole.union(equal_stretches(single)), "passage_marks")
    discard(single, contexts)
    found = live.join(marks, ["node", "context"]).select("doc_id", "dk", "start", "stop", F.explode("marks").alias("m"))
    # The keeper's stretch lies as far before its seed as this one.
    spots = found.select("doc_id", "dk", (F.col("stop") + F.col("m.at")).alias("q"), F.col("m.n").alias("n"), F.col("m.keeper.doc_id").alias("k_doc"), F.col("m.keeper.dk").alias("k_dk"), (F.col("m.keeper.start") - F.col("start") + F.col("stop") + F.col("m.at")).alias("k_q"))
    spots = spots.repartition("dk").dropDuplicates(["dk", "q"]).withColumn("kept", (F.col("k_dk") == F.col("dk")) & (F.col("k_q") == F.col("q")))
    order = Window.partitionBy("dk").orderBy("q")
    before = F.lag(F.struct((F.col("q") + F.col("n")).alias("end"), "kept")).over(order)
    begins = spots.withColumn("before", before).withColumn("new", F.when((F.col("before.end") >= F.col("q")) & (F.col("before.kept") == F.col("kept")), 0).otherwise(1))
    numbered = cut(begins.withColumn("run", F.sum("new").over(order)).drop("before", "new"), "passage_spots")
    discard(marks)
    runs = numbered.groupBy("dk", "run").agg(F.min("doc_id").alias("doc_id"), F.min("q").alias("first"), (F.max(F.col("q") + F.col("n")) - 1).alias("last"), F.first("kept").alias("kept"), F.min(F.struct("k_doc", "k_dk", "k_q")).alias("k"))
    runs = cut(runs.withColumn("node", F.xxhash64("dk", "first")), "passage_runs")
    # One link for each run and document that keeps a part of it.
    away = numbered.where("not kept").groupBy("dk", "run", "k_dk", (F.col("k_q") - F.col("q")).alias("shift")).agg(F.min("k_q").alias("k_q"))
    away = away.join(runs.select("dk", "run", F.col("node").alias("a")), ["dk", "run"]).select("a", "k_dk", "k_q")
    keepers = runs.where("kept").select(F.col("dk").alias("k_dk"), "first", "last", F.col("node").alias("b"))
    links = away.join(keepers, "k_dk").where("k_q between first and last").select("a", "b")
    roots = connected_components(links)
    discard(numbered)
    placed = runs.join(roots, "node", "left").select("dk", "first", "last", "doc_id", F.coalesce("root", "node").alias("component_id"), F.col("k.k_doc").alias("first_doc_id"), "kept")
    return points(docs, placed).select("doc_id", "start", "stop", "n_words", F.lit("passage").alias("kind"), "component_id", "first_doc_id", "kept")


def repeated_paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, stop (code points), n_words, kind (line or passage), component_id (a hash), first_doc_id, kept of every paragraph that is repeated."""
    keyed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("dk"), F.col(f"`{text}`").cast("string").alias("text"))
    table = bucketed(keyed.where("text is not null"), "dk")
    units = cut(paragraphs(table), "paragraphs")
    live = cut(shared_seeds(units), "passage_seeds")
    of_lines = units.where(F.size("bands") > 0)
    place = F.struct("doc_id", "dk", "start", "stop")
    classes = cut(of_lines.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("facts").alias("facts"), F.min(place).alias("first"), F.max(place).alias("last")), "paragraph_classes")
    lines = cut(of_lines.select("doc_id", "dk", "start", "stop", "n_words", "node"), "paragraph_lines")
    discard(units)
    repeated = cut(similar_lines(lines, classes, table), "repeated_lines")
    discard(lines, classes)
    passages = cut(equal_passages(live, table), "repeated_passages")
    discard(live)
    return repeated.union(passages)
