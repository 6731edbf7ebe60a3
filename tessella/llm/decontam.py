"""Benchmark decontamination with one Aho-Corasick automaton.

The normalised test items, questions and answers alike, become sequences of word
numbers. The automaton holds five words at every sixth place of an item: each
window of ten consecutive words has five of these in it as a whole. Each text is
read once; where the five occur, the run of words that text and item share is
followed to both ends, and if it has ten words or more, all of them lie in
windows. An item of fewer than ten words is in the automaton as a whole. Hits
are mapped back to word numbers and to offsets of the original text.

An automaton has about one node, and the item one number, for each word of the
benchmark. One automaton takes AUTOMATON_WORDS words; a larger benchmark
is dealt into tables of that size, which are scanned one after the other.

Edge cases: null and wordless texts have no words and no hits; a wordless item
has no window; an item without id is left out; equal items are each reported;
repeated document rows are each answered; an empty benchmark leaves every
document clean. Other columns of the documents pass through; one with the name
of an added column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh

WINDOW = 10
#: Words of the pieces that the automaton holds.
SEED = 5
#: Words of the items that one automaton, and so one broadcast, may hold: some 150 MB in a worker.
AUTOMATON_WORDS = 1_000_000

#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ADDED = "n_words long, n_hit long, items array<bigint>, spans array<struct<start:bigint,stop:bigint>>"

Items = list[tuple[int, str | None]]


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Windows:
    """The windows of n words of all items, and where they occur in a text."""

    def __init__(self, items: Items, n: int = WINDOW):
        self.n, self.seed = n, max(1, min(SEED, n))
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[int, tuple[int, ...]]] = []
        held: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text))
            if not words:
                continue
            index = len(self.items)
            self.items.append((item_id, words))
            if len(words) < n:
                held.setdefault(words, []).append((index, 0))
            else:
                for at in range(0, len(words) - self.seed + 1, n - self.seed + 1):
                    held.setdefault(words[at : at + self.seed], []).append((index, at))
        self.automaton = None
        if held:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, places in held.items():
                self.automaton.add_word(key, (len(key), places))
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        found: set[int] = set()
        text = tuple(map(self.numbers.get, words, [0] * len(words))) if self.automaton else ()
        if any(text):
            reached: dict[tuple[int, int], int] = {}  # by item and how far it is shifted: where the last run ends
            for end, (size, places) in self.automaton.iter(text):
                begin = end - size + 1
                for index, at in places:
                    item_id, own = self.items[index]
                    if reached.get((index, begin - at), 0) > begin:
                        continue
                    a, b = 0, size
                    while a < at and a < begin and own[at - a - 1] == text[begin - a - 1]:
                        a += 1
                    while at + b < len(own) and begin + b < len(text) and own[at + b] == text[begin + b]:
                        b += 1
                    reached[index, begin - at] = begin + b
                    if a + b >= min(self.n, len(own)):
                        edges[begin - a] += 1
                        edges[begin + b] -= 1
                        found.add(item_id)
        return np.cumsum(edges)[: len(words)] > 0, found


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges of the runs of hit words in the text as it is."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.frombuffer(_NORMAL, dtype=np.uint8)[data] != 32
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts, stops = point[np.flatnonzero(edges == 1)], point[np.flatnonzero(edges == -1)]
    runs = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [(int(starts[a]), int(stops[b - 1])) for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


_built: dict[str, object] = {}


def _windows(shared, n: int) -> Windows:
    """Built once in each Python worker for a broadcast."""
    items = shared.value
    if not _built or _built["of"] != (items, n):
        _built.update(of=(items, n), windows=Windows(items, n))
    return _built["windows"]


def _scan(docs: DataFrame, items: Items, text: str, n: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most AUTOMATON_WORDS words
    (copy,) = fresh(docs, "__text")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared, n)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                value = value.as_py() or ""
                words = normal_words(value)
                hit, found = windows.hits(words)
                n_hit = int(hit.sum())
                rows.append((len(words), n_hit, sorted(found), [{"start": a, "stop": b} for a, b in original_spans(value, hit)] if n_hit else []))
            added = [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "n_words", "n_hit", "items", "spans"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), ADDED])
    return docs.withColumn(copy, F.col(f"`{text}`").cast("string")).mapInArrow(scanned, schema)


def _merged(answers: DataFrame, row: str, text: str, every: str, items: str) -> DataFrame:
    """The answers of several scans for a row as one; n_hit is counted again in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, counts = [], []
            for value, found in zip(batch.column(1), batch.column(2), strict=True):
                runs: list[list[int]] = []
                for s in found.as_py():
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["stop"])
                    else:
                        runs.append([s["start"], s["stop"]])
                spans.append([{"start": a, "stop": b} for a, b in runs])
                counts.append(sum(len(normal_words((value.as_py() or "")[a:b])) for a, b in runs))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(counts, pa.int64()), batch.column(3), pa.array(spans, kind)], names=[row, "n_words", "n_hit", "items", "spans"])

    return answers.select(row, F.col(f"`{text}`").cast("string"), every, items, "n_words").mapInArrow(run, f"`{row}` long, {ADDED}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids with occurring windows) and spans (original code point ranges of hits)."""
    added = {"n_words", "n_hit", "items", "spans"}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added and c != text))
    # No item has more words than bytes; one with more than an automaton takes is a table of its own.
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("id is not null")
    size = F.coalesce(F.size(F.split("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= automaton_words:
        return _scan(docs, [tuple(r) for r in items.collect()], text, n)
    parts = -(-2 * total // automaton_words)
    dealt = cut(items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts))), "benchmark")
    row, every, found = fresh(docs, "__row", "__spans", "__items")
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    slim = docs.select(row, text)
    answers = [cut(_scan(slim, [tuple(r) for r in dealt.where(F.col("part") == part).select("id", "text").collect()], text, n).where("n_hit > 0").select(row, "items", "spans"), "hits") for part in range(parts)]
    union = answers[0]
    for more in answers[1:]:
        union = union.unionByName(more)
    discard(dealt)
    together = union.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(found), F.array_sort(F.flatten(F.collect_list("spans"))).alias(every))
    counted = _scan(slim, [], text, n).select(row, text, "n_words").join(together, row, "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    merged = _merged(counted.withColumns({found: F.coalesce(found, F.array().cast("array<bigint>")), every: F.coalesce(every, none)}), row, text, every, found)
    return docs.join(merged, row).drop(row)
