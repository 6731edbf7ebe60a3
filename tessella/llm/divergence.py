"""Which terms set a source apart from its language, and how far sources of a language diverge.

Terms are counted inside tasks and added up by language, source and term; a
language keeps the terms of enough of its documents. A group's share of a term
is a smoothed rate in billionths, and the divergence of two rates is a scaled
square, both in whole numbers, so that every figure is exact.

Two sources diverge by a sum over all kept terms, of which most occur in
neither. Those all give the same baseline, which is added once for each kept
term; a term that occurs in one source corrects it by its count alone, so the
counts of a source are a short histogram; only terms that both have are paired.
Ranks are found by radix selection (see ranking).

Edge cases: null text, language and source count as empty; a group without terms
has rates all the same; a language without kept terms has divergence 0 of every
pair and no term rows; a source alone in its language has no pairs; repeated rows
are documents of their own; empty tables give no rows; a very long text is split
in pieces, a very long term is one term; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, text_of
from .naming import join_common
from .ranking import top_k

MIN_DOCUMENTS = 3
TOP = 200
#: Terms of all groups that a task holds before it hands on what it has counted.
HELD_TERMS = 400_000
#: A task counts fewer documents than two to this power.
_DOC_BITS = 24
_ONE_OCCURRENCE = 1 << _DOC_BITS
PIECE_BYTES = 1 << 20
#: A source's pairs are dealt over so many tasks.
DEALT = 32

#: Letters and all bytes beyond ASCII stay, A-Z become a-z, anything else a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    plain, counts, at = text.translate(_TERM_BYTES), Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE_BYTES)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Occurrences and documents of a term share one number: it is a good half smaller than a pair.
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            both = np.fromiter(terms.values(), np.int64, len(terms))
            names = [pa.array([x]).take(pa.array(np.zeros(len(terms), np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(both >> _DOC_BITS), pa.array(both & (_ONE_OCCURRENCE - 1))], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            counts = term_counts(text.as_py())
            if not counts:
                continue
            terms = held.setdefault((lang, source), {})
            before = len(terms)
            seen = terms.get
            for term, n in counts.items():
                terms[term] = seen(term, 0) + (n << _DOC_BITS) + 1
            size += len(terms) - before
            if size > HELD_TERMS:
                yield from handed()
                size = 0
    yield from handed()


def rate(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)) as a long; exact up to 2.8e14 occurrences."""
    size = total + terms
    # 10**9 is 31,250 * 32,000; the second factor follows the first division, so that no product overflows.
    first = (n + 1) * 31_250
    return 1 + F.call_function("div", first, size) * 32_000 + F.call_function("div", (first % size) * 32_000, size)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def rated_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """rated: lang, source, term, p, q for every kept term that occurs in a group, q the language's rate; groups: lang, source, terms (kept by the language), p0 (rate of a term that does not occur)."""
    plain = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text"))
    counted = plain.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # Dealt by language and term, one exchange serves the sums by source and those over all sources, of which a term has few rows.
    sums = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = Window.partitionBy("lang", "term")
    kept = sums.select("lang", "source", "term", "n", F.sum("n").over(everywhere).alias("n_lang"), F.sum("docs").over(everywhere).alias("docs"), F.row_number().over(everywhere.orderBy("source")).alias("k"))
    occurring = cut(kept.where(F.col("docs") >= min_documents).drop("docs"), "occurring")
    langs = occurring.groupBy("lang").agg(F.count_if(F.col("k") == 1).alias("terms"), F.sum("n").alias("total_lang"))
    totals = occurring.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("occurring"))
    zero = F.lit(0).cast("long")
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "occurring", "terms", "total_lang"])
    p0 = F.when(F.col("terms") > 0, rate(zero, F.col("total"), F.col("terms"))).otherwise(1)
    groups = cut(groups.withColumn("p0", p0), "groups")
    n_rows = groups.agg(F.coalesce(F.sum("occurring"), zero)).first()[0]
    facts = groups.where("occurring > 0").drop("p0")
    rated = join_common(occurring, facts, ["lang", "source"], "occurring", n_rows).select("lang", "source", "term", rate(F.col("n"), F.col("total"), F.col("terms")).alias("p"), rate(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"))
    rated = cut(rated, "rated")
    discard(occurring)
    return rated, groups.select("lang", "source", "terms", "p0")


def source_pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (every other source of the language), value (the divergence summed over all kept terms)."""
    deal = F.pmod(F.xxhash64("source"), F.lit(DEALT)).cast("int").alias("deal")
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    met = lambda mine: mine.select("*", deal).join(others, ["lang", "deal"]).where("source <> item")
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    base = met(groups).select("lang", "source", "item", (F.col("terms") * gap(p0, q0)).alias("value"))
    # What occurs in one source only: its rates and how many terms have each.
    histogram = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).join(groups.drop("terms"), ["lang", "source"])
    sides = F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), (F.col("m") * (gap(p, q0) - gap(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (gap(q0, p) - gap(q0, p0))).alias("value")),
    )
    alone = met(histogram).select("lang", F.explode(sides).alias("s")).select("lang", "s.*")
    # Terms of both sources: what the two single corrections leave.
    mine = join_all(rated, groups)
    theirs = mine.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = mine.join(theirs, ["lang", "term"]).where("source < item")
    rest = lambda a, b, a0, b0: gap(a, b) - gap(a, b0) - gap(a0, b) + gap(a0, b0)
    directed = F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), rest(p, q, p0, q0).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), rest(q, p, q0, p0).alias("value")),
    )
    shared = both.select("lang", F.explode(directed).alias("s")).select("lang", "s.*")
    return base.unionByName(alone).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def join_all(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """rated with its group's p0."""
    sizes = rated.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).join(groups.drop("terms"), ["lang", "source"])
    total = rated.count()
    return join_common(rated.drop("q"), sizes, ["lang", "source"], "n", total).drop("n")


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    Part pair: every other source of the language, by divergence. Part term: the
    top terms more frequent in the group than in its language.
    """
    rated, groups = rated_terms(docs, min_documents)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = source_pairs(rated, groups).withColumn("rank", F.row_number().over(order))
    over = rated.where("p > q").select("lang", "source", gap(F.col("p"), F.col("q")).alias("value"), F.col("term").alias("item"))
    terms = top_k(over, ["lang", "source"], "value", "item", top)
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])
