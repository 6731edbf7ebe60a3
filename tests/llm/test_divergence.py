import random
import re
from collections import Counter

import oracle
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessella.llm import divergence, queries, ranking

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=3, top=200):
    counts, docs = {}, {}
    for lang, source, text in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(found)
        docs.setdefault(lang or "", Counter()).update(found.keys())
    out = []
    for lang, sources in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def rates(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q, p = rates(sum(sources.values(), Counter())), {s: rates(c) for s, c in sources.items()}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r["item"], r["value"], r["rank"]) for r in df.collect())


def test_query_like_its_sql(spark):
    name = "op13_source_divergence"
    assert oracle.differences(spark, oracle.connect(SF), queries.op13_source_divergence, queries.oracle_sql()[name], SF) is None


def test_query_like_brute_force(spark):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op13_source_divergence(spark, SF)) == brute_force(rows)


def test_awkward_documents(spark, awkward, empty):
    rows = [(r.lang, r.source, r.text) for r in awkward.select("lang", "source", "text").collect()]
    assert found(divergence.source_divergence(awkward, 2, 5)) == brute_force(rows, 2, 5)
    assert divergence.source_divergence(empty).collect() == []


def test_groups_without_terms_and_hot_sources(spark):
    """Wordless groups still pair; a language without kept terms diverges by 0; one source holds a third of all rows; a term of a million bytes."""
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice(["", "É", "漢", "x"])
    rows = [("en", rng.choice(["s1", "s2", None, "é"]), " ".join(word() for _ in range(rng.randrange(30)))) for _ in range(120)]
    rows += [("en", "hot", "A b. c-d " * 40)] * 60 + [("en", "blank", None), ("en", "blank", "123"), ("zz", "a", "x"), ("zz", "b", "y"), ("zz", "c", None), (None, "alone", "w w w")]
    rows += [("en", "s1", "y" * 1_000_000 + " Z")] * 3
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (lang, s, t) in enumerate(rows)], DOCS)
    assert found(divergence.source_divergence(df, 3, 20)) == brute_force(rows, 3, 20)


def test_counts_handed_on_early(monkeypatch):
    """What a task holds is bounded; parts add up to the same counts."""
    import pyarrow as pa

    texts = ["a b a", "b c", None, "", "d é e", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 6), pa.array(["x", "y"] * 3), pa.array([t or "" for t in texts])], names=["lang", "source", "text"])

    def sums():
        total = Counter()
        for part in divergence._count(iter([batch, batch])):
            for r in part.to_pylist():
                total[r["source"], r["term"], "n"] += r["n"]
                total[r["source"], r["term"], "docs"] += r["docs"]
        return total

    whole = sums()
    monkeypatch.setattr(divergence, "HELD_TERMS", 1)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 2)
    assert sums() == whole


@pytest.mark.parametrize("close", [0, 3])
def test_top_k_of_ties(spark, close):
    """Ties in the value are broken by bytes, after a long common start; groups of under k rows keep all."""
    rng = random.Random(9)
    rows = [("ties", 5, "é" * 300 + str(i)) for i in range(90)] + [("ties", 7, "top")]
    rows += [("few", rng.getrandbits(60), str(i)) for i in range(6)]
    rows += [("many", rng.choice([0, 255, 256, 1 << 40, (1 << 40) + 1, 1 << 59]), f"t{i}") for i in range(200)]
    rows += [("byte", 1, x) for x in ("a", "ab", "abc", "b", "é", "z", "漢", "", "aa", "\U0001f600", "￿")]
    df = spark.createDataFrame(rows, "g string, v long, t string")
    want = [(g, v, t, i + 1) for g in {r[0] for r in rows} for i, (_, v, t) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:10])]
    got = [(r.g, r.value, r["item"], r["rank"]) for r in ranking.top_k(df, ["g"], "v", "t", 10, close).collect()]
    assert sorted(got) == sorted(want)


def test_rates_of_large_counts(spark):
    rows = [(0, 1, 1), (0, 0, 1), (10**13, 2 * 10**14, 10**7), (2 * 10**14, 2 * 10**14, 1), (7, 10**9, 3)]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    got = [r[0] for r in df.select(divergence.rate(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (total + v) for n, total, v in rows]
