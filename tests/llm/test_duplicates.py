import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessella.llm import components, line_dedup, minhash, paragraph_dedup, queries

from .conftest import DOCS, variant

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute_components(texts, size, percent=80):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (60, 90), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 40)]
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        label = {x: x for e in edges for x in e}
        while True:
            new = dict(label)
            for a, b in edges:
                new[a] = new[b] = min(new[a], new[b])
            if new == label:
                break
            label = new
        assert got == {x: r for x, r in label.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_near_duplicates_like_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_near_duplicates(spark, SF).collect()}
    assert got == brute_components(docs, 4)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = variant(1, 120).split()
    texts = {}
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts[i] = " ".join(words)
    texts |= {1000 + i: variant(i + 50) for i in range(50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, size=5).collect()}
    assert got == brute_components(texts, 5)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(x[:2500]), np.unique(x[500:])
    s = minhash.signatures([a, b])
    assert (s[0] == s[1]).mean() == pytest.approx(2000 / 3000, abs=0.15)


def test_awkward_near_duplicates(spark, awkward, empty):
    got = minhash.near_duplicates(awkward).toPandas()
    assert len(got) == 12
    by = got.dropna(subset=["doc_id"]).groupby("doc_id").component_id.first()
    assert by[5] == 4
    assert by[7] == 6
    assert by[1] == 1
    assert by[2] == 2
    assert got[got.doc_id.isna()].kept.all()
    assert minhash.near_duplicates(empty).count() == 0


def test_lines(spark):
    long = " ".join(f"longword{i}" for i in range(40))
    edited = long.replace("longword7 ", "longword7x ")
    rows = [(1, f"{long}\nsmall line\nown {variant(1, 9)}"), (2, f"own {variant(2, 9)}\nsmall line\n{long.upper()}!"), (3, f"{long}\n{long}"), (4, None), (5, ""), (6, edited)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 3, 0)
    assert got[2] == (f"own {variant(2, 9)}\nsmall line", 3, 1)
    assert got[3] == ("", 2, 2)
    assert got[4] == (None, 0, 0)
    assert got[5] == ("", 1, 0)
    assert got[6] == ("", 1, 1)


def test_no_equal_line_is_left(spark):
    got = queries.op3_line_dedup(spark, SF).collect()

    def normal(line):
        return tuple(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()) if w)

    def lines(texts):
        return Counter(n for t in texts for n in map(normal, (t or "").split("\n")) if len(n) >= 5)

    after, before = lines(r.text for r in got), lines(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert max(after.values()) == 1
    fuzzy = len(before) - len(after)
    assert 0 <= fuzzy < 0.05 * len(before)


def test_no_equal_short_line_is_left(spark):
    def short(rows):
        words = (tuple(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower()) if w) for r in rows for x in (r.text or "").split("\n"))
        return Counter(w for w in words if 0 < len(w) < 5)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = short(docs.collect()), short(queries.op3_line_dedup(spark, SF).collect())
    assert max(before.values()) > 1
    assert before.keys() == after.keys()
    assert max(after.values()) == 1
    piped = short(corpus_pipeline.lines(spark, docs, SF).collect())
    assert max(piped.values()) == 1


def test_similar_lines_like_brute_force(spark):
    raw = [(x,) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for x in (r.text or "").split("\n")]
    norm = F.array_join(line_dedup.words_of(F.col("raw")), " ")
    found = spark.createDataFrame(raw, "raw string").select(norm.alias("x")).where("size(split(x, ' ')) >= 5 and length(x) <= 400").distinct().cache()
    pairs = found.crossJoin(F.broadcast(found.select(F.col("x").alias("y")))).where("x < y and least(length(x), length(y)) >= 0.8 * greatest(length(x), length(y))")
    links = pairs.repartition(32).where("levenshtein(x, y, int(floor(greatest(length(x), length(y)) * 20 / 100))) >= 0").collect()
    got = queries.op3_line_dedup(spark, SF).collect()
    left = {" ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower()) if w) for r in got for x in (r.text or "").split("\n")}
    missed = [r for r in links if r.x in left and r.y in left]
    print(len(links), "links", len(missed), "missed")
    assert len(links) > 10
    assert len(missed) <= 0.05 * len(links), missed[:5]


def test_one_changed_word_is_found(spark):
    rng = random.Random(11)
    rows = []
    for i in range(100):
        words = [f"{rng.randrange(1 << 28):07x}" for _ in range(12)]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(12)] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed} <= set(range(1, 200, 2))
    assert sum(r.n_removed for r in got) >= 95


@pytest.mark.parametrize("n_words", [5, 6, 8, 12, 20])
def test_recall_of_one_changed_word(spark, n_words):
    """At least nine of ten pairs that brute force links are found, however short the lines."""
    rng = random.Random(n_words)
    pairs = []
    for _ in range(150):
        words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(4, 10))) for _ in range(n_words)]
        other = list(words)
        i = rng.randrange(n_words)
        other[i] = other[i][: max(2, len(other[i]) - 3)] + "xyz"
        pairs.append((" ".join(words), " ".join(other)))
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    near = spark.createDataFrame(pairs, "x string, y string").selectExpr("levenshtein(x, y) <= 0.2 * greatest(length(x), length(y)) as near").collect()
    gone = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_removed}
    links = [i for i, r in enumerate(near) if r.near]
    print(n_words, len(links), sum(2 * i + 1 in gone for i in links))
    assert len(links) > 100
    assert gone <= {2 * i + 1 for i in links}
    assert sum(2 * i + 1 in gone for i in links) >= 0.9 * len(links)


def test_gram_bound_loses_nothing(spark):
    """Pairs within the distance share as many grams as the bound asks, whatever the edits."""
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        x = [rng.choice("abcde fgé") for _ in range(rng.randrange(3, 60))]
        y = list(x)
        for _ in range(rng.randrange(len(x) // 5 + 1)):
            i = rng.randrange(len(y))
            y[i : i + rng.choice([0, 1])] = rng.choice([[], ["z"], ["a"]])
        rows.append(("".join(x), "".join(y)))
    got = spark.createDataFrame(rows, "x string, y string").selectExpr("x", "y", "levenshtein(x, y) as d").select("d", line_dedup.grams(F.col("x")).alias("a"), line_dedup.grams(F.col("y")).alias("b")).where("a is not null and b is not null").collect()
    assert len(got) > 200
    assert all(len(set(r.a) & set(r.b)) >= max(len(r.a), len(r.b)) - line_dedup.GRAM * r.d for r in got)


def test_simhash_by_hand(spark):
    text = "alpha bravo charlie delta echo foxtrot golf"
    row = line_dedup.line_index(spark.createDataFrame([(1, 1, text)], "dk long, doc_id long, text string")).first()
    hashes = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in text.split()], "w string").select(F.xxhash64("w")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert row.simhash & (1 << 64) - 1 == want


def test_awkward_lines(spark, awkward, empty):
    got = line_dedup.dedup_lines(awkward).toPandas()
    assert len(got) == 12
    assert got[got.doc_id == 5].n_removed.tolist() == [1]
    assert got[got.doc_id == 4].n_removed.tolist() == [0, 0]
    assert set(awkward.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_bounds_are_never_less_than_the_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        x = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 11))) for _ in range(rng.randrange(5, 30))]
        y = list(x)
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(y))
            y[i] = rng.choice([rng.choice(x), "new", y[i][:1] + "x" + y[i][1:]])
        rows.append((" ".join(x), " ".join(y)))
    df = spark.createDataFrame(rows, "x string, y string")
    pair = lambda f: F.levenshtein(f("x"), f("y"))
    widest = F.greatest(*(F.array_max(F.transform(F.split(c, " "), F.length)) + 1 for c in "xy"))
    got = df.select(F.levenshtein("x", "y").alias("d"), (4 * pair(lambda c: line_dedup.symbols(F.col(c), 4))).alias("by_4"), (widest * pair(lambda c: line_dedup.as_symbols(F.split(c, " ")))).alias("by_word")).collect()
    assert all(r.d <= r.by_4 and r.d <= r.by_word for r in got)
    assert sum(r.by_4 for r in got) < 3 * sum(r.d for r in got)


def test_sets_with_one_first_hash_stay_apart(spark):
    classes = spark.createDataFrame([(7, 3, 1), (7, 3, 2), (7, 4, 1), (8, 3, 1)], "node long, n long, check long")
    twins = minhash.second_sets(classes)
    assert len({r.node for r in minhash.apart(classes, twins).collect()}) == 4
    assert minhash.second_sets(classes.where("check = 1 and n = 3")) is None


def test_planted_passages(spark):
    passage = variant(77, 55)
    rows = [(i, f"{variant(i, 40)} {passage if i % 3 == 0 else ''} {variant(i + 1000, 40)}", "en", "s", 1) for i in range(1, 31)]
    rows += [(100, variant(500, 60), "en", "s", 1), (101, variant(500, 60).replace("w1", "w1", 1) + " extra", "en", "s", 1)]
    rows += [(200 + i, f"{variant(i + 3000, 40)} {variant(78, 50)} {variant(i + 4000, 40)}", "en", "s", 1) for i in range(20)]
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, DOCS)).toPandas()
    # Fifty words are too few, fifty-one enough.
    assert set(got.doc_id) == {i for i in range(1, 31) if i % 3 == 0} | {100, 101}
    assert got.groupby(["kind", "component_id"]).kept.sum().eq(1).all()
    texts = {r[0]: r[1] for r in rows}
    for r in got.itertuples():
        assert len(WORD.findall(texts[r.doc_id][r.start : r.stop])) == r.n_words
        if r.doc_id < 100:
            assert texts[r.doc_id][r.start : r.stop] == passage


def brute_passages(texts, size=51):
    """(doc, first word, word behind the last) of every maximal run in which each stretch comes more than once."""
    words = {d: WORD.findall(lower(t)) for d, t in texts.items()}
    seen = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = set()
    for d, w in words.items():
        q = [i for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1]
        for i in q:
            if i - 1 not in q:
                end = i
                while end + 1 in q:
                    end += 1
                out.add((d, i, end + size))
    return out


def found_passages(rows, texts):
    """The same from the operator's rows; parts that are kept and parts that are not are put together."""
    spans = {}
    for r in rows:
        if r.kind == "passage":
            text = texts[r.doc_id]
            first = len(WORD.findall(text[: r.start]))
            assert len(WORD.findall(text[r.start : r.stop])) == r.n_words >= 51
            spans.setdefault(r.doc_id, []).append([first, first + r.n_words])
    out = set()
    for d, own in spans.items():
        runs = []
        for a, b in sorted(own):
            # A part begins with the stretch behind the last one of the part before it.
            if runs and a <= runs[-1][1] - 50:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out |= {(d, a, b) for a, b in runs}
    return out


def test_passages_like_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_substring_dedup(spark, SF).collect()
    assert found_passages(rows, texts) == brute_passages(texts)
    parts = {}
    for r in rows:
        if r.kind == "passage":
            parts.setdefault(r.component_id, []).append(r.kept)
    assert all(any(kept) for kept in parts.values())


def test_overlapping_passages(spark):
    rng = random.Random(4)
    pool = [f"v{i}" for i in range(3000)]
    pieces = [[rng.choice(pool) for _ in range(n)] for n in (30, 52, 60, 90, 140, 51)]
    texts = {}
    for d in range(40):
        words = []
        for _ in range(4):
            piece = rng.choice(pieces)
            a = rng.randrange(len(piece) // 2)
            words += piece[a:] if rng.random() < 0.5 else piece
            words += [rng.choice(pool) for _ in range(rng.randrange(3))]
        texts[d] = (" " if d % 2 else "\n").join(words)
    texts[100] = texts[0] + " " + texts[0]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found_passages(paragraph_dedup.repeated_paragraphs(df).collect(), texts) == brute_passages(texts)


def test_awkward_passages(spark, awkward, empty):
    got = paragraph_dedup.repeated_paragraphs(awkward).toPandas()
    assert 5 in set(got.doc_id)
    assert not set(got.doc_id.dropna()) & {1, 2, 3, 6, 7}
    assert paragraph_dedup.repeated_paragraphs(empty).count() == 0


def test_trimming_keeps_the_distance(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        x = [rng.choice("abcé") for _ in range(rng.randrange(0, 90))]
        y = list(x)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "a", "xy"])
        rows.append(("".join(x), "".join(y)))
    df = spark.createDataFrame(rows, "x string, y string").withColumn("want", F.levenshtein("x", "y"))
    rest = df.withColumn("rest", line_dedup.trimmed(F.col("x"), F.col("y"))).select("want", F.inline("rest"))
    got = rest.select("want", F.levenshtein("x", "y").alias("got"), (F.length("x") + F.length("y")).alias("n")).collect()
    assert all(r.want == r.got for r in got)
    assert sum(r.n for r in got) < 0.6 * sum(len(x) + len(y) for x, y in rows)


def test_blocks_are_wide_and_lose_no_pair():
    """Unlike lines must not meet as the square of their number; hashes three bits apart must."""
    masks = [m & (1 << 64) - 1 for m in line_dedup.block_masks()]
    assert min(m.bit_count() for m in masks) >= 31
    rng = random.Random(2)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), line_dedup.MAX_BITS))
        assert any(not flips & m for m in masks)


def test_length_classes_lose_no_pair(spark):
    rows = [(x, y) for x in range(5, 400) for y in range(x, x * 100 // 80 + 1)]
    df = spark.createDataFrame(rows, "x long, y long")
    (a, b), (c, d) = (line_dedup.length_classes(F.col(k), 80) for k in "xy")
    assert df.where((a != c) & (b != d)).count() == 0
    assert spark.createDataFrame([(100, 200)], "x long, y long").where((a == c) | (b == d)).count() == 0


def test_bands_find_like_lines_and_few_others():
    """By Jaccard similarity: no fewer like lines than six bands of four find, and a tenth of their unlike ones at most."""
    rng = random.Random(3)

    def found(bands, n_minima, share):
        draws = ([rng.random() < share for _ in range(n_minima)] for _ in range(4000))
        return sum(any(all(x[i] for i in band) for band in bands) for x in draws) / 4000

    for share, least in ((0.67, 0.64), (0.8, 0.93), (0.9, 0.99)):
        assert found(line_dedup.BANDS, line_dedup.MINIMA, share) >= least
    assert sum(0.1 ** len(band) for band in line_dedup.BANDS) <= 0.1 * 6 * 0.1**4


def test_dense_groups_are_not_tested_pair_by_pair(spark):
    """Near copies of near copies, of which no one is near to all: the links that hold them together come first."""
    n = 240
    nodes = spark.range(n).select(F.col("id").alias("node"))
    keys = F.array(*(F.xxhash64(F.lit(s), F.floor((F.col("node") + s) / 8)) for s in range(0, 8, 2)), F.lit(1).cast("long"))
    members = nodes.select(F.explode(keys).alias("key"), "node")
    tested = []

    def verify(pairs):
        tested.append(pairs.count())
        return pairs.where("b - a <= 5 and a div 120 = b div 120")

    roots = components.link_buckets(members, nodes, verify, lambda a, b: F.lit(True)).collect()
    assert {r.node: r.root for r in roots} == {i: i // 120 * 120 for i in range(n)}
    assert sum(tested) < 0.75 * n * (n - 1) / 2, tested


def test_rounds_end_when_they_close_few_pairs(spark):
    """Lines that share a passage all meet, but hardly any is near another: every pair is tested, in few rounds."""
    n = 60
    ids = lambda name: spark.range(n).select(F.col("id").alias(name))
    pairs = ids("a").join(ids("b"), F.col("a") < F.col("b")).selectExpr("a", "b", "a as root_a", "b as root_b", "cast(1 as long) as n")
    tested = []

    def verify(pairs):
        tested.append([tuple(r) for r in pairs.collect()])
        return pairs.where("a % 10 = 0 and b = a + 7")

    roots = components.link_pairs(components.cut(pairs, "pairs"), spark.createDataFrame([], "node long, root long"), verify).collect()
    assert {r.node: r.root for r in roots} == {x: i for i in range(0, n, 10) for x in (i, i + 7)}
    assert len(tested) <= 2
    once = [p for some in tested for p in some]
    assert len(once) == len(set(once))
    # Only pairs inside one component go untested.
    assert len(once) >= n * (n - 1) // 2 - n // 10 * 6


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 9)] + [(205, 201), (205, 202), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 109)} | {i: 201 for i in (201, 202, 205)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
