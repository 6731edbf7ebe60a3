import random
import re

import pytest
import xxhash
from conftest import SF

from tessella.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """The least id reachable, for a dict of id to fingerprint."""
    todo, found = set(fps), {}
    for i in sorted(fps):
        if i not in todo:
            continue
        todo.discard(i)
        front = [i]
        while front:
            at = front.pop()
            found[at] = i
            near = [j for j in todo if (fps[j] ^ fps[at]).bit_count() <= 2]
            todo.difference_update(near)
            front += near
    return found


def test_query_like_brute_force(spark):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    parts = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{fp:016x}", parts[i]) for i, fp in fps.items()}


@pytest.mark.parametrize("bucket", [2, 64])
def test_clouds_of_fingerprints(spark, bucket):
    """Dense clouds, whose buckets are split again and again, and lone fingerprints; no pair is missed or added."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64 if centre % 2 else 9), rng.randrange(4))) for _ in range(200)}
    fps = sorted(fps)
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    rows = simhash.near_pairs(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), bucket=bucket).collect()
    assert len(rows) == len(want) > 500
    assert {(r.a, r.b) for r in rows} == want


@pytest.mark.parametrize("differing", [0, 1, 3])
def test_other_distances(spark, differing):
    rng = random.Random(differing)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(4)})
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= differing}
    rows = simhash.near_pairs(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), differing, 2).collect()
    assert {(r.a, r.b) for r in rows} == want


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One TWO", "É é İ ß one\x0btwo\x0cthree four", "a " * 40, "\x1c\x1d\x85 x y z w", "x" * 5000 + " y z w"])
def test_fingerprints_of_awkward_texts(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_pieces_of_a_long_text():
    rng = random.Random(5)
    text = "".join(rng.choice(["alpha", "Beta", "c" * 30]) + rng.choice([" ", "\n\n", "\t "]) for _ in range(3000)).encode()
    whole = [h for part in simhash.shingle_hashes(text) for h in part]
    for piece in (1, 17, 1000):
        assert [h for part in simhash.shingle_hashes(text, piece=piece) for h in part] == whole
    assert simhash.fingerprint(text * 20) == brute_fingerprint((text * 20).decode())


def test_awkward_documents(spark, awkward, empty):
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_duplicates(awkward).collect()), key=repr)
    texts = [(r.doc_id, brute_fingerprint(r.text)) for r in awkward.select("doc_id", "text").collect()]
    least = {fp: min((i for i, f in texts if f == fp and i is not None), default=None) for _, fp in texts}
    lone = {fp for _, fp in texts if all(f == fp or (f ^ fp).bit_count() > 2 for _, f in texts)}
    assert [(i, fp) for i, fp, _ in got] == sorted(texts, key=repr)
    assert all(c == least[fp] for _, fp, c in got if fp in lone)
    assert {c for i, _, c in got if i in (1, 2, 3)} == {1}
    assert simhash.simhash_duplicates(empty).collect() == []
