import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import quality_rules, wordhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet=" ab\n\té漢|#", max_size=60)), max_size=12)


def stats(t):
    words = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)]


@settings(deadline=None, max_examples=150)
@given(texts)
def test_statistics(ts):
    got = []
    for b in wordhash.blocks(pa.array(ts, pa.string())):
        s = quality_rules.text_stats(b)
        got += [list(map(int, x)) for x in zip(*(s[k] for k in quality_rules.STATS), strict=True)]
    assert got == [stats(t) for t in ts]


@settings(deadline=None, max_examples=100)
@given(texts)
def test_equal_words_have_equal_hashes(ts):
    seen = {}
    for b in wordhash.blocks(pa.array(ts, pa.string())):
        h = b.words().tolist()
        words = [w for t in ts[b.rows] for w in WORD.findall(t or "")]
        assert len(h) == len(words)
        for w, x in zip(words, h, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_inside_texts():
    (b,) = wordhash.blocks(pa.array(["a b c", "", "d", "e f g h"]))
    _, at = wordhash.windows(b.words(), b.word_offsets, 3)
    assert at.tolist() == [0, 4, 5]
