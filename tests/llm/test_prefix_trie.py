import hashlib
import random
import re
import zlib

import oracle
import pytest
from conftest import SF

from tessella.llm import prefix_trie, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


def brute_force(rows, every):
    """Nodes by (conv_id, depth), from Python tuples of whole prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if every else 0
        built[c] = own.get(c - c % every, [])[:h] + v[h:] if h else v
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children, leaves, saved, out = {}, {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        if p:
            children.setdefault(p[:-1], []).append(p)
        out[min(members[p]), len(p)] = (parent, len(members[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_like_its_sql(spark):
    assert oracle.differences(spark, oracle.connect(SF), queries.op11_prefix_trie, queries.oracle_sql()["op11_prefix_trie"], SF) is None


def test_query_like_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op11_prefix_trie(spark, SF)) == brute_force(rows, 20)


@pytest.mark.parametrize("every", [None, 20])
def test_random_trees(spark, every):
    """Few distinct texts, so that prefixes branch at every depth; one conversation holds a third of all rows."""
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "b\tc d"])) for c in range(60) for t in range(rng.randrange(0, 12))]
    rows += [(61, t, "user", f"{t % 3}") for t in range(len(rows) // 2)]
    rows += [(c, t, "user", "same words here") for c in range(100, 130) for t in range(5)]
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS), every)) == brute_force(rows, every)


def test_awkward_turns(spark):
    """Null turns first, ties, repeated rows, rows without conversation, turnless rebuilt conversations, clashing names."""
    rows = [(1, None, "user", "x"), (1, 0, None, None), (1, 0, "user", "y"), (1, 0, "user", "y"), (2, 5, "", ""), (3, 0, "user", "z " * 50_000), (None, 0, "user", "q"), (40, 0, "u", "only"), (41, 0, "u", "gone"), (44, 0, "u", "gone")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as conv", "1 as d", "2 as rep", "'y' as name", "3 as row", "4 as `at`", "5 as n", "6 as key")
    for every in (None, 20):
        assert nodes(prefix_trie.conversation_trie(df, every)) == brute_force(rows, every)


def test_no_conversations(spark):
    for every in (None, 20):
        assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS), every).collect() == []


def test_digest_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    ends = spark.range(0, 5000, 1, 5).selectExpr("id % 2 as d", "0L as rep", "id * 3 as conv")
    got = {r.d: r.ends_sha256 for r in prefix_trie.digests(ends).collect()}
    assert got == {d: hashlib.sha256(",".join(str(3 * i) for i in range(d, 5000, 2)).encode()).hexdigest() for d in (0, 1)}
