"""A trie over the turns of conversations, named by prefix doubling.

Every turn has a dense number for its role and text. Blocks of two, four, eight
... turns get dense numbers for the pairs of numbers of their halves, level by
level, so that equal blocks have equal numbers. A prefix is a chain of such
blocks, by the binary digits of its length: from the largest blocks down to
single turns, a prefix extended by a block is named by the pair of both numbers.
The rounds grow with the logarithm of the longest conversation; the blocks of
all levels together are twice as many as the turns.

A node is one name at one depth; its members are the conversations that start
with it and its own key is the least of them. Along a conversation the least
member can only grow, and a conversation owns the nodes of which it is that
least member, the last ones of its path. Sums over a subtree are therefore sums
over members: every node below is counted by its owner, which is a member. No
subtree is walked, and no conversation, node or group of copies is gathered in
one task; words before a place in a conversation are summed by the same blocks.

Edge cases: rows without conversation are left out; null role and text count as
empty; null turns come first; rows of one turn number are in the order of the
SHA-256 of role and text; repeated rows are turns of their own; an empty table
has no nodes, not even a root; further columns are ignored. Turns are told apart
by the SHA-256 of role and text, so very long texts are hashed once and not
shuffled. A remainder of a negative number is negative, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, text_of
from .naming import join_common, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Conversation ids joined in one piece, of which a node's digest reads one after the other.
PIECE_IDS = 8192
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """row, conv, key, words: one row for each turn; row numbers all turns by conversation and turn."""
    r, t = text_of(role), text_of(text)
    key = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))
    turns = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), key.alias("key"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))
    # Written first: sorting into ranges reads its input twice.
    slim = cut(turns.where("conv is not null").withColumn("at", F.monotonically_increasing_id()), "turns")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("at")]
    rows = numbered(slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "key", "words"), "row", "ordered_turns")
    discard(slim)
    return rows


def counted(rows: DataFrame) -> DataFrame:
    """conv, first (row of its first turn) and n for every conversation."""
    return cut(rows.groupBy("conv").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")


def own_turns(rows: DataFrame, convs: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """turns (conv, pos from 0, key, words) and lengths (conv, n) of the conversations as they are."""
    turns = join_common(rows, convs, ["conv"], "n", n_rows)
    return turns.select("conv", (F.col("row") - F.col("first")).alias("pos"), "key", "words"), convs.select("conv", "n")


def shared_heads(rows: DataFrame, convs: DataFrame, n_rows: int, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """As own_turns, but the first h turns of conversation c are those of c - c % every, where h = crc32(c) % most; what that one lacks is left out."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    heads = convs.select(F.col("conv").alias("base"), F.col("first").alias("base_first"), F.col("n").alias("base_n"))
    placed = convs.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % every}).join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    placed = cut(placed.select("conv", "first", "n", "h", "taken", "base_first"), "placed")
    own = join_common(rows, placed, ["conv"], "n", n_rows).select("conv", (F.col("row") - F.col("first") - F.col("h")).alias("own"), "taken", "key", "words")
    own = own.where("own >= 0").select("conv", (F.col("own") + F.col("taken")).alias("pos"), "key", "words")
    taken = placed.where("taken > 0").select("conv", "base_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("pos"))
    taken = taken.withColumn("row", F.col("base_first") + F.col("pos")).join(rows.select("row", "key", "words"), "row").select("conv", "pos", "key", "words")
    return own.unionByName(taken), placed.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _named(rows: DataFrame, keys: list[str], n_rows: int, name: str, wanted: list, **more) -> DataFrame:
    """rows with a dense number for each distinct value of keys, and with aggregates over the rows that share it; written."""
    names = numbered(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *(f.alias(c) for c, f in more.items())), "name", "names")
    out = cut(join_common(rows, names, keys, "copies", n_rows).select(*wanted), name)
    discard(names)
    return out


def prefixes(turns: DataFrame, lengths: DataFrame) -> list[DataFrame]:
    """Tables of conv, d, rep (least member of the node), cum (words of the first d turns), last (words of turn d), together for every prefix of every conversation."""
    turns = cut(turns, "rebuilt_turns")
    longest, n_rows, least = lengths.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.min("conv")).first()
    zero = F.lit(0).cast("long")
    blocks = [_named(turns, ["key"], n_rows, "blocks", ["conv", F.col("pos").alias("j"), "name", "words", F.col("words").alias("last")])] if longest else []
    while 1 << len(blocks) <= longest:
        odd = F.col("j").bitwiseAND(1) == 1
        pairs = blocks[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"), F.sum("words").alias("words"), F.max(F.when(odd, F.col("last"))).alias("last"))
        pairs = cut(pairs.where("b is not null"), "pairs")
        blocks.append(_named(pairs, ["a", "b"], n_rows, "blocks", ["conv", "j", "name", "words", "last"]))
        discard(pairs)
    discard(turns)
    found = [cut(lengths.select("conv", zero.alias("d"), zero.alias("name"), F.lit(least).cast("long").alias("rep"), zero.alias("cum"), zero.alias("last")), "prefixes")]
    for k in reversed(range(len(blocks))):
        before = found[0]
        for more in found[1:]:
            before = before.unionByName(more)
        before = before.select("conv", "d", F.col("name").alias("a"), F.col("cum").alias("before"))
        pieces = blocks[k].where(F.col("j").bitwiseAND(1) == 0).select("conv", F.shiftleft("j", k).alias("d"), F.col("name").alias("b"), "words", "last")
        grown = cut(pieces.join(before, ["conv", "d"]).select("conv", (F.col("d") + (1 << k)).alias("d"), "a", "b", (F.col("before") + F.col("words")).alias("cum"), "last"), "grown")
        found.append(_named(grown, ["d", "a", "b"], n_rows, "prefixes", ["conv", "d", "name", "rep", "cum", "last"], rep=F.min("conv")))
        discard(grown, blocks[k])
    return found


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the conversations of one node, in order, each as one text."""
    for batch in batches:
        d, rep = (batch.column(i).to_numpy() for i in (0, 1))
        starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (rep[1:] != rep[:-1])]) if len(d) else np.zeros(0, np.int64)
        starts = np.unique(np.r_[starts, np.arange(0, len(d), PIECE_IDS)]).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(d)], pa.int32()), pc.cast(batch.column(2), pa.string()))
        yield pa.RecordBatch.from_arrays([pc.take(batch.column(i), pa.array(starts)) for i in range(3)] + [pc.binary_join(lists, ",")], names=["d", "rep", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's sorted pieces; one piece is in memory at a time."""
    at, state = None, None
    names = ["d", "rep", "ends_sha256"]

    def done(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=names)

    for batch in batches:
        out = []
        for d, rep, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if at != (d, rep):
                if at:
                    out.append((*at, state.hexdigest()))
                at, state = (d, rep), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield done(out)
    if at:
        yield done([(*at, state.hexdigest())])


def digests(ends: DataFrame) -> DataFrame:
    """d, rep, ends_sha256 from d, rep, conv: SHA-256 over the ids in ascending order, comma-joined.

    A digest is made in sequence, so the ids are joined into pieces in ranges
    first, and only pieces, some thousand ids each, meet in one task and pass
    through it as a stream.
    """
    order = ["d", "rep", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "d long, rep long, first long, ids string")
    return pieces.repartition("d", "rep").sortWithinPartitions("d", "rep", "first").mapInArrow(_digests, "d long, rep long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each distinct prefix: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv, pos (from 0 without gaps), key, words. lengths: conv and n, the
    number of turns, for every conversation, turnless ones too.
    """
    found = prefixes(turns, lengths)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # f: the last node of the path that another conversation owns.
    shared = F.when(F.col("rep") != F.col("conv"), F.struct("d", "rep", "cum"))
    paths = cut(rows.groupBy("conv").agg((F.count(F.lit(1)) - 1).alias("n"), F.max(F.struct("d", "rep"))["rep"].alias("end"), F.max(shared).alias("f")), "paths")
    branches = paths.where("f.d < n").select(F.col("f.rep").alias("conv"), F.col("f.d").alias("n")).distinct().withColumn("branch", F.lit(True))
    paths = cut(paths.join(branches, ["conv", "n"], "left").withColumn("leaf", (F.col("end") == F.col("conv")) & F.col("branch").isNull()).drop("branch"), "paths")
    n_rows = paths.agg(F.coalesce(F.sum(F.col("n") + 1), F.lit(0))).first()[0]
    last_shared = F.coalesce(F.col("f.d"), F.lit(-1))
    parent = F.when(F.col("d") - 1 == last_shared, F.col("f.rep")).otherwise(F.col("conv"))
    nodes = join_common(rows, paths, ["conv"], F.col("n") + 1, n_rows).groupBy("d", "rep").agg(
        F.max(F.when((F.col("rep") == F.col("conv")) & (F.col("d") > 0), parent)).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("d") >= last_shared) & (F.col("d") < F.col("n"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.coalesce(F.sum(F.when(F.col("d") <= F.col("f.d"), F.col("f.cum") - F.col("cum") + F.col("last"))), F.lit(0)).alias("saved_tokens"),
    )
    ends = digests(paths.select(F.col("n").alias("d"), F.col("end").alias("rep"), "conv"))
    out = nodes.join(ends, ["d", "rep"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    return out.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, every: int | None = None, most: int = 4) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text); with every, of the conversations that shared_heads rebuilds."""
    rows = ordered_turns(conversations)
    convs = counted(rows)
    n_rows = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return trie(*(own_turns(rows, convs, n_rows) if every is None else shared_heads(rows, convs, n_rows, every, most)))
