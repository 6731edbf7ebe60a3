"""Connected components of an edge table, and candidate links inside buckets.

Everything stays in tables: no edge, component or bucket is gathered on the
driver or in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.agg(F.coalesce(F.max(F.when(F.col("up") > 0, F.col("up") + F.col("down"))), F.lit(0))).first()[0] <= 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node reachable) for every node with an edge.

    Large-star and small-star steps take turns until the edges are stars; a
    step groups by node with a partial minimum and joins back, and the number of
    rounds grows with the logarithm of the longest path. Stars are known by their
    edges, so no round only confirms the last.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges, "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, cut(small, "edges")
        discard(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stars(roots: DataFrame) -> DataFrame:
    """One edge (a, b) from every node to its root."""
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


#: Rounds against one leader of each bucket go on while more pairs than so many times the bucket rows are open.
OPEN_PAIRS = 4
#: Rows of two numbers.
BROADCAST_KEYS = 250_000
MOST_ROUNDS = 2
#: Open pairs of a node, on average, beyond which the best BEST of each are tested before the others, in so many rounds at most, while a round leaves at most this share of them open.
DENSE, BEST, DENSE_ROUNDS, WORTH = 12, 3, 3, 0.5


def link_pairs(pairs: DataFrame, roots: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root of the components over roots' and all of pairs that pass verify.

    pairs: a, b, their roots root_a and root_b, and the number n of keys that they share;
    written by cut(), and deleted here. While a node has more than DENSE pairs on average, each is
    first compared with those few that it shares most keys with, and pairs inside
    one component need no test any more; so a dense group costs a few tests
    for each node and not for each pair. Lines that share a passage and little else are
    dense too, but have few links to find: the rounds end when one closes too few pairs.
    The rest is tested at once.
    """
    # A pair counts for one of its ends, either as often.
    mix = F.xxhash64("a", "b")
    own, other = (F.when(mix.bitwiseAND(1) == 0, F.col(x)).otherwise(F.col(y)) for x, y in ("ab", "ba"))
    n_pairs = pairs.count()
    for _ in range(DENSE_ROUNDS):
        best = pairs.groupBy(own.alias("node"), F.pmod(F.xxhash64(other), F.lit(BEST)).alias("part")).agg(F.max(F.struct("n", "a", "b")).alias("best"))
        best = cut(best.select("node", "best.a", "best.b"), "best_pairs")
        nodes = best.agg(F.count_distinct("node")).first()[0]
        if 2 * n_pairs <= DENSE * nodes:
            discard(best)
            break
        tried = best.select("a", "b").distinct()
        checked = cut(verify(tried), "links")
        roots = connected_components(stars(roots).union(checked))
        # A root that has moved is a node of the new components.
        moved = [roots.select(F.col("node").alias(f"root_{x}"), F.col("root").alias(f"now_{x}")) for x in "ab"]
        left = pairs.join(tried, ["a", "b"], "left_anti").join(moved[0], "root_a", "left").join(moved[1], "root_b", "left")
        left = left.select("a", "b", F.coalesce("now_a", "root_a").alias("root_a"), F.coalesce("now_b", "root_b").alias("root_b"), "n").where("root_a <> root_b")
        last, pairs = pairs, cut(left, "open_pairs")
        discard(last, best, checked)
        before, n_pairs = n_pairs, pairs.count()
        if n_pairs > WORTH * before:
            break
    checked = cut(verify(pairs.select("a", "b")), "links")
    discard(pairs)
    return connected_components(stars(roots).union(checked))


def link_buckets(members: DataFrame, traits: DataFrame, verify: Callable[[DataFrame], DataFrame], may_link: Callable[[str, str], Column], facts: DataFrame | None = None, may_link_all: Callable[[str, str], Column] | None = None, one_leader: bool = False) -> DataFrame:
    """node, root of the components over all pairs of nodes that share a bucket and pass verify.

    members: key and node. traits: node and what may_link reads, for every node
    in members; they join those members only whose key is shared. verify takes pairs (a, b) and
    returns those that are linked. may_link(a, b): a condition on key and the
    traits under the aliases a and b that linked pairs meet. facts: node
    and columns for may_link_all, one more condition of that kind, which only
    the last step reads. one_leader: in the first round a node is compared with one
    leader only, the one met most often of those that it may be linked with, so that
    a group of near copies costs a comparison for each node and not for each of its keys.

    In each round one member of every open bucket, the one met most often in
    buckets, is compared with the others; whoever ends in its component needs no
    further comparison with it, so a bucket of n near copies costs n comparisons
    and not n * n. Pairs still open after that are all put to the conditions
    inside one join, and verified if they pass, by link_pairs(): no pair is dropped by a cap.
    """
    own = [c for c in traits.columns if c != "node"]
    counts = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared_keys")
    # Few shared keys, by count, spare the members a shuffle; many are joined like any table.
    shared = cut(members.join(F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts, "key"), "shared")
    weights = shared.groupBy("node").agg(F.sum("c").alias("w")).join(traits, "node")
    live = cut(shared.drop("c").join(weights, "node"), "buckets")
    discard(counts, shared)
    n_live = live.count()
    state = live.withColumns({"root": F.col("node"), "led": F.lit(False), "away": F.lit(True)})
    written = live
    roots = None
    for turn in range(MOST_ROUNDS):
        # The greatest struct: of the members that have not led, one away from the last leader's component, and of these the one met most often.
        leaders = state.groupBy("key").agg(F.max(F.when(~F.col("led"), F.struct("away", "w", "node", "root", *own))).alias("head"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1 and head is not null").select("key", "head")
        met = state.alias("m").join(leaders.select("key", F.struct(F.col("key").alias("key"), "head.*").alias("head")), "key")
        compared = (F.col("root") != F.col("head.root")) & may_link("m", "head")
        open_pairs = met.where(compared).select("node", "head")
        if one_leader and not turn:
            open_pairs = open_pairs.groupBy("node").agg(F.max(F.struct("head.w", "head.node")).alias("head"))
        checked = cut(verify(open_pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()), "links")
        # The stars found so far stand for their links.
        roots = connected_components(checked if roots is None else stars(roots).union(checked))
        moved = met.select("key", "node", "w", *own, (F.col("led") | (F.col("node") == F.col("head.node"))).alias("led"), F.col("head.node").alias("last"))
        state = moved.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        heads = roots.select(F.col("node").alias("last"), F.col("root").alias("last_root"))
        state = cut(state.join(heads, "last", "left").withColumn("away", F.col("root") != F.coalesce("last_root", "last")).drop("last", "last_root"), "buckets")
        discard(written, checked)
        written = state
        sizes = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
        left = sizes.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2), F.lit(0.0))).first()[0]
        if left <= OPEN_PAIRS * n_live:
            break
    if left:
        several = state.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        rest = state.join(several, "key", "left_semi")
        if facts is not None:
            rest = rest.join(facts, "node")
        meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & may_link("a", "b")
        if may_link_all is not None:
            meet &= may_link_all("a", "b")
        met = rest.alias("a").join(rest.alias("b"), meet).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.root").alias("root_a"), F.col("b.root").alias("root_b"))
        pairs = cut(met.groupBy("a", "b", "root_a", "root_b").agg(F.count(F.lit(1)).alias("n")), "open_pairs")
        roots = link_pairs(pairs, roots, verify)
    discard(state)
    return roots
