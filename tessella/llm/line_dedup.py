"""Fuzzy line deduplication with DataFrame operations only.

Lines are normalised and get a 64-bit SimHash of their words. Lines whose
hashes differ in at most three bits agree, by the pigeonhole principle, on three
of six blocks of bits, and meet in the buckets of the twenty triples of blocks; 31
to 33 bits are wide enough that lines which share nothing hardly ever meet. One
changed word in fifty moves about four bits, so lines also have MinHash values
of the same words and meet in twenty bands of six: of lines with a Jaccard
similarity of 0.8 of their longer words 4 % miss all bands, of those with 0.9 one in
a thousand; of unlike lines with 0.1 two in 100,000 meet.
Lines of fourteen words or fewer also have a key for all their words and one for
all but each, so that short lines with one word changed, added or left out always
meet, and few others do. All keys see whole
words, so lines with a typo in most of their words hardly ever meet.
Lines that meet are compared by edit
distance, and links join into groups. Of each group the occurrence in the least
document stays, and every other one is removed.

Edit distances of whole lines are dear, so bounds come first: each line is also
a string with one symbol for each word, and a long one with one for every four
characters, and the distance of such strings times the longest piece is
never less than the distance of the lines. In the other direction an edit takes
three grams of three characters at most, so lines of middle length that share too
few grams cannot be near. Pairs that the bounds leave open get the exact distance.
Pieces and grams are made only for pairs that words leave open.

The SimHash comes from word counts per bit: each word of four bytes or more adds
its hash bits to 22 sums, three counters in each, in one grouped
aggregation by line. Shorter words are left out, because the same few of a
language would otherwise decide most bits of all its lines; a line with fewer
than three longer words takes them all. Documents are
dealt by their key once, into a bucketed table, and no later step moves texts.

Equal normalised lines are one class by a 64-bit hash, whatever their length where
min_words is 1, as in op3 and the pipeline; lines with fewer than five words match
equal lines only. Edit similarity is 1 - distance / longer length on the
normalised lines, 0.8 or more. What both kinds of keys miss stays. A line of more
than 1048575 words, which the counters could not hold, matches equal lines only.

Edge cases: a null text stays null, an empty one empty; lines keep their order
and separators; a line repeated inside one document stays once; rows with equal
id and text are one document and keep the same lines; documents of which no
line is left have an empty text; an empty table gives no rows. Other columns
pass through; one with the name of an added column gives way to it.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, cut, discard
from .components import link_buckets

MIN_WORDS = 5
#: Bytes of the words that make the SimHash, how few of them it takes before short ones count too, and how many words the counters hold.
LONG, MIN_LONG, MAX_WORDS = 4, 3, (1 << 20) - 1
MAX_BITS = 3
PERCENT = 80
#: Widths of the blocks; any MAX_BITS flipped bits leave TOGETHER of them alone.
BLOCKS = (11, 11, 11, 11, 10, 10)
TOGETHER = len(BLOCKS) - MAX_BITS
#: Keys of a line that are dealt at a time; all at once would take more disk.
KEYS_AT_ONCE = 10
#: MinHash values, and the bands of them; two bands share 2 at most.
MINIMA = 24
BANDS = (
    (0, 1, 5, 8, 9, 19), (0, 2, 9, 11, 17, 21), (0, 4, 9, 15, 16, 22), (0, 5, 11, 13, 14, 16),
    (0, 10, 12, 14, 20, 22), (1, 2, 12, 15, 16, 19), (1, 3, 11, 18, 20, 23), (1, 4, 6, 13, 14, 18),
    (1, 6, 7, 9, 10, 23), (2, 4, 8, 18, 20, 21), (2, 5, 8, 10, 12, 13), (3, 4, 5, 9, 17, 23),
    (3, 5, 7, 12, 15, 20), (3, 6, 13, 16, 20, 21), (3, 13, 15, 17, 19, 22), (4, 7, 12, 16, 17, 18),
    (6, 7, 8, 11, 18, 22), (6, 7, 14, 17, 19, 21), (8, 10, 16, 19, 22, 23), (10, 11, 14, 15, 21, 23),
)
#: Lines of so many words at most also have a key for all their words and one for all but each; two keys in a number.
SHORT = 14
_PAIRS = [f"q{i}" for i in range((SHORT + 2) // 2)]
#: Characters of a gram, and of the lines that have grams.
GRAM, GRAM_LINE = 3, 400
#: Characters of the longer line from which grams, and pieces of four characters, cost less than the exact distance.
BY_GRAMS, BY_PIECES = 100, 200
#: Sum j counts bits j, j + 21 and j + 42 in 21 bits each, and one more sum bit 63.
_LANE = _SUMS = 21
_MASK = sum(1 << _LANE * lane for lane in range(3))


def words_of(line: Column) -> Column:
    """The line's words in lower case: runs of letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(F.lower(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def block_masks() -> list[int]:
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    masks = [((1 << width) - 1) << at for width, at in zip(BLOCKS, starts, strict=True)]
    return [_signed(sum(some)) for some in combinations(masks, TOGETHER)]


def band_marks() -> list[int]:
    """What word hashes are XORed with: the least result belongs to the hash nearest to the mark."""
    return [int.from_bytes(hashlib.sha256(f"line mark {i}".encode()).digest()[:8], "big", signed=True) for i in range(MINIMA)]


def simhash(sums: list[Column], n: Column) -> Column:
    """A bit is set if more than half of the n words have it; null if n is null.

    Added to a counter, 2 ** 20 - 1 - n div 2 carries into its highest bit for
    more than half. All counters of a sum take it at once; 64 conditions would
    make a method longer than the JVM compiles.
    """
    least = F.lit((1 << _LANE - 1) - 1).cast("long") - F.shiftright(n, 1)
    lanes = [F.shiftleft(F.shiftrightunsigned(s + least * _MASK, _LANE - 1).bitwiseAND(_MASK), j) for j, s in enumerate(sums[:-1])]
    return reduce(Column.bitwiseOR, lanes, F.shiftleft(F.shiftrightunsigned(sums[-1] + least, _LANE - 1), 63))


def left_out(words: Column) -> Column:
    """A number of 32 bits, as a long, for all the words and for all but each, whatever their order."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    everything = F.aggregate(hashes, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    mixed = lambda x: F.shiftright(F.xxhash64(x), 32)
    return F.concat(F.array(mixed(everything)), F.transform(hashes, lambda h: mixed(everything.bitwiseXOR(h))))


def line_index(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of each line with words enough: dk, doc_id, line, node (hash of the normalised line), size (its characters), simhash and bands."""
    lines = docs.where("text is not null").select("dk", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    # A step each: what stands beside explode() would be computed again for every word, and with a lambda inside, explode() would run outside generated code.
    worded = lines.select("dk", "doc_id", "line", words_of(F.col("raw")).alias("words"))
    # Filtered by node after the sums, since a filter here would split every line twice.
    longer = worded.select("dk", "doc_id", "line", F.when(F.size("words") >= min_words, F.xxhash64("words")).alias("node"), F.length(F.array_join("words", " ")).cast("long").alias("size"), F.size("words").between(MIN_WORDS, MAX_WORDS).alias("fit"), "words", F.filter("words", lambda w: F.octet_length(w) >= LONG).alias("long"))
    own = ["dk", "doc_id", "line", "node", "size"]
    chosen = longer.select(*own, F.when(F.col("fit"), F.when(F.size("long") >= MIN_LONG, F.col("long")).otherwise(F.col("words"))).alias("long"), F.when(F.col("fit") & (F.size("words") <= SHORT), left_out(F.col("words"))).alias("keys"))
    pairs = [F.shiftleft(F.try_element_at("keys", F.lit(2 * i + 1)), 32).bitwiseOR(F.coalesce(F.try_element_at("keys", F.lit(2 * i + 2)), F.try_element_at("keys", F.lit(2 * i + 1))).bitwiseAND(0xFFFFFFFF)).alias(q) for i, q in enumerate(_PAIRS)]
    own += ["n", *_PAIRS]
    words = chosen.select(*own[:-1 - len(_PAIRS)], F.when(F.col("long").isNotNull(), F.size("long")).alias("n"), *pairs, "long")
    # The hash of a null word is a number too; such a line has no n and so no SimHash.
    hashes = words.select(*own, F.explode_outer("long").alias("word")).select(*own, F.xxhash64("word").alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(_MASK)).alias(f"s{j}") for j in range(_SUMS)]
    top = F.sum(F.shiftrightunsigned("h", 63)).alias(f"s{_SUMS}")
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(mark).cast("long"))).alias(f"m{i}") for i, mark in enumerate(band_marks())]
    counted = hashes.groupBy("dk", "line").agg(*(F.min(c).alias(c) for c in ("doc_id", "node", "size", "n", *_PAIRS)), *sums, top, *minima)
    # A band is 32 bits of hash: texts are compared anyway, and rows stay narrow.
    bands = F.array(*(F.shiftright(F.xxhash64(*(f"m{i}" for i in band)), 32).cast("int") for band in BANDS))
    return counted.where("node is not null").select("dk", "line", "doc_id", "node", "size", simhash([F.col(f"s{j}") for j in range(_SUMS + 1)], F.col("n")).alias("simhash"), F.when(F.col("n").isNotNull(), bands).alias("bands"), *_PAIRS)


def trimmed(x: Column, y: Column) -> Column:
    """An array of one struct: x and y without most of what they share in front and behind, which leaves their edit distance as it is.

    Each step is a transform() of the one before, so what it yields is computed
    once; as nested expressions the steps would multiply.
    """
    pick = lambda p, *more: F.struct(p["x"].alias("x"), p["y"].alias("y"), *more)

    def agreed(p: Column, end) -> Column:
        n = F.least(F.length(p["x"]), F.length(p["y"]))
        parts = (F.floor(n * s).cast("int") for s in (31 / 32, 7 / 8, 3 / 4, 1 / 2, 1 / 4))
        return F.coalesce(*(F.when(end(p["x"], k) == end(p["y"], k), k) for k in parts), F.lit(0)).alias("n")

    front = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda p: pick(p, agreed(p, lambda c, k: F.substr(c, F.lit(1), k))))
    rest = F.transform(front, lambda p: F.struct(F.substr(p["x"], p["n"] + 1).alias("x"), F.substr(p["y"], p["n"] + 1).alias("y")))
    behind = F.transform(rest, lambda p: pick(p, agreed(p, lambda c, k: F.substr(c, F.length(c) - k + 1))))
    return F.transform(behind, lambda p: F.struct(F.substr(p["x"], F.lit(1), F.length(p["x"]) - p["n"]).alias("x"), F.substr(p["y"], F.lit(1), F.length(p["y"]) - p["n"]).alias("y")))


def as_symbols(pieces: Column) -> Column:
    """A string with one symbol for each piece, equal for equal pieces."""
    # Code points from U+0100 on, below the surrogates.
    codes = F.transform(pieces, lambda x: F.lpad(F.hex(F.pmod(F.hash(x), F.lit(0xD600)) + 0x100), 4, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


def symbols(norm: Column, size: int) -> Column:
    """The line with one symbol for each piece of a word and the space behind it, of so many characters at most."""
    # regexp_extract_all() would copy the line for every piece.
    return as_symbols(F.array_remove(F.split(F.regexp_replace(norm, f"[^ ]{{1,{size - 1}}} ?", "$0\n"), "\n"), ""))


def grams(norm: Column) -> Column:
    """The distinct grams of a line that is not too long for them, else null."""
    return F.when(F.length(norm).between(GRAM, GRAM_LINE), F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(norm) - GRAM + 1), lambda i: F.substr(norm, i, F.lit(GRAM)))))


def verifier(classes: DataFrame, docs: DataFrame, percent: int):
    """Keeps the pairs of nodes whose lines are within the edit distance."""

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "line_pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = classes.join(nodes, "node", "left_semi").select("node", "first.dk", "first.line")
        found = docs.select("dk", "text").join(wanted, "dk").select("dk", "line", "node", F.array_join(words_of(F.split("text", "\n")[F.col("line")]), " ").alias("norm"))
        # Rows with equal id and text give a line more than once; they lie together already.
        found = found.dropDuplicates(["dk", "line"]).withColumn("words", F.split("norm", " ")).select("node", "norm", (F.array_max(F.transform("words", F.length)) + 1).alias("widest"), as_symbols(F.col("words")).alias("by_word"))
        found = cut(found, "lines")
        sides = [found.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in found.columns if c != "node")) for k in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b")
        a, b = F.col("norm_a"), F.col("norm_b")
        longer = F.greatest(F.length(a), F.length(b))
        most = F.floor(longer * ((100 - percent) / 100)).cast("int")
        shares = lambda x, y: F.size(F.array_intersect(x, y)) >= F.greatest(F.size(x), F.size(y)) - GRAM * most
        possible = F.coalesce(F.exists(F.array(F.struct(grams(a).alias("x"), grams(b).alias("y"))), lambda p: shares(p["x"], p["y"])), F.lit(True))
        within = lambda x, y, width: F.call_function("levenshtein", x, y, F.floor(most / width).cast("int")) >= 0
        exact = F.exists(trimmed(a, b), lambda p: F.call_function("levenshtein", p["x"], p["y"], most) >= 0)
        # Each test sees only the pairs that those before it leave open.
        linked = F.when(within("by_word_a", "by_word_b", F.greatest("widest_a", "widest_b")), True).when((longer >= BY_PIECES) & within(symbols(a, 4), symbols(b, 4), 4), True).when(longer.between(BY_GRAMS, GRAM_LINE) & ~possible, False).otherwise(exact)
        return both.where(linked).select("a", "b")

    return verify


def may_link(percent: int):
    """Few bits apart, where a bucket of blocks is the place; and no pair differs in length by more than its edit distance."""

    def condition(a: str, b: str) -> Column:
        bits = F.bit_count(F.col(f"{a}.simhash").bitwiseXOR(F.col(f"{b}.simhash")))
        of_band = F.col(f"{a}.key").bitwiseAND(1) == 1
        sizes = [F.col(f"{x}.size") for x in (a, b)]
        return (of_band | (bits <= MAX_BITS)) & (F.least(*sizes) * 100 >= F.greatest(*sizes) * percent)

    return condition


def length_classes(size: Column, percent: int) -> list[Column]:
    """Two numbers; sizes of which the less is at least percent of the greater agree in one of them."""
    # Classes are twice as wide as such sizes are apart, and a little more.
    width = 2.01 * max(math.log(100 / percent), 0.001)
    return [F.floor(F.log(size) / width + shift).cast("int") for shift in (0.0, 0.5)]


def shared_keys(lines: DataFrame, keys: list[Column]) -> DataFrame:
    """key and node of every key that several nodes have; keys: arrays of them, each dealt by itself."""
    found = None
    for some in keys:
        dealt = lines.select("node", F.explode(some).alias("key")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
        part = cut(dealt.where("n > 1").select("key", "node"), "line_keys")
        found = part if found is None else found.union(part)
    return found


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text without its repeated lines, and n_lines, n_removed; lines of fewer than min_words words are left alone."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rest = F.struct(F.lit(True).alias("__row"), *(F.col(f"`{c}`") for c in kept if c != text)).alias("rest")
    keyed = docs.select(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("dk"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), rest)
    table = bucketed(keyed, "dk")
    whole = cut(line_index(table, min_words), "line_index")
    classes = cut(whole.groupBy("node").agg(F.min("simhash").alias("simhash"), F.min("size").alias("size"), F.min("bands").alias("bands"), *(F.min(q).alias(q) for q in _PAIRS), F.min(F.struct("doc_id", "dk", "line")).alias("first")), "line_classes")
    index = cut(whole.select("dk", "line", "node"), "line_places")
    discard(whole)
    # The lowest bit of a key tells bands from blocks.
    blocks = [F.xxhash64(F.lit(i), F.col("simhash").bitwiseAND(F.lit(m).cast("long"))).bitwiseAND(-2) for i, m in enumerate(block_masks())]
    bands = [F.xxhash64(F.lit(-1 - i), F.col("bands")[i]).bitwiseOR(1) for i in range(len(BANDS))]
    hashed = classes.where("simhash is not null")
    halves = [F.xxhash64(F.lit(-100), half).bitwiseOR(1) for q in _PAIRS for half in (F.shiftright(q, 32).cast("int"), F.shiftright(F.shiftleft(q, 32), 32).cast("int"))]
    short = F.when(F.col(_PAIRS[0]).isNotNull(), F.array_compact(F.array(*(F.when(F.col(_PAIRS[i // 2]).isNotNull(), h) for i, h in enumerate(halves))))).otherwise(F.array().cast("array<bigint>"))
    # A repeated word gives a key twice.
    members = shared_keys(hashed, [*(F.array(*blocks[i : i + KEYS_AT_ONCE]) for i in range(0, len(blocks), KEYS_AT_ONCE)), F.concat(F.array(*bands), F.array_distinct(short))])
    roots = link_buckets(members, hashed.select("node", "size", "simhash"), verifier(classes, table, percent), may_link(percent), one_leader=True)
    placed = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    keepers = placed.join(placed.groupBy("root").agg(F.min("first").alias("keeper")), "root").select("node", "keeper")
    again = index.join(keepers, "node").where("dk <> keeper.dk or line <> keeper.line")
    gone = again.select("dk", "line").distinct().groupBy("dk").agg(F.collect_set("line").alias("gone"))
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    out = table.join(gone, "dk", "left").withColumns({"n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"), "clean": F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))})
    return out.select(*(F.col("clean").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in kept), "n_lines", "n_removed")
