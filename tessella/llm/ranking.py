"""The k greatest rows of every group, by radix selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard
from .naming import join_common

#: Bits of a value that one round decides; a byte of an item likewise.
DIGIT_BITS = 8
#: A group needs no further round when so many rows at most are open beyond those it needs.
CLOSE = 256


def _boundary(hist: DataFrame, group: list[str], descending: bool) -> DataFrame:
    """group, digit (at which need rows are reached, else the last), left (need less the rows before it), c (rows that have it), open (rows of the group)."""
    order = F.col("digit").desc() if descending else F.col("digit").asc()
    best, worst = (F.max, F.min) if descending else (F.min, F.max)
    upto = hist.withColumn("upto", F.sum("c").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    row = F.struct("digit", "upto", "c", "need")
    b = upto.groupBy(*group).agg(F.coalesce(best(F.when(F.col("upto") >= F.col("need"), row)), worst(row)).alias("b"), F.sum("c").alias("open"))
    return b.select(*group, F.col("b.digit").alias("edge"), (F.col("b.need") - F.col("b.upto") + F.col("b.c")).alias("left"), F.col("b.c").alias("c"), "open")


def _shared(a: Column, b: Column) -> Column:
    """How many leading bytes two binary columns share, by halving steps."""
    both = F.least(F.octet_length(a), F.octet_length(b))
    start = lambda x, n: F.substring(x, F.lit(1), n)
    longer = lambda n, s: F.when((s <= both - n) & (start(a, n + s) == start(b, n + s)), n + s).otherwise(n)
    return F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(31)))), F.lit(0), longer)


def top_k(rows: DataFrame, group: list[str], value: str, item: str, k: int, close: int = CLOSE) -> DataFrame:
    """group, value, item and rank (1 to k in the group, by value descending, then by the item's UTF-8 bytes).

    value is a long from 0; item a string, once in a group; null in none. A round
    counts the rows at each group's threshold by the next bits of their values,
    finds the bits at which k rows are reached, and keeps the rows above and at
    them. When all bits are decided, the rows that tie at the threshold are told
    apart by the bytes of their items, after those bytes that all of them share.
    So no group is sorted whole: at last k rows and at most close more are ranked.
    """
    live = cut(rows.select(*group, F.col(value).alias("value"), F.col(item).alias("item"), F.lit(k).cast("long").alias("need")), "live")
    kept: list[DataFrame] = []
    n_live, top = live.agg(F.count(F.lit(1)), F.coalesce(F.max("value"), F.lit(0))).first()
    shifts = list(range((max(1, top.bit_length()) - 1) // DIGIT_BITS * DIGIT_BITS, -1, -DIGIT_BITS))
    while n_live:
        if by_value := bool(shifts):
            digits = live.withColumn("digit", F.shiftright("value", shifts.pop(0)).bitwiseAND((1 << DIGIT_BITS) - 1))
        else:
            utf8 = F.encode("item", "utf-8")
            ends = live.groupBy(*group).agg(F.min(utf8).alias("low"), F.max(utf8).alias("high"), F.count(F.lit(1)).alias("n"))
            skips = ends.select(*group, "n", _shared(F.col("low"), F.col("high")).alias("skip"))
            digits = join_common(live, skips, group, "n", n_live).withColumn("digit", F.substring(F.encode("item", "utf-8"), F.col("skip") + 1, F.lit(1))).drop("n", "skip")
        hist = digits.groupBy(*group, "digit").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"))
        edges = cut(_boundary(hist, group, by_value), "edges")
        beyond = F.col("digit") > F.col("edge") if by_value else F.col("digit") < F.col("edge")
        met = join_common(digits, edges, group, "open", n_live).where(beyond | (F.col("digit") == F.col("edge")))
        met = cut(met.select(*group, "value", "item", F.col("left").alias("need"), (~beyond & (F.col("c") > F.col("left") + close)).alias("open")), "met")
        discard(live, edges)
        kept.append(met.where("not open").select(*group, "value", "item"))
        live = met.where("open").drop("open")
        n_live = live.count()
    found = kept[0] if kept else live.select(*group, "value", "item")
    for more in kept[1:]:
        found = found.unionByName(more)
    by = Window.partitionBy(*group).orderBy(F.col("value").desc(), F.col("item").asc())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
