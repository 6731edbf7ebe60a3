"""Thread stock and pattern library.

stash: brand, id, owned, added_at, min_stock, tobuy; stash_history: id, date,
delta; library: pattern_id, title, designer, status, created_at, tag, size;
library_threads: pattern_id, id, stitches, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.dates import day
from tessella.functions.numbers import js_round, ratio, tenth
from tessella.functions.skeins import skeins_needed

def is_open():
    return F.col("status") != "completed"
from tessella.plans.ranks import placed


def low_stock(stash: DataFrame, threshold: int = 2) -> DataFrame:
    """Threads under their own minimum, or under the threshold where they have none, with the position in their brand: most short first."""
    least = F.when(F.col("min_stock") > 0, F.col("min_stock")).otherwise(threshold)
    low = stash.withColumn("least", least.cast("long")).where("owned < least").withColumn("short", F.col("least") - F.col("owned"))
    return placed(low.select("id", "brand", "owned", "least", "short"), ["brand"], [F.desc("short"), F.col("id")], "position")


def thread_states(stash: DataFrame, threshold: int = 2) -> DataFrame:
    """Counts by state: used up, low or owned, and whether the thread is to be bought."""
    state = F.when(F.col("owned") <= 0, "usedup").when(F.col("owned") < threshold, "lowstock").otherwise("owned")
    return stash.groupBy(state.alias("state"), "tobuy").agg(F.count(F.lit(1)).alias("n"), F.sum("owned").alias("owned"))


def shopping_order(stash: DataFrame) -> DataFrame:
    """Threads to buy: newest first, then brand, then number."""
    return placed(stash.where("tobuy").select("brand", "id", "added_at"), ["brand"], [F.desc("added_at"), F.col("id")], "position")


def age_buckets(stash: DataFrame, as_of: str) -> DataFrame:
    """Owned threads by the days since they came: under 1, under 3, under 5 years, older."""
    days = F.date_diff(day(as_of), "added_at")
    bucket = F.when(days < 365, "under 1 year").when(days < 1095, "1 to 3 years").when(days < 1825, "3 to 5 years").otherwise("older")
    return stash.where("owned > 0").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("added_at").alias("oldest"))


def monthly_flow(history: DataFrame, sessions: DataFrame, as_of: str, months: int = 12, stitches_per_skein: int = 1800) -> DataFrame:
    """Skeins that came and skeins used in each of the last months, none left out."""
    last = F.trunc(day(as_of), "month")
    spine = history.sparkSession.range(1).select(F.explode(F.sequence(F.add_months(last, 1 - months), last, F.expr("INTERVAL 1 MONTH"))).alias("month"))
    came = history.where("delta > 0").groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("delta").alias("added"))
    used = sessions.groupBy(F.trunc("date", "month").alias("month")).agg(tenth(F.sum("net_stitches") / stitches_per_skein).alias("used"))
    return spine.join(came, "month", "left").join(used, "month", "left").select("month", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("used", F.lit(0.0)).alias("used"))


def repeat_purchases(history: DataFrame, days: int = 30) -> DataFrame:
    """Threads bought at least twice, first and last more than so many days apart."""
    bought = history.where("delta > 0").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    return bought.where((F.col("n") >= 2) & (F.date_diff("last", "first") > days))


def demand(library: DataFrame, needs: DataFrame) -> DataFrame:
    """Skeins that open patterns need of each thread: every pattern buys whole skeins."""
    used = needs.join(library.where(is_open()).select("pattern_id"), "pattern_id", "left_semi")
    per = used.groupBy("pattern_id", "id").agg(F.sum("stitches").alias("stitches")).withColumn("skeins", skeins_needed(F.col("stitches")))
    return per.groupBy("id").agg(F.sum("skeins").alias("needed"), F.count(F.lit(1)).alias("n_patterns"))


def shortfalls(library: DataFrame, needs: DataFrame, stash: DataFrame) -> DataFrame:
    """Threads of which open patterns need more than is owned."""
    joined = demand(library, needs).join(stash.select("id", "owned"), "id", "left").fillna(0, ["owned"])
    return joined.where("needed > owned").select("id", "needed", "owned", (F.col("needed") - F.col("owned")).alias("deficit"))


def startable(library: DataFrame, needs: DataFrame, stash: DataFrame) -> DataFrame:
    """For each pattern not begun, how many of its threads the stock covers."""
    waiting = library.where(~F.col("status").isin("completed", "inprogress")).select("pattern_id")
    per = needs.join(waiting, "pattern_id", "left_semi").groupBy("pattern_id", "id").agg(F.sum("stitches").alias("stitches"))
    joined = per.join(stash.select("id", "owned"), "id", "left").withColumn("ok", F.coalesce(F.col("owned") >= skeins_needed(F.col("stitches")), F.lit(False)))
    out = joined.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_threads"), F.count_if("ok").alias("covered"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("id")))).alias("missing"))
    return out.withColumn("percent", js_round(F.col("covered") / F.col("n_threads") * 100).cast("long"))


def patterns_using(library: DataFrame, needs: DataFrame, thread: int) -> DataFrame:
    return library.join(needs.where(F.col("id") == thread).select("pattern_id"), "pattern_id", "left_semi").select("pattern_id", "title", "status")


def never_used(stash: DataFrame, library: DataFrame, needs: DataFrame) -> DataFrame:
    """Owned threads that no pattern begun or finished asks for."""
    used = needs.join(library.where("status <> 'wishlist'").select("pattern_id"), "pattern_id", "left_semi").select("id")
    return stash.where("owned > 0").join(used, "id", "left_anti").select("id", "brand", "owned")


def dormant(stash: DataFrame, history: DataFrame, as_of: str, days: int = 730) -> DataFrame:
    """Owned threads whose stock last changed long ago."""
    last = history.groupBy("id").agg(F.max("date").alias("last_change"))
    return stash.where("owned > 0").join(last, "id").where(F.date_diff(day(as_of), "last_change") > days).select("id", "owned", "last_change")


def use_what_you_have(unused: DataFrame, library: DataFrame, needs: DataFrame, k: int = 5) -> DataFrame:
    """The k patterns, neither begun nor finished, that use most of the owned threads that were never used."""
    waiting = needs.join(library.where(~F.col("status").isin("completed", "inprogress")).select("pattern_id"), "pattern_id", "left_semi").select("pattern_id", "id").distinct()
    return waiting.join(unused.select("id"), "id", "left_semi").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_threads")).orderBy(F.desc("n_threads"), "pattern_id").limit(k)


def buying_impact(library: DataFrame, needs: DataFrame, stash: DataFrame, k: int = 10) -> DataFrame:
    """The k threads not owned that most open patterns wait for, with three of these."""
    wanted = needs.join(library.where(is_open()).select("pattern_id"), "pattern_id", "left_semi").select("pattern_id", "id").distinct().join(stash.where("owned > 0").select("id"), "id", "left_anti")
    sample = Window.partitionBy("id").orderBy("pattern_id")
    ranked = wanted.withColumn("i", F.row_number().over(sample))
    return ranked.groupBy("id").agg(F.count(F.lit(1)).alias("n_patterns"), F.array_sort(F.collect_list(F.when(F.col("i") <= 3, F.col("pattern_id")))).alias("samples")).orderBy(F.desc("n_patterns"), "id").limit(k)


def brand_alignment(library: DataFrame, needs: DataFrame, stash: DataFrame) -> DataFrame:
    """The brand owned most, and each pattern's share of threads in it; a conflict under 80 %."""
    owned = stash.where("owned > 0").groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    modal = owned.agg(F.max_by("brand", F.struct("n", "brand")).alias("brand"))
    brands = needs.select("pattern_id", "id").distinct().join(stash.select("id", "brand"), "id")
    joined = brands.crossJoin(F.broadcast(modal.withColumnRenamed("brand", "modal")))  # one row
    out = joined.groupBy("pattern_id", "modal").agg(js_round(F.count_if(F.col("brand") == F.col("modal")) / F.count(F.lit(1)) * 100).cast("long").alias("percent"))
    return out.withColumn("conflict", F.col("percent") < 80)


def jaccard_of_top(used: DataFrame, stash: DataFrame, n: int = 20) -> DataFrame:
    """Likeness of the n threads used most and the n owned most."""
    a = used.groupBy("id").agg(F.sum("stitches").alias("s")).orderBy(F.desc("s"), "id").limit(n).select("id", F.lit(1).alias("a"))
    b = stash.orderBy(F.desc("owned"), "id").limit(n).select("id", F.lit(1).alias("b"))
    both = a.join(b, "id", "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("all"))
    return both.select("shared", F.col("all").alias("total"), ratio(F.col("shared"), F.col("all"), 0.0).alias("jaccard"))


def quarter_portfolio(library: DataFrame, n: int = 8) -> DataFrame:
    """Patterns begun and patterns finished in each of the last n quarters with either; each by its own date."""
    begun = library.select(F.trunc("created_at", "quarter").alias("quarter"), F.lit(1).alias("started"), F.lit(0).alias("finished"))
    done = library.where(~is_open() & F.col("completed_at").isNotNull()).select(F.trunc("completed_at", "quarter").alias("quarter"), F.lit(0).alias("started"), F.lit(1).alias("finished"))
    both = begun.where("quarter is not null").unionByName(done)
    return both.groupBy("quarter").agg(F.sum("started").alias("started"), F.sum("finished").alias("finished")).orderBy(F.desc("quarter")).limit(n)


def recommended(library: DataFrame, needs: DataFrame, stash: DataFrame) -> DataFrame:
    """The pattern with the best cover; a wish counts 5 more."""
    scored = startable(library, needs, stash).join(library.select("pattern_id", "status"), "pattern_id").withColumn("score", F.col("percent") + F.when(F.col("status") == "wishlist", 5).otherwise(0))
    return scored.orderBy(F.desc("score"), "pattern_id").limit(1).select("pattern_id", "score")


def designers(library: DataFrame, n: int = 5) -> DataFrame:
    return library.groupBy("designer").agg(F.count(F.lit(1)).alias("total"), F.count_if(~is_open()).alias("finished")).orderBy(F.desc("total"), "designer").limit(n)


def size_buckets(library: DataFrame) -> DataFrame:
    bucket = F.when(F.col("size") < 5000, "small").when(F.col("size") < 25000, "medium").otherwise("large")
    return library.groupBy(bucket.alias("bucket"), "status").agg(F.count(F.lit(1)).alias("n"))


def shopping_list(library: DataFrame, needs: DataFrame, stash: DataFrame, price: float = 0.95) -> DataFrame:
    """What every open pattern asks for, what is missing and what it costs."""
    per = needs.join(library.where(is_open()).select("pattern_id"), "pattern_id", "left_semi").groupBy("pattern_id", "id").agg(F.sum("stitches").alias("stitches")).withColumn("needed", skeins_needed(F.col("stitches")))
    joined = per.join(stash.select("id", "owned"), "id", "left").fillna(0, ["owned"]).withColumn("missing", F.greatest(F.lit(0), F.col("needed") - F.col("owned")))
    status = F.when(F.col("missing") == 0, "owned").when(F.col("owned") > 0, "partial").otherwise("missing")
    return joined.groupBy("pattern_id").agg(F.sum("needed").alias("needed"), F.sum("missing").alias("missing"), F.count_if(status == "owned").alias("n_owned"), F.count_if(status == "partial").alias("n_partial"), F.count_if(status == "missing").alias("n_missing")).withColumn("cost", F.col("missing") * price)


def unused_stock_count(stash: DataFrame, needs: DataFrame) -> DataFrame:
    """How many owned threads no pattern names; a hint fires at five."""
    return stash.where("owned > 0").join(needs.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("fires", F.col("n") >= 5)


def purchases(stash: DataFrame) -> DataFrame:
    """The stock after everything on the list is bought: one skein each, flags cleared."""
    return stash.select("id", "brand", (F.col("owned") + F.when(F.col("tobuy"), 1).otherwise(0)).alias("owned"), F.lit(False).alias("tobuy"))


def running_stock(history: DataFrame, last: int = 500) -> DataFrame:
    """Over the last days with changes of each thread: their number, the stock at the end, and the least at a day's end."""
    days = history.groupBy("id", "date").agg(F.sum("delta").alias("delta"))
    w = Window.partitionBy("id")
    seen = days.withColumns({"stock": F.sum("delta").over(w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), "back": F.row_number().over(w.orderBy(F.desc("date")))})
    return seen.where(F.col("back") <= last).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by("stock", "date").alias("stock"), F.min("stock").alias("least_stock"))
