"""Legends of charts: what a palette needs, in which order it is shown, and its symbols.

cells are charts (see grid); stock has thread and owned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import tenth
from tessella.functions.skeins import skeins_needed
from tessella.operators.grid import stitchable


def is_blend(thread_id: Column) -> Column:
    return thread_id.contains("+")


def rows(cells: DataFrame, stock: DataFrame) -> DataFrame:
    """Stitches, skeins (a blend takes one strand of either thread), stock and status of every id of a chart; at least one skein each."""
    n = stitchable(cells).groupBy("project_id", "thread_id").agg(F.count(F.lit(1)).alias("n"), F.sum("done").alias("done"))
    needed = F.greatest(F.lit(1), F.when(is_blend(F.col("thread_id")), skeins_needed(F.col("n"), strands=1)).otherwise(skeins_needed(F.col("n"))))
    j = n.join(stock.withColumnRenamed("thread", "thread_id"), "thread_id", "left").withColumns({"needed": needed, "owned": F.coalesce("owned", F.lit(0))})
    status = F.when(F.col("owned") >= F.col("needed"), "owned").when(F.col("owned") > 0, "partial").otherwise("needed")
    return j.select("project_id", "thread_id", "n", "done", "needed", "owned", status.alias("status"))


def totals(legend: DataFrame) -> DataFrame:
    """Ids, skeins and open skeins of each chart's legend, and how many ids are covered."""
    open_ = F.greatest(F.lit(0), F.col("needed") - F.col("owned"))
    return legend.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("needed").alias("skeins"), F.sum(open_).alias("to_buy"), F.count_if(F.col("status") == "owned").alias("covered"))


def number_of(thread_id: Column) -> Column:
    """Digits that an id consists of or begins with; null without any."""
    return F.nullif(F.regexp_extract(thread_id, r"^\d+", 0), F.lit("")).cast("long")


def orders(legend: DataFrame) -> DataFrame:
    """Positions in a chart's legend by number (numbers first), by stitches, by skeins and by status."""
    w = Window.partitionBy("project_id")
    by_number = (F.when(F.col("thread_id").rlike(r"^\d+$"), number_of(F.col("thread_id"))).asc_nulls_last(), F.col("thread_id"))
    status = F.when(F.col("status") == "needed", 0).when(F.col("status") == "partial", 1).otherwise(2)
    place = lambda *by: F.row_number().over(w.orderBy(*by, *by_number))
    return legend.select("project_id", "thread_id", place().alias("by_number"), place(F.desc("n")).alias("by_stitches"), place(F.desc("needed")).alias("by_skeins"), place(status).alias("by_status"))


def split_by_status(legend: DataFrame) -> DataFrame:
    """Ids that are owned and ids to buy, of each chart."""
    return legend.groupBy("project_id").agg(F.array_sort(F.collect_list(F.when(F.col("status") == "owned", F.col("thread_id")))).alias("owned"), F.array_sort(F.collect_list(F.when(F.col("status") != "owned", F.col("thread_id")))).alias("to_buy"))


def symbols(cells: DataFrame, base: int, capacity: int) -> DataFrame:
    """A code point for every id: solid colours by their leading number, then blends by name; from the first again when they run out."""
    ids = stitchable(cells).select("project_id", "thread_id").distinct()
    blend = is_blend(F.col("thread_id"))
    order = Window.partitionBy("project_id").orderBy(blend, F.when(~blend, number_of(F.col("thread_id"))).asc_nulls_last(), "thread_id")
    return ids.withColumn("position", F.row_number().over(order)).select("project_id", "thread_id", "position", (base + (F.col("position") - 1) % capacity).alias("symbol"))


def contrast(r: Column, g: Column, b: Column) -> Column:
    """black on light colours, white on others."""
    return F.when((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255 > 0.55, "black").otherwise("white")


def unused(palette: DataFrame, cells: DataFrame) -> DataFrame:
    """Entries of a palette (project_id, thread_id) that no cell of the chart has."""
    return palette.join(stitchable(cells).select("project_id", "thread_id"), ["project_id", "thread_id"], "left_anti")


def allowed(catalogue: DataFrame, stash: DataFrame, brand: str = "dmc") -> DataFrame:
    """Threads of the brand that are owned; the whole brand if none is, since an empty stock restricts nothing."""
    own = catalogue.where(F.col("brand") == brand)
    held = stash.where((F.col("owned") > 0) & (F.col("brand") == brand)).select("id").distinct()
    any_held = own.join(held, "id", "left_semi").agg((F.count(F.lit(1)) > 0).alias("restricts"))
    marked = own.join(held.withColumn("held", F.lit(True)), "id", "left").crossJoin(F.broadcast(any_held))  # one row
    return marked.where("held or not restricts").select("brand", "id", "name")


def pattern_threads(needs: DataFrame, profiles: DataFrame, stash: DataFrame, fabric: int = 14) -> DataFrame:
    """Skeins of every thread of a pattern by its own fabric count, else the owner's, else the usual one, and whether the stock lacks them.

    needs: pattern_id, id, blend_id, stitches, fabric; profiles: pattern_id, fabric. Both threads of a blend are needed.
    """
    set_ = needs.join(profiles.select("pattern_id", F.col("fabric").alias("usual")), "pattern_id", "left").withColumn("count", F.coalesce("fabric", "usual", F.lit(fabric)))
    ids = F.explode(F.array_compact(F.array("id", "blend_id")))
    skeins = F.ceil(F.col("stitches") * F.lit(14) / F.col("count") * _skeins_per_stitch()).cast("long")
    per = set_.withColumn("thread", ids).groupBy("pattern_id", "thread").agg(F.sum(skeins).alias("needed"))
    j = per.join(stash.select(F.col("id").alias("thread"), "owned"), "thread", "left").fillna(0, ["owned"])
    return j.select("pattern_id", "thread", "needed", (F.col("owned") < F.col("needed")).alias("missing"))


def _skeins_per_stitch() -> float:
    """Of the usual fabric, two strands and a fifth of waste."""
    return 2.54 / 14 * 4.8 * 2 / (8.0 * 100 * 6 * (1 - 0.2))


def missing_counts(threads: DataFrame) -> DataFrame:
    return threads.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_threads"), F.sum("needed").alias("needed"), F.count_if("missing").alias("n_missing"))


def total_owned(stash: DataFrame) -> DataFrame:
    return stash.agg(F.coalesce(F.sum("owned"), F.lit(0)).alias("owned"), F.count_if(F.col("owned") > 0).alias("n_threads"))


def coverage(catalogue: DataFrame, stash: DataFrame, brand: str = "dmc") -> DataFrame:
    """Distinct owned threads of a brand against its catalogue, in per cent."""
    own = stash.where((F.col("owned") > 0) & (F.col("brand") == brand)).agg(F.count_distinct("id").alias("owned"))
    size = catalogue.where(F.col("brand") == brand).agg(F.count(F.lit(1)).alias("total"))
    return own.crossJoin(F.broadcast(size)).select("owned", "total", F.when(F.col("total") > 0, F.col("owned") / F.col("total") * 100).otherwise(0.0).alias("percent"))  # one row each


def buying_headline(flow: DataFrame, least: int = 3) -> DataFrame:
    """What came against what was used, of months with added and used; without enough months or any change there is none."""
    t = flow.agg(F.count(F.lit(1)).alias("n"), F.sum("added").alias("added"), F.sum("used").alias("used")).where((F.col("n") >= least) & ((F.col("added") > 0) | (F.col("used") > 0)))
    rate = F.when(F.col("used") > 0, F.col("added") / F.col("used"))
    kind = F.when(rate.isNull() | (rate > 1.5), "adding").when(rate >= 0.8, "balanced").otherwise("using")
    return t.select("added", "used", tenth(rate).alias("ratio"), kind.alias("kind"))
