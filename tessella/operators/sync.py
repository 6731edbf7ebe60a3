"""Merging of snapshots from two devices. Every merge is one full join by key, so it is dealt by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sides(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Full join with the sides as structs l and r, null where a side has no row."""
    pack = lambda df, name: df.select(*key, F.struct(*(c for c in df.columns if c not in key)).alias(name))
    return pack(local, "l").join(pack(remote, "r"), key, "full_outer")


def merge_done(local: DataFrame, remote: DataFrame) -> DataFrame:
    """A cell is done if either side has it done."""
    both = _sides(local.select("project_id", "idx", "done"), remote.select("project_id", "idx", "done"), ["project_id", "idx"])
    return both.select("project_id", "idx", F.greatest(F.coalesce("l.done", F.lit(0)), F.coalesce("r.done", F.lit(0))).alias("done"))


def merge_sessions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Union without repeats by day, duration and stitches; the local one of equal ones, then the first."""
    both = local.withColumn("side", F.lit(0)).unionByName(remote.withColumn("side", F.lit(1)))
    order = Window.partitionBy("project_id", "date", "duration_seconds", "net_stitches").orderBy("side", "ord")
    return both.withColumn("i", F.row_number().over(order)).where("i = 1").drop("i", "side")


def merge_stash(local: DataFrame, remote: DataFrame) -> DataFrame:
    """More stock, either flag, the higher minimum, the local date where there is one."""
    b = _sides(local.select("id", "owned", "tobuy", "min_stock", "added_at"), remote.select("id", "owned", "tobuy", "min_stock", "added_at"), ["id"])
    return b.select("id", F.greatest("l.owned", "r.owned").alias("owned"), (F.coalesce("l.tobuy", F.lit(False)) | F.coalesce("r.tobuy", F.lit(False))).alias("tobuy"), F.greatest("l.min_stock", "r.min_stock").alias("min_stock"), F.coalesce("l.added_at", "r.added_at").alias("added_at"))


def upsert(local: DataFrame, remote: DataFrame, key: str = "pattern_id") -> DataFrame:
    """The newer row of each key; a tie keeps the local one."""
    both = local.withColumn("rank", F.lit(1)).unionByName(remote.withColumn("rank", F.lit(0)))
    cols = [c for c in local.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("updated_at", "rank")).alias("b"))
    return best.select(key, "b.*")


def three_way(local: DataFrame, remote: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """same, apply (only remote changed), keep (only local), conflict, added or removed for each key."""
    side = lambda df, name: df.select(key, F.col(value).alias(name))
    j = side(local, "l").join(side(remote, "r"), key, "full_outer").join(side(base, "s"), key, "full_outer")
    same: Column = F.col("l").eqNullSafe(F.col("r"))
    from_base = lambda c: F.col(c).eqNullSafe(F.col("s"))
    kind = F.when(same, "same").when(F.col("s").isNull() & F.col("l").isNull(), "added").when(F.col("s").isNull() & F.col("r").isNull(), "keep").when(F.col("s").isNull(), "conflict").when(from_base("l") & F.col("r").isNull(), "removed").when(from_base("l"), "apply").when(from_base("r"), "keep").otherwise("conflict")
    return j.select(key, kind.alias("kind"))


def fingerprints(cells: DataFrame) -> DataFrame:
    """A digest of each chart's ids in order, with its size; equal charts have equal digests."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "thread_id"))), lambda c: c["thread_id"])
    return cells.groupBy("project_id").agg(F.sha2(F.array_join(ids, ","), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def match(remote: DataFrame, local: DataFrame) -> DataFrame:
    """For each remote project its local one: the same id, else an equal fingerprint that nobody else claimed, else none.

    Both have project_id, fingerprint and ord. Ids win everywhere; what is left
    on both sides is ranked by order within its fingerprint and paired by rank.
    """
    by_id = remote.join(local.select("project_id"), "project_id").select("project_id", F.col("project_id").alias("local_id"), F.lit("id").alias("how"))
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("ord"))
    left = remote.join(by_id.select("project_id"), "project_id", "left_anti").withColumn("rank", rank)
    free = local.join(by_id.select("project_id"), "project_id", "left_anti").withColumn("rank", rank).select("fingerprint", "rank", F.col("project_id").alias("local_id"))
    rest = left.join(free, ["fingerprint", "rank"], "left").select("project_id", "local_id", F.when(F.col("local_id").isNotNull(), "fingerprint").otherwise("new").alias("how"))
    return by_id.unionByName(rest).withColumn("canonical_id", F.least("project_id", F.coalesce("local_id", "project_id")))


def import_plan(matches: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """new, identical, merge (same chart, other time) or conflict for remote rows; local-only for the others."""
    r = matches.join(remote.select("project_id", F.col("fingerprint").alias("rf"), F.col("updated_at").alias("ru")), "project_id")
    l = local.select(F.col("project_id").alias("local_id"), F.col("fingerprint").alias("lf"), F.col("updated_at").alias("lu"))  # noqa: E741
    kind = F.when(F.col("lf").isNull(), "new").when(F.col("rf") != F.col("lf"), "conflict").when(F.col("ru") == F.col("lu"), "identical").otherwise("merge")
    plan = r.join(l, "local_id", "left").select("project_id", kind.alias("kind"))
    only = l.join(matches.select("local_id"), "local_id", "left_anti").select(F.col("local_id").alias("project_id"), F.lit("local-only").alias("kind"))
    return plan.unionByName(only)


def newly_done(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells done since a snapshot, by chart."""
    j = after.select("project_id", "idx", "done").join(before.select("project_id", "idx", F.col("done").alias("was")), ["project_id", "idx"])
    return j.groupBy("project_id").agg(F.count_if((F.col("done") == 1) & (F.col("was") == 0)).alias("new"), (F.sum("done") - F.sum("was")).alias("delta"))


def kept_snapshots(snapshots: DataFrame, last: int = 60) -> DataFrame:
    """All labelled snapshots, and the last automatic ones of each project."""
    order = Window.partitionBy("project_id", F.col("label").isNull()).orderBy(F.desc("ts"), F.desc("snapshot_id"))
    return snapshots.withColumn("i", F.row_number().over(order)).where(F.col("label").isNotNull() | (F.col("i") <= last)).drop("i")


def copy_titles(titles: DataFrame) -> DataFrame:
    """id and title, where a repeated title gets (copy), then (copy 2) and so on."""
    i = F.row_number().over(Window.partitionBy("title").orderBy("id"))
    t = F.col("title")
    return titles.withColumn("i", i).select("id", F.when(F.col("i") == 1, t).when(F.col("i") == 2, F.concat(t, F.lit(" (copy)"))).otherwise(F.concat(t, F.lit(" (copy "), (F.col("i") - 1).cast("string"), F.lit(")"))).alias("title"))
