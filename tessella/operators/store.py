"""Stored projects, stock and libraries: reads, checks, keyed updates and merges.

Updates are DataFrames that stand for the table after a change, so a caller
writes them where the table lives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_project(key: Column) -> Column:
    return key.startswith("proj_")


def project(projects: DataFrame, project_id: str) -> DataFrame:
    """One project; keys of its own stock lose their brand, and of keys that become equal the first filled one stays."""
    bare = F.transform(F.array_sort(F.map_entries("owned")), lambda e: F.struct(F.element_at(F.split(e["key"], ":"), -1).alias("k"), e["value"].alias("v")))
    filled = F.filter(bare, lambda e: F.coalesce(e["v"], F.lit("")) != "")
    keys = F.array_distinct(F.transform(bare, lambda e: e["k"]))
    value = lambda k: F.try_element_at(F.transform(F.filter(F.col("filled"), lambda e: e["k"] == k), lambda e: e["v"]), F.lit(1))
    one = projects.where(F.col("project_id") == project_id).withColumns({"filled": filled, "keys": keys})
    return one.withColumn("owned", F.map_from_arrays("keys", F.transform("keys", value))).drop("filled", "keys")


def listed(metas: DataFrame) -> DataFrame:
    """Projects by last change, newest first, as a position in their owner's list."""
    order = Window.partitionBy("owner").orderBy(F.desc("updated_at"), "key")
    return metas.where(is_project(F.col("key"))).withColumn("position", F.row_number().over(order))


def paired(metas: DataFrame, fulls: DataFrame) -> DataFrame:
    """Every meta row with its full project, null where that is gone."""
    return metas.where(is_project(F.col("key"))).join(fulls, "key", "left")


def live_summaries(summaries: DataFrame, metas: DataFrame) -> DataFrame:
    """Summaries of projects that still have a meta row."""
    return summaries.where(is_project(F.col("key"))).join(metas.select("key"), "key", "left_semi")


def backup_findings(headers: DataFrame, entries: DataFrame, threads: DataFrame, patterns: DataFrame, format_: str) -> DataFrame:
    """Of each backup what is wrong with it, or its counts of projects, owned threads and patterns. format_: the tag that a readable backup has; headers: backup_id, format, version; others by backup_id."""
    count = lambda df, name: df.groupBy("backup_id").agg(F.count(F.lit(1)).cast("long").alias(name))
    j = headers.join(count(entries.where(is_project(F.col("key"))), "n_projects"), "backup_id", "left").join(count(threads.where("owned > 0"), "n_threads"), "backup_id", "left").join(count(patterns, "n_patterns"), "backup_id", "left")
    error = F.when(F.col("format").isNull() | (F.col("format") != format_), "format").when(F.col("version").isNull() | (F.col("version") != 1), "version")
    kept = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).alias(c)
    return j.withColumn("error", error).select("backup_id", "error", *(kept(c) for c in ("n_projects", "n_threads", "n_patterns")))


def sync_findings(files: DataFrame, format_: str) -> DataFrame:
    """Whether a sync file can be read: format, version 1, and a list of projects; and how many projects there are."""
    error = F.when(F.col("format").isNull() | (F.col("format") != format_), "format").when(F.col("version").isNull() | (F.col("version") != 1), "version").when(F.col("projects").isNull(), "projects")
    return files.select("file_id", error.alias("error"), F.when(error.isNull(), F.size("projects")).alias("n_projects"))


def fingerprint_index(fingerprints: DataFrame) -> DataFrame:
    """Projects of each fingerprint, least id first; empty charts and failures are in none."""
    good = fingerprints.where("fingerprint is not null and fingerprint not in ('empty', 'fp_error')")
    return good.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("project_id").alias("canonical_id"))


def merged_tracking(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Projects that both sides have: times add up, the newer name and state win unless a choice says otherwise.

    Columns: project_id, seconds, name, state, updated_at; local may have a
    choice ('keep-local' or 'keep-remote').
    """
    j = local.alias("l").join(remote.alias("r"), "project_id")
    remote_wins = (F.col("choice") == "keep-remote") | F.col("choice").isNull() & (F.col("r.updated_at") > F.col("l.updated_at"))
    pick = lambda c: F.when(remote_wins & F.col(f"r.{c}").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c)
    return j.select("project_id", (F.coalesce("l.seconds", F.lit(0)) + F.coalesce("r.seconds", F.lit(0))).alias("seconds"), pick("name"), pick("state"))


def filled_in(local: DataFrame, remote: DataFrame, keys: list[str], projects: DataFrame) -> DataFrame:
    """Rows of the local side, and of the remote one those whose key the local one lacks, for projects that both have: markers by place, milestones by percent, threads by id."""
    both = projects.select("project_id")
    mine, theirs = local.join(both, "project_id", "left_semi"), remote.join(both, "project_id", "left_semi")
    return mine.unionByName(theirs.join(mine, keys, "left_anti").dropDuplicates(keys))


def reconciled(patterns: DataFrame, projects: DataFrame) -> DataFrame:
    """The library after projects without an entry got one, and entries that were made so took their project's new name.

    patterns: pattern_id, title, linked_id, tags; projects: project_id, name.
    """
    j = patterns.join(projects.select(F.col("project_id").alias("linked_id"), "name"), "linked_id", "left")
    renamed = F.array_contains("tags", "auto-synced") & F.col("name").isNotNull()
    kept = j.select("pattern_id", F.when(renamed, F.col("name")).otherwise(F.col("title")).alias("title"), "linked_id", "tags")
    new = projects.join(patterns.select(F.col("linked_id").alias("project_id")), "project_id", "left_anti")
    made = new.select(F.concat(F.lit("auto_"), F.col("project_id").cast("string")).alias("pattern_id"), F.col("name").alias("title"), F.col("project_id").alias("linked_id"), F.array(F.lit("auto-synced")).alias("tags"))
    return kept.unionByName(made)


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with each row put in the place of the one with its key, or added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(table.columns))


def marked_synced(projects: DataFrame, done: DataFrame, at: str) -> DataFrame:
    """Projects after a sync: those done have the time and a version more."""
    j = projects.join(done.select("project_id").distinct().withColumn("hit", F.lit(True)), "project_id", "left")
    return j.select("project_id", F.when(F.col("hit"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("synced_at")).alias("synced_at"), (F.coalesce("version", F.lit(0)) + F.col("hit").isNotNull().cast("int")).alias("version"))


def snapshot(projects: DataFrame, stash: DataFrame) -> DataFrame:
    """What a sync remembers, as name and value: a project's name, state and last change, and the stock of every thread."""
    a = projects.select(F.concat(F.lit("project:"), F.col("project_id").cast("string")).alias("name"), F.concat_ws("|", "title", "state", F.col("updated_at").cast("string")).alias("value"))
    return a.unionByName(stash.select(F.concat(F.lit("thread:"), F.col("id").cast("string")).alias("name"), F.coalesce("owned", F.lit(0)).cast("string").alias("value")))


def to_buy(stash: DataFrame, changes: DataFrame, day: str) -> DataFrame:
    """The stock after flags to buy were set or taken away: changes have id, tobuy, qty; unknown threads come in unowned.

    A flag that goes takes quantity and date with it; setting one keeps an
    earlier date and quantity unless the change names a quantity.
    """
    j = stash.join(changes.select("id", F.col("tobuy").alias("want"), "qty", F.lit(True).alias("hit")), "id", "full_outer")
    want = F.coalesce("want", F.lit(False))
    flag = F.when(F.col("hit"), want).otherwise(F.coalesce("tobuy", F.lit(False)))
    qty = F.when(F.col("hit"), F.when(want, F.coalesce("qty", "tobuy_qty", F.lit(0))).otherwise(0)).otherwise(F.coalesce("tobuy_qty", F.lit(0)))
    since = F.when(F.col("hit"), F.when(want, F.coalesce("tobuy_at", F.lit(day).cast("date")))).otherwise(F.col("tobuy_at"))
    return j.select("id", F.coalesce("owned", F.lit(0)).alias("owned"), flag.alias("tobuy"), qty.cast("long").alias("tobuy_qty"), since.alias("tobuy_at"))


def cleared(stash: DataFrame) -> DataFrame:
    """The stock with nothing to buy."""
    return stash.select("id", "owned", F.lit(False).alias("tobuy"), F.lit(0).cast("long").alias("tobuy_qty"), F.lit(None).cast("date").alias("tobuy_at"))


def live_stock(stash: DataFrame, done: DataFrame, stitches_per_skein: int = 1890) -> DataFrame:
    """What is left of each thread after the stitches done with it: owned, consumed skeins, and the rest, not below 0. done: thread, stitches."""
    used = done.groupBy(F.col("thread").alias("id")).agg((F.sum("stitches") / stitches_per_skein).alias("consumed"))
    j = stash.join(used, "id", "left").withColumn("consumed", F.coalesce("consumed", F.lit(0.0)))
    return j.select("id", "owned", "consumed", F.greatest(F.lit(0.0), F.col("owned") - F.col("consumed")).alias("left"))


def rebased(baseline: DataFrame, seen: DataFrame, edits: DataFrame) -> DataFrame:
    """The baseline of live stock: where an edit from elsewhere (id, owned) differs from what was last seen, the edit plus what was consumed, else as it was. baseline: id, base, consumed; seen: id, owned."""
    j = baseline.join(seen.select("id", F.col("owned").alias("seen")), "id", "left").join(edits.select("id", F.col("owned").alias("edit")), "id", "left")
    outside = F.col("edit").isNotNull() & (F.col("seen").isNull() | (F.col("edit") != F.col("seen")))
    base = F.when(outside, F.col("edit") + F.col("consumed")).otherwise(F.col("base"))
    return j.select("id", base.alias("base"), F.greatest(F.lit(0.0), base - F.col("consumed")).alias("left"))


def with_expected(cells: DataFrame, catalogue: DataFrame) -> DataFrame:
    """cells with e_r, e_g, e_b: the catalogue's colour of their id, or the rounded mean of a blend's two; null where it is unknown. catalogue: id (text), r, g, b."""
    ids = F.split("thread_id", r"\+")
    known = lambda p: catalogue.select(F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in "rgb"))
    # The catalogue decides how it is joined: it is small, but nothing here bounds it.
    j = cells.withColumns({"p_id": F.trim(ids[0]), "q_id": F.when(F.size(ids) == 2, F.trim(F.try_element_at(ids, F.lit(2)))), "parts": F.size(ids)})
    j = j.join(known("p"), "p_id", "left").join(known("q"), "q_id", "left")
    colour = lambda c: F.when(F.col("parts") == 1, F.col(f"p_{c}")).when(F.col("parts") == 2, F.floor((F.col(f"p_{c}") + F.col(f"q_{c}")) / 2 + 0.5)).cast("int").alias(f"e_{c}")
    return j.select(*cells.columns, *(colour(c) for c in "rgb"))


def saved(cells: DataFrame, catalogue: DataFrame) -> DataFrame:
    """cells (project_id, idx, thread_id, r, g, b) as they are stored: without a colour that the catalogue gives back, and skipped and empty ones without any."""
    j = with_expected(cells, catalogue)
    same = F.coalesce(F.col("r").eqNullSafe(F.col("e_r")) & F.col("g").eqNullSafe(F.col("e_g")) & F.col("b").eqNullSafe(F.col("e_b")), F.lit(False))
    drop = same | F.col("thread_id").isin("__skip__", "__empty__")
    return j.select("project_id", "idx", "thread_id", *(F.when(~drop, F.col(c)).alias(c) for c in "rgb"))


def restored(cells: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Stored cells with their colours and kind again: skipped ones white, known ids as in the catalogue, others as stored, or grey."""
    j = with_expected(cells, catalogue)
    skip = F.col("thread_id") == "__skip__"
    kind = F.when(skip, "skip").when(F.col("thread_id").contains("+") & F.col("e_r").isNotNull(), "blend").otherwise("solid")
    return j.select("project_id", "idx", "thread_id", kind.alias("type"), *(F.when(skip, 255).otherwise(F.coalesce(f"e_{c}", c, F.lit(128))).cast("int").alias(c) for c in "rgb"))
