"""Scans, lookups, searches and sort orders of lists.

A sort order is given as a position within its group, so that a result keeps it
wherever its rows go.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup(keys: DataFrame, catalogue: DataFrame) -> DataFrame:
    """keys (brand, id as text) with the catalogue's name; ids match in any case, unknown ones keep their id as name."""
    known = catalogue.select("brand", F.lower(F.col("id").cast("string")).alias("k"), "name")
    return keys.withColumn("k", F.lower("id")).join(known, ["brand", "k"], "left").select("brand", "id", F.coalesce("name", "id").alias("name"))


def key_of(brand: Column, thread_id: Column) -> Column:
    """brand:id; an id without brand belongs to dmc."""
    return F.when(thread_id.contains(":"), thread_id).otherwise(F.concat(F.coalesce(brand, F.lit("dmc")), F.lit(":"), thread_id))


def split_key(key: Column) -> Column:
    """brand and id of a key; one without brand belongs to dmc."""
    has = key.contains(":")
    brand = F.when(has, F.substring_index(key, ":", 1)).otherwise("dmc")
    return F.struct(brand.alias("brand"), F.when(has, F.substr(key, F.length(brand) + 2)).otherwise(key).alias("id"))


def search_threads(threads: DataFrame, text: str, brand: str | None = None) -> DataFrame:
    """Threads whose id or name contains the text in any case."""
    t = text.lower()
    found = threads.where(F.lower(F.col("id").cast("string")).contains(t) | F.lower("name").contains(t))
    return found if brand is None else found.where(F.col("brand") == brand)


def autocomplete(threads: DataFrame, text: str, n: int = 10) -> DataFrame:
    """The first n matches in catalogue order."""
    return search_threads(threads, text).orderBy("ord").limit(n)


def search_patterns(library: DataFrame, text: str, status: str | None = None) -> DataFrame:
    """Patterns whose title or tag contains the text in any case."""
    t = text.lower()
    found = library.where(F.lower("title").contains(t) | F.lower("tag").contains(t))
    return found if status is None else found.where(F.col("status") == status)


def thread_orders(threads: DataFrame, stash: DataFrame) -> DataFrame:
    """Positions of each brand's threads by number, by name and by stock, most first."""
    j = threads.join(stash.select("id", "owned"), "id", "left").withColumn("owned", F.coalesce("owned", F.lit(0)))
    w = Window.partitionBy("brand")
    return j.select("brand", "id", F.row_number().over(w.orderBy("id")).alias("by_number"), F.row_number().over(w.orderBy("name", "id")).alias("by_name"), F.row_number().over(w.orderBy(F.desc("owned"), "id")).alias("by_stock"))


def status_order(status: Column) -> Column:
    return F.when(status == "inprogress", 0).when(status == "owned", 1).when(status == "wishlist", 2).when(status == "completed", 3).otherwise(4)


def pattern_orders(library: DataFrame) -> DataFrame:
    """Positions of each designer's patterns by title and by status and title."""
    w = Window.partitionBy("designer")
    return library.select("pattern_id", F.row_number().over(w.orderBy("title", "pattern_id")).alias("by_title"), F.row_number().over(w.orderBy(status_order(F.col("status")), "title", "pattern_id")).alias("by_status"))


def fuzzy_commands(commands: DataFrame, text: str) -> DataFrame:
    """Scores of labels: 100 for a start, 80 for a word's start, 60 for a part, 50 for the letters in order; others go."""
    label = F.lower("label")
    t = text.lower()
    in_order = ".*".join(("", *map(re.escape, t), ""))
    score = F.when(label.startswith(t), 100).when(label.contains(f" {t}"), 80).when(label.contains(t), 60).when(label.rlike(in_order), 50).otherwise(0)
    return commands.withColumn("score", score).where("score > 0")


def specialty(thread_id: Column) -> Column:
    """Ids that start with E or S, or have four digits from 4000 on."""
    return F.upper(thread_id).rlike("^[ES]") | thread_id.rlike("^4[0-9]{3}$")


def project_states(projects: DataFrame) -> DataFrame:
    """complete, active, design or queued, unless a state is set: projects have done, total, source, n_sessions, override."""
    state = F.when((F.col("total") > 0) & (F.col("done") >= F.col("total")), "complete").when(F.col("done") > 0, "active").when((F.col("source") == "creator") & (F.col("n_sessions") == 0), "design").otherwise("queued")
    return projects.select("project_id", F.coalesce("override", state).alias("state"))


def oldest_open(projects: DataFrame, n: int = 3) -> DataFrame:
    """The n open projects touched longest ago: last_touched, else created."""
    return projects.where("done < total").withColumn("since", F.coalesce("last_touched", "created_at")).orderBy("since", "project_id").limit(n).select("project_id", "since")


def next_project(projects: DataFrame, as_of: str) -> DataFrame:
    """The project to take up next: up to 30 for idle days, 20 from 80 % (5 from 50 %) done, 10 if the stock is ready."""
    days = F.date_diff(F.lit(as_of).cast("date"), "last_touched")
    share = F.col("done") / F.greatest(F.col("total"), F.lit(1))
    # least() takes no notice of nulls.
    score = F.coalesce(F.when(days.isNotNull(), F.least(F.lit(30), 3 * days)), F.lit(0)) + F.when(share >= 0.8, 20).when(share >= 0.5, 5).otherwise(0) + F.when(F.col("ready"), 10).otherwise(0)
    best = projects.where("done < total").withColumn("score", score)
    return best.orderBy(F.desc("score"), "project_id").limit(1).select("project_id", F.col("score").cast("long").alias("score"))
