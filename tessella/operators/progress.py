"""Progress inside charts: half stitches, blocks, markers, colours, estimates and comparisons.

cells are charts (see grid); halves: project_id, idx, thread_id, fwd, bck,
fwd_done, bck_done (0 or 1); markers: project_id, x, y, colour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import js_round, ratio, tenth
from tessella.operators import grid


def half_counts(halves: DataFrame) -> DataFrame:
    """Half stitches and done ones; a cell can hold one in each direction."""
    return halves.groupBy("project_id").agg(F.sum(F.col("fwd") + F.col("bck")).alias("total"), F.sum(F.col("fwd_done") + F.col("bck_done")).alias("done"))


def combined(cells: DataFrame, halves: DataFrame, full: bool = True, half: bool = True) -> DataFrame:
    """Whole stitches and half ones at a half, of the layers that are shown, in per cent to a tenth; 0 without any."""
    whole = grid.stitchable(cells).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("done").alias("d"))
    j = whole.join(half_counts(halves), "project_id", "left").fillna(0, ["total", "done"])
    total = F.lit(float(full)) * F.col("n") + F.lit(0.5 * half) * F.col("total")
    done = F.lit(float(full)) * F.col("d") + F.lit(0.5 * half) * F.col("done")
    return j.select("project_id", total.alias("total"), done.alias("done"), F.coalesce(tenth(ratio(done * 100, total)), F.lit(0.0)).alias("percent"))


def parked(markers: DataFrame) -> DataFrame:
    """Markers of each colour of a chart; those without colour count nowhere."""
    return markers.where("colour is not null").groupBy("project_id", "colour").agg(F.count(F.lit(1)).alias("n"))


def focusable(progress: DataFrame, only_started: bool = True, skip_done: bool = True) -> DataFrame:
    """Colours to work on (project_id, thread, done, total): begun and unfinished ones; a filter that leaves a chart none does not apply to it."""
    per = Window.partitionBy("project_id")
    out = progress
    for wanted, keep in ((only_started, F.col("done") > 0), (skip_done, F.col("done") < F.col("total"))):
        if wanted:
            out = out.withColumns({"keep": keep, "any": F.max(keep).over(per)}).where("keep or not any").drop("keep", "any")
    return out


def blocks(cells: DataFrame, markers: DataFrame, size: int = 10) -> DataFrame:
    """Stitches of each square block, and whether all of them are done or parked; a block without stitches is complete."""
    parks = markers.select("project_id", "x", "y").distinct().withColumn("parked", F.lit(True))
    live = ~F.col("thread_id").isin(*grid.SENTINELS)
    open_ = live & (F.col("done") == 0) & F.col("parked").isNull()
    j = cells.join(parks, ["project_id", "x", "y"], "left")
    return j.groupBy("project_id", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by")).agg(F.count_if(live).alias("n"), (F.count_if(open_) == 0).alias("complete"))


def block_order(sizes: DataFrame, size: int = 10, corner: str = "TL", step: tuple[int, int] = (1, 1)) -> DataFrame:
    """Blocks row by row, each with the one that follows it, and the one that a step from it leads to, held inside the chart; the one to start from is marked.

    sizes: project_id, w, h. corner: TL, TR, BL, BR or C.
    """
    cols, rows = (F.ceil(F.col(c) / size).cast("long") for c in ("w", "h"))
    start = {"TL": (F.lit(0), F.lit(0)), "TR": (cols - 1, F.lit(0)), "BL": (F.lit(0), rows - 1), "BR": (cols - 1, rows - 1), "C": (F.floor(cols / 2), F.floor(rows / 2))}[corner]
    one = sizes.select("project_id", cols.alias("cols"), rows.alias("rows"), *(v.cast("long").alias(n) for n, v in zip(("sx", "sy"), start, strict=True)))
    all_ = one.withColumn("by", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("bx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    order = Window.partitionBy("project_id").orderBy("by", "bx")
    held = lambda c, d, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.col(c) + d)).cast("long")
    return all_.select("project_id", "bx", "by", F.lead("bx").over(order).alias("next_x"), F.lead("by").over(order).alias("next_y"), held("bx", step[0], "cols").alias("step_x"), held("by", step[1], "rows").alias("step_y"), ((F.col("bx") == F.col("sx")) & (F.col("by") == F.col("sy"))).alias("first"))


def completion_log(events: DataFrame, last: int = 500) -> DataFrame:
    """The last completions of blocks (project_id, session, bx, by, at) of each project, numbered inside their session."""
    order = Window.partitionBy("project_id", "session").orderBy("at", "by", "bx")
    back = Window.partitionBy("project_id").orderBy(F.desc("at"), F.desc("session"), F.desc("by"), F.desc("bx"))
    return events.withColumns({"sequence": F.row_number().over(order), "back": F.row_number().over(back)}).where(F.col("back") <= last).drop("back")


def timeline_with_completion(timeline: DataFrame, progress: DataFrame) -> DataFrame:
    """Every colour of a chart (project_id, thread, done, total) with its days and sessions, if any, and its completion."""
    j = progress.withColumnRenamed("thread", "colour").join(timeline, ["project_id", "colour"], "left")
    return j.select("project_id", "colour", "first_date", "last_date", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), F.coalesce(js_round(ratio(F.col("done") * 100, F.col("total"))), F.lit(0)).cast("long").alias("percent"), ((F.col("total") > 0) & (F.col("done") >= F.col("total"))).alias("complete"))


def time_estimates(projects: DataFrame, per_hour: int = 40) -> DataFrame:
    """Seconds for all stitches and for those left at a speed, and the speed that sessions showed: done, total, seconds."""
    observed = F.when((F.col("seconds") > 0) & (F.col("done") > 0), js_round(F.col("done") / (F.col("seconds") / 3600))).cast("long")
    at = lambda n: js_round(n / per_hour * 3600).cast("long")
    return projects.select("project_id", at(F.col("total")).alias("all_seconds"), F.greatest(F.lit(0), at(F.col("total") - F.col("done"))).alias("left_seconds"), observed.alias("per_hour"))


def hours_left(projects: DataFrame, usual: int = 100) -> DataFrame:
    """Hours at a project's own speed, or the usual one; done, total, per_hour."""
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    return projects.select("project_id", (left / F.when(F.col("per_hour") > 0, F.col("per_hour")).otherwise(usual)).cast("double").alias("hours"))


def comparison(projects: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Share done of each project, and its position by every key in descending order and by share."""
    share = F.coalesce(ratio(F.col("done"), F.col("total")), F.lit(0.0))
    ranked = projects.withColumn("share", share)
    place = lambda key: F.rank().over(Window.partitionBy("owner").orderBy(F.desc(key), "project_id")).alias(f"by_{key}")
    return ranked.select("owner", "project_id", "share", *(place(k) for k in (*keys, "share")))


def top_by_share(projects: DataFrame, n: int = 6) -> DataFrame:
    """The n projects that are furthest."""
    share = F.coalesce(ratio(F.col("done"), F.col("total")), F.lit(0.0))
    return projects.select("project_id", share.alias("share")).orderBy(F.desc("share"), "project_id").limit(n)


def recommendations(impact: DataFrame, progress: DataFrame, dismissed: DataFrame, n: int = 3) -> DataFrame:
    """The n unfinished regions of each chart with most impact that were not dismissed (project_id, rx, ry), and the n unfinished colours with least left."""
    w = Window.partitionBy("project_id")
    regions = impact.where("score >= 0").join(dismissed, ["project_id", "rx", "ry"], "left_anti").withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "ry", "rx")))
    quick = progress.where("total > 0 and done < total").withColumn("rank", F.row_number().over(w.orderBy("remaining", "thread")))
    what = lambda df, kind, name: df.where(F.col("rank") <= n).select("project_id", F.lit(kind).alias("kind"), "rank", name.alias("what"))
    return what(regions, "region", F.concat_ws(",", "rx", "ry")).unionByName(what(quick, "colour", F.col("thread")))


def confetti_tier(percent: Column) -> Column:
    return F.when(percent < 2, "Excellent").when(percent < 5, "Good").when(percent < 8, "Moderate").when(percent < 15, "Challenging").otherwise("High confetti")


def thread_kilometres(stitches: Column) -> Column:
    """To a tenth, four millimetres for a stitch."""
    return tenth(F.coalesce(stitches, F.lit(0)) * 0.004 / 1000)


def lifetime(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stitches of each project by its daily log (project_id, count), or by its sessions where it has none."""
    logged = log.groupBy("project_id").agg(F.sum("count").alias("stitches"), F.lit("log").alias("source"))
    worked = sessions.groupBy("project_id").agg(F.sum(F.coalesce("net_stitches", F.lit(0))).alias("stitches"), F.lit("sessions").alias("source"))
    return logged.unionByName(worked.join(logged.select("project_id"), "project_id", "left_anti"))


def state_counts(library: DataFrame, year_start: str) -> DataFrame:
    """Patterns in progress, and those completed since the year began."""
    return library.agg(F.count_if(F.col("status") == "inprogress").alias("active"), F.count_if((F.col("status") == "completed") & (F.col("completed_at") >= F.lit(year_start).cast("date"))).alias("finished"))


def after_event(status: Column, event: Column, count: Column) -> Column:
    """A project's state after an event: stitches make a planned one active, finish and abandon say so."""
    return F.when(event == "finish", "completed").when(event == "abandon", "UFO").when((event == "stitch") & (status == "planned") & (count > 0), "active").otherwise(status)


def valid_sessions(sessions: DataFrame, start: str = "start_text", date: str = "date_text") -> DataFrame:
    """Sessions but those whose start cannot be read; without a start the date decides, and without either a session stays."""
    when = F.try_to_timestamp(F.col(start))
    on = F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd"))
    bad = F.when(F.col(start).isNotNull(), when.isNull()).when(F.col(date).isNotNull(), on.isNull()).otherwise(False)
    return sessions.where(~bad)


def goal_crossings(changes: DataFrame, goal: int) -> DataFrame:
    """When the total of a period reaches the goal: changes are project_id, period, at, ord, net. A total that falls below it again re-arms the goal."""
    w = Window.partitionBy("project_id", "period").orderBy("at", "ord")
    totals = changes.withColumn("total", F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reached = totals.withColumn("before", F.coalesce(F.lag("total").over(w), F.lit(0)))
    return reached.where((F.col("total") >= goal) & (F.col("before") < goal)).select("project_id", "period", "at", "total")


#: Corners of a cell in reading order.
CORNERS = ("TL", "TR", "BL", "BR")


def partial_stitches(partials: DataFrame) -> DataFrame:
    """How the corners of a cell are stitched: project_id, idx, base, and an id or null for each of TL, TR, BL and BR.

    A corner without an id of its own has the base. Three corners of one colour are a
    three-quarter stitch (its place is the empty corner), two on a diagonal a half
    stitch (its place is the direction), and other corners with an id of their own quarters.
    """
    base = F.when(~F.col("base").isin(*grid.SENTINELS), F.col("base"))
    each = partials.select("project_id", "idx", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(q).alias("corner"), F.col(q).isNotNull().alias("own"), F.coalesce(q, base).alias("thread")) for i, q in enumerate(CORNERS)))).alias("c"))
    filled = each.select("project_id", "idx", "c.*").where("thread is not null")
    names = F.transform(F.array_sort(F.collect_list(F.struct("k", "corner"))), lambda x: x["corner"])
    groups = filled.groupBy("project_id", "idx", "thread").agg(names.alias("corners"), F.collect_list(F.when(F.col("own"), F.col("corner"))).alias("own"))
    joined = F.array_join("corners", ",")
    way = F.when(joined == "TR,BL", "fwd").when(joined == "TL,BR", "bck")
    whole = groups.withColumn("kind", F.when(F.size("corners") == 3, "three-quarter").when(way.isNotNull(), "half"))
    place = F.when(F.col("kind") == "half", way).otherwise(F.array_except(F.array(*map(F.lit, CORNERS)), F.col("corners"))[0])
    made = whole.where("kind is not null").select("project_id", "idx", "thread", "kind", place.alias("place"))
    return made.unionByName(whole.where("kind is null").select("project_id", "idx", "thread", F.lit("quarter").alias("kind"), F.explode("own").alias("place")))


def paused_exports(changes: DataFrame, seconds: int = 30) -> DataFrame:
    """project_id, export_at, n_changes: one export for each run of changes, so many seconds after the last of them. changes: project_id, at."""
    runs = changes.groupBy("project_id", F.session_window("at", f"{seconds} seconds").alias("w")).agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n_changes"))
    return runs.select("project_id", (F.col("last") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("export_at"), "n_changes")
