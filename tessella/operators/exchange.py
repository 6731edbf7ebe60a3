"""Carrying out an import from another device: projects, the tables that hang on them, and the log of deletions.

One table of ids says what becomes of every project's rows on either side; all
other tables follow from it by one join on the project, so a project that gets
another id gets it everywhere. Merged rows are aggregates by key, whose partial
sums keep a large project from meeting in one task before they are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deleted ids that are remembered.
LOG_CAP = 200
COPY_SUFFIX = " (synced)"
CORNERS = ("TL", "TR", "BL", "BR")


def new_ids(matches: DataFrame, plan: DataFrame, local: DataFrame, choices: DataFrame, fresh: Callable[[Column], Column]) -> DataFrame:
    """side, project_id, new_id, role: what becomes of the rows of every project on either side.

    matches and plan are those of sync.match and sync.import_plan; local has
    project_id; choices: project_id (the remote one) and choice of keep-local,
    keep-remote and keep-both for conflicts, of which keep-local is the default.
    Roles: keep (as it is), take (remote rows come in), merge (both sides' rows
    meet under the lesser id), copy (remote rows come in under fresh(id), an id
    not in use) and drop.
    """
    choice = F.coalesce("choice", F.lit("keep-local"))
    conflict = F.col("kind") == "conflict"
    j = matches.select("project_id", "local_id", "canonical_id").join(plan.where("kind <> 'local-only'"), "project_id").join(choices.select("project_id", "choice"), "project_id", "left")
    remote_role = F.when(F.col("kind") == "new", "take").when(F.col("kind") == "merge", "merge").when(conflict & (choice == "keep-remote"), "take").when(conflict & (choice == "keep-both"), "copy").otherwise("drop")
    local_role = F.when(F.col("kind") == "merge", "merge").when(conflict & (choice == "keep-remote"), "drop").otherwise("keep")
    target = F.when(F.col("kind") == "merge", F.col("canonical_id"))
    remote_ids = j.select(F.lit("remote").alias("side"), "project_id", F.when(remote_role == "copy", fresh(F.col("project_id"))).otherwise(F.coalesce(target, "project_id")).alias("new_id"), remote_role.alias("role"))
    met = j.where("local_id is not null").select(F.col("local_id").alias("project_id"), target.alias("target"), local_role.alias("met_role"))
    local_ids = local.select("project_id").join(met, "project_id", "left").select(F.lit("local").alias("side"), "project_id", F.coalesce("target", "project_id").alias("new_id"), F.coalesce("met_role", F.lit("keep")).alias("role"))
    return local_ids.unionByName(remote_ids)


def _sided(local: DataFrame, remote: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of both sides that stay, under their new ids, with side and role."""
    both = local.withColumn("side", F.lit("local")).unionByName(remote.withColumn("side", F.lit("remote")))
    return both.join(ids.where("role <> 'drop'"), ["side", "project_id"]).drop("project_id").withColumnRenamed("new_id", "project_id")


def merged_rows(local: DataFrame, remote: DataFrame, ids: DataFrame, keys: list[str], greatest: tuple[str, ...] = (), filled: tuple[str, ...] = ()) -> DataFrame:
    """A table that hangs on projects, after the import.

    Rows of merged projects meet by keys: the columns in greatest take the
    greater value, those in filled the local one or, where it is null, the
    remote one, and all others are the local row's where there is one. Of rows
    of one side that meet, the one with the least values counts. All other
    projects keep their rows.
    """
    rows = _sided(local, remote, ids)
    values = [c for c in local.columns if c not in ("project_id", *keys, *greatest, *filled)]
    met = rows.where("role = 'merge'").groupBy("project_id", *keys)
    first = [F.min(F.struct("side", *values)).alias("__first")] if values else []
    own = [F.min(F.when(F.col(c).isNotNull(), F.struct("side", c)))[c].alias(c) for c in filled]
    out = met.agg(*first, *(F.max(c).alias(c) for c in greatest), *own) if first or greatest or filled else rows.where("role = 'merge'").select("project_id", *keys).distinct()
    merged = out.select("project_id", *keys, *greatest, *filled, *(F.col("__first")[c].alias(c) for c in values))
    return rows.where("role <> 'merge'").select(*local.columns).unionByName(merged.select(*local.columns))


def merged_half_stitches(local: DataFrame, remote: DataFrame, ids: DataFrame) -> DataFrame:
    """project_id, idx and the id at each corner: corners that the local cell lacks come from the remote one."""
    return merged_rows(local, remote, ids, ["idx"], filled=CORNERS)


def merged_sessions(local: DataFrame, remote: DataFrame, ids: DataFrame) -> DataFrame:
    """Sessions with equal starts are one; without a start, those of equal date, duration and stitches. Columns: project_id, start, date, duration, net and more."""
    when = F.coalesce(F.concat(F.lit("s:"), F.col("start").cast("string")), F.concat_ws(":", F.lit("d"), F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("duration", F.lit(0)).cast("string"), F.coalesce("net", F.lit(0)).cast("string")))
    keyed = lambda df: df.withColumn("__key", when)
    return merged_rows(keyed(local), keyed(remote), ids, ["__key"]).drop("__key")


def merged_projects(local: DataFrame, remote: DataFrame, ids: DataFrame, fields: DataFrame) -> DataFrame:
    """project_id, name, state, seconds, created_at, updated_at of all projects after the import.

    fields: project_id (the local one), field (name or state) and choice. Without
    a choice the later change wins, the local one if neither is later; a remote
    null never does. Times of merged projects add up; a copy has no creation time
    and says so in its name.
    """
    columns = ["name", "state", "seconds", "created_at", "updated_at"]
    chosen = fields.groupBy("project_id").agg(*(F.max(F.when(F.col("field") == f, F.col("choice"))).alias(f"{f}_choice") for f in ("name", "state")))
    none = [F.lit(None).cast("string").alias(f"{f}_choice") for f in ("name", "state")]
    left = local.select("project_id", *columns).join(chosen, "project_id", "left")
    rows = _sided(left, remote.select("project_id", *columns, *none), ids)
    copy = F.col("role") == "copy"
    named = F.when(copy, F.concat(F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("Untitled")), F.lit(COPY_SUFFIX))).otherwise(F.col("name"))
    plain = rows.where("role <> 'merge'").select("project_id", named.alias("name"), "state", "seconds", F.when(~copy, F.col("created_at")).alias("created_at"), "updated_at")
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct(*columns, "name_choice", "state_choice"))).alias(s)
    met = rows.where("role = 'merge'").groupBy("project_id").agg(side("local"), side("remote"))
    newer = F.col("remote.updated_at").isNotNull() & (F.col("local.updated_at").isNull() | (F.col("remote.updated_at") > F.col("local.updated_at")))

    def pick(f: str) -> Column:
        theirs = F.when(F.col(f"local.{f}_choice").isNotNull(), F.col(f"local.{f}_choice") == "keep-remote").otherwise(newer)
        return F.when(theirs & F.col(f"remote.{f}").isNotNull(), F.col(f"remote.{f}")).otherwise(F.col(f"local.{f}")).alias(f)

    seconds = (F.coalesce("local.seconds", F.lit(0)) + F.coalesce("remote.seconds", F.lit(0))).alias("seconds")
    return plain.unionByName(met.select("project_id", pick("name"), pick("state"), seconds, F.col("local.created_at").alias("created_at"), F.greatest("local.updated_at", "remote.updated_at").alias("updated_at")))


def deletion_log(local: DataFrame, remote: DataFrame, ids: DataFrame, cap: int = LOG_CAP) -> DataFrame:
    """project_id and pos (from 0, oldest first) of the last cap deletions: this device's, then ids that a merge gave up here, then the other's that are not known yet.

    local and remote: project_id and pos.
    """
    given_up = ids.where("side = 'local' and project_id <> new_id").select("project_id", F.lit(1).alias("stage"), F.lit(0).cast("long").alias("pos"))
    logs = local.select("project_id", F.lit(0).alias("stage"), F.col("pos").cast("long").alias("pos")).unionByName(given_up).unionByName(remote.select("project_id", F.lit(2).alias("stage"), F.col("pos").cast("long").alias("pos")))
    first = logs.groupBy("project_id").agg(F.min(F.struct("stage", "pos")).alias("at"))
    last = first.select("project_id", "at.stage", "at.pos").orderBy(F.desc("stage"), F.desc("pos"), F.desc("project_id")).limit(cap)
    # At most cap rows: one array of them is small.
    listed = last.agg(F.array_sort(F.collect_list(F.struct("stage", "pos", "project_id"))).alias("log"))
    return listed.select(F.posexplode("log").alias("pos", "e")).select("e.project_id", "pos")


def synced(ids: DataFrame, plan: DataFrame) -> DataFrame:
    """Ids of the projects that an import marks as synced: new, merged and conflicting ones."""
    marked = plan.where("kind in ('new', 'merge', 'conflict')").select("project_id", "kind")
    j = ids.where("side = 'remote'").join(marked, "project_id")
    return j.select(F.when(F.col("kind") == "merge", F.col("new_id")).otherwise(F.col("project_id")).alias("project_id")).distinct()


def counts(plan: DataFrame) -> DataFrame:
    """One row: imported, merged, conflicts_resolved."""
    n = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return plan.agg(n("new", "imported"), n("merge", "merged"), n("conflict", "conflicts_resolved"))
