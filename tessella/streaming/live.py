"""Live sessions and counters as Structured Streaming jobs.

Inputs have project_id, ts (timestamp), completed and undone. The watermark
bounds state; what comes later than it is dropped, which is this engine's rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Columns of an activity file.
ACTIVITY = "project_id long, ts timestamp, completed long, undone long"


def activity_stream(spark, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Activities from JSON files that appear in a folder."""
    return spark.readStream.schema(ACTIVITY).option("maxFilesPerTrigger", files_per_trigger).json(path)


def live_sessions(activity: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap; their end is the last activity, not the end of the gap."""
    grouped = activity.withWatermark("ts", late).groupBy("project_id", F.session_window("ts", gap).alias("w"))
    out = grouped.agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.sum("completed").alias("completed"), F.sum("undone").alias("undone"))
    return out.where("completed + undone > 0").select("project_id", "start_time", "end_time", (F.col("completed") - F.col("undone")).alias("net"), F.greatest(F.lit(1), F.unix_seconds("end_time") - F.unix_seconds("start_time")).alias("seconds"))


def daily_counters(activity: DataFrame, late: str = "1 day") -> DataFrame:
    """Stitches of each project and day, updated as they come."""
    days = activity.withWatermark("ts", late).groupBy("project_id", F.window("ts", "1 day").alias("w"))
    return days.agg(F.sum(F.col("completed") - F.col("undone")).alias("net")).select("project_id", F.col("w.start").cast("date").alias("date"), "net")


def upserts(df: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run df in update mode; write gets each batch once more if a batch is repeated, so it must replace by key."""
    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write(batch))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
