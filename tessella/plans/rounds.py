"""Plans that run in rounds: each round ends in a table in the session's shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Links of a group up to which all of them lie in one task.
GROUP_LINKS = 1_000_000
#: Rounds in one plan.
AT_ONCE = 2
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(df: DataFrame) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where the session is one process."""
    conf = df.sparkSession.conf
    if found := conf.get("spark.checkpoint.dir", None):
        return found
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "tessella")


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """df written into the shared folder, so that rounds do not pile up and a lost executor costs a read. What was shuffled for it goes from the disks."""
    path = f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the shared folder, dealt by key into as many buckets as the session has shuffle partitions: joins and groups by key leave it where it is."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tessella_{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.repartition(n, key).write.option("path", f"{shared_folder(df)}/{name}").bucketBy(n, key).sortBy(key).saveAsTable(name)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.table(name)
    # The files stay, and table knows how they are dealt; the catalog keeps no trace.
    spark.sql(f"DROP TABLE {name}")
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that settled() has written; no plan that still runs may read them."""
    for table in tables:
        if path := _places.pop(table, None):
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def starred(links: DataFrame, group: str, by_group: bool) -> DataFrame:
    """links (group, u, v with u > v) after AT_ONCE large-star and small-star steps, and whether a step moved them."""
    node = Window.partitionBy(group, "u")
    after = (links.repartition(group) if by_group else links).withColumn("moved", F.lit(False))
    for _ in range(AT_ONCE):
        both = after.select(group, "moved", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("s")).select(group, "moved", "s.*")
        large = both.withColumn("m", F.least("u", F.min("v").over(node))).where("v > u")
        large = large.groupBy(group, F.col("v").alias("u"), F.col("m").alias("v")).agg(F.max(F.col("moved") | (F.col("m") != F.col("u"))).alias("moved"))
        low = large.withColumn("m", F.min("v").over(node))
        to = lambda n, moved: F.struct(F.col(n).alias("u"), F.col("m").alias("v"), moved.alias("moved"))
        steps = F.when(F.col("v") == F.col("m"), F.array(to("u", F.col("moved")))).otherwise(F.array(to("u", F.lit(True)), to("v", F.lit(True))))
        after = low.select(group, F.explode(steps).alias("s")).select(group, "s.*").groupBy(group, "u", "v").agg(F.max("moved").alias("moved"))
    return after


def least_reached(links: DataFrame, group: str) -> DataFrame:
    """group, node, root: the least node that links (group, u, v with u > v) reach, for every node with a link.

    Large-star and small-star steps take turns until the links are stars. The
    steps are windows over a node's links, so links that are dealt by group move
    once for several rounds; with a group of more than GROUP_LINKS links
    they are dealt by node.
    """
    links = settled(links.select(group, "u", "v"), "links")
    largest = links.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        after = settled(starred(links, group, largest <= GROUP_LINKS), "links")
        forget(links)
        links = after.drop("moved")
        _places[links] = _places.pop(after)
        # Steps that move no link found stars.
        if after.where("moved").isEmpty():
            break
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return links.select(group, F.explode(ends).alias("s")).select(group, "s.*").distinct()
