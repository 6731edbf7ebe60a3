"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only where both are one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "tessella")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query has shuffled goes from the disks when it ends; for queries that run once."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Lineage ends here, so a lost executor costs a read of the shared folder and
    not a run of everything before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() has written; no plan that still runs may read them."""
    for table in tables:
        if path := _places.pop(table, None):
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def as_view(table: DataFrame, view: DataFrame) -> DataFrame:
    """view, which reads only the table that cut() has written: discard(view) deletes that table."""
    _places[view] = _places.pop(table)
    return view


def bucketed(docs: DataFrame, key: str) -> DataFrame:
    """docs as a table in the shared folder, dealt by key into as many buckets as the session has shuffle partitions."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tessella_{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        docs.repartition(n, key).write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(n, key).sortBy(key).saveAsTable(name)
    table = spark.table(name)
    # The files stay, and table knows how they are dealt; the catalog keeps no trace.
    spark.sql(f"DROP TABLE {name}")
    return table


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that do not clash with those of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
