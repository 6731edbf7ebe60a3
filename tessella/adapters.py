"""The driver's tables as domain tables: the only module that knows their names.

Each view has the DataFrame that builds it and the SQL of the same rows, which
oracles put in front of their own query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where an operator reads the time.
AS_OF = "2024-01-30"
CHART_WIDTH = 20
SKIP, EMPTY = "__skip__", "__empty__"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work sessions, one for each event; project_id is the user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("project_id"),
        F.col("event_id").alias("session_id"),
        F.col("ts").cast("date").alias("date"),
        F.col("ts").alias("start_time"),
        F.floor("value").cast("long").alias("net_stitches"),
        (60 + F.col("event_id") % 7200).cast("long").alias("duration_seconds"),
        F.array("event_type").alias("colours_worked"),
        F.col("event_id").alias("ord"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total stitches of each project: a quarter more than its sessions made."""
    return sessions(spark, sf_dir).groupBy("project_id").agg(F.sum("net_stitches").alias("done"), F.ceil(F.sum("net_stitches") * 5 / 4).cast("long").alias("total"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thread catalogue."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        F.when(key % 3 == 0, "anchor").otherwise("dmc").alias("brand"),
        key.alias("id"),
        F.col("p_name").alias("name"),
        (key * 37 % 256).cast("int").alias("r"),
        (key * 91 % 256).cast("int").alias("g"),
        (key * 151 % 256).cast("int").alias("b"),
        key.alias("ord"),
    )


def stash_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of stock: +1, or -1 for a returned line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("id"), F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("long").alias("delta"))


def stash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads in stock."""
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy(F.col("l_partkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "N").alias("owned"), F.min(F.col("l_shipdate").cast("date")).alias("added_at"), (F.count(F.lit(1)) % 4).alias("min_stock"))
    return s.withColumns({"brand": F.when(F.col("id") % 3 == 0, "anchor").otherwise("dmc"), "owned": (F.col("owned") % 9).cast("long"), "tobuy": F.col("id") % 7 == 0})


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns, one for each order."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "wishlist").when(F.col("o_orderstatus") == "P", "inprogress").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("pattern_id"), F.concat(F.lit("Pattern "), F.col("o_orderkey").cast("string")).alias("title"), (F.col("o_custkey") % 40).alias("designer"), status.alias("status"), F.col("o_orderdate").cast("date").alias("created_at"), F.col("o_orderpriority").alias("tag"), F.floor("o_totalprice").cast("long").alias("size"), F.when(F.col("o_orderstatus") == "F", F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 300).cast("int"))).alias("completed_at"))


def library_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads that patterns ask for, in stitches."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("pattern_id"), F.col("l_partkey").alias("id"), (F.col("l_quantity") * 100).cast("long").alias("stitches"), F.col("l_linenumber").cast("long").alias("ord"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts, one for each supplier, 20 cells wide, with sentinels and blends; numbered within their chart."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    k = F.col("l_partkey") % 8
    thread = F.when(k == 0, SKIP).when(F.col("l_partkey") % 40 == 1, EMPTY).when(k == 7, "t2+t3").otherwise(F.concat(F.lit("t"), k.cast("string")))
    n = li.select(F.col("l_suppkey").alias("project_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), thread.alias("thread_id"), (F.col("l_linestatus") == "F").cast("int").alias("done"))
    return n.withColumns({"x": F.col("idx") % CHART_WIDTH, "y": F.floor(F.col("idx") / CHART_WIDTH)})


def lab_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in CIE Lab, widened to double before any arithmetic."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    return e.select(F.col("vec_id").alias("id"), (50 + 100 * at(0)).alias("l"), (200 * at(1)).alias("a"), (200 * at(2)).alias("b"))


SQL = {
    "sessions": "SELECT user_id AS project_id, event_id AS session_id, CAST(ts AS DATE) AS date, ts AS start_time, CAST(floor(value) AS BIGINT) AS net_stitches, CAST(60 + event_id % 7200 AS BIGINT) AS duration_seconds, event_type AS colour, event_id AS ord FROM events",
    "targets": "SELECT project_id, CAST(sum(net_stitches) AS BIGINT) AS done, CAST(ceil(sum(net_stitches) * 5 / 4) AS BIGINT) AS total FROM sessions GROUP BY project_id",
    "threads": "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'anchor' ELSE 'dmc' END AS brand, p_partkey AS id, p_name AS name, CAST(p_partkey * 37 % 256 AS INTEGER) AS r, CAST(p_partkey * 91 % 256 AS INTEGER) AS g, CAST(p_partkey * 151 % 256 AS INTEGER) AS b, p_partkey AS ord FROM part",
    "stash_history": "SELECT l_partkey AS id, CAST(l_shipdate AS DATE) AS date, CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS BIGINT) AS delta FROM lineitem",
    "stash": "SELECT l_partkey AS id, CASE WHEN l_partkey % 3 = 0 THEN 'anchor' ELSE 'dmc' END AS brand, CAST(count(*) FILTER (l_returnflag = 'N') % 9 AS BIGINT) AS owned, min(CAST(l_shipdate AS DATE)) AS added_at, count(*) % 4 AS min_stock, l_partkey % 7 = 0 AS tobuy FROM lineitem GROUP BY l_partkey",
    "library": "SELECT o_orderkey AS pattern_id, 'Pattern ' || o_orderkey AS title, o_custkey % 40 AS designer, CASE o_orderstatus WHEN 'O' THEN 'wishlist' WHEN 'P' THEN 'inprogress' ELSE 'completed' END AS status, CAST(o_orderdate AS DATE) AS created_at, o_orderpriority AS tag, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INTEGER) END AS completed_at FROM orders",
    "library_threads": "SELECT l_orderkey AS pattern_id, l_partkey AS id, CAST(l_quantity * 100 AS BIGINT) AS stitches, CAST(l_linenumber AS BIGINT) AS ord FROM lineitem",
    "cells": """SELECT *, idx % 20 AS x, idx // 20 AS y FROM (SELECT l_suppkey AS project_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS idx,
        CASE WHEN l_partkey % 8 = 0 THEN '__skip__' WHEN l_partkey % 40 = 1 THEN '__empty__' WHEN l_partkey % 8 = 7 THEN 't2+t3' ELSE 't' || (l_partkey % 8) END AS thread_id, CAST(l_linestatus = 'F' AS INTEGER) AS done FROM lineitem)""",
    "lab_points": "SELECT vec_id AS id, 50 + 100 * CAST(embedding[1] AS DOUBLE) AS l, 200 * CAST(embedding[2] AS DOUBLE) AS a, 200 * CAST(embedding[3] AS DOUBLE) AS b FROM embeddings",
}


def sql(views: str, body: str) -> str:
    """body with the named views in front, in their order; a body may begin with further WITH entries and a comma."""
    heads = ", ".join(f"{v} AS ({SQL[v]})" for v in views.split())
    return f"WITH {heads}{body}" if body.lstrip().startswith(",") else f"WITH {heads} {body}"
