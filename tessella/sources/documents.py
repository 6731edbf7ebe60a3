"""Readers and writers of the domain's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SIDE = 5000

PROJECT = "id string, name string, w int, h int, updatedAt timestamp, pattern array<struct<id:string,type:string>>, p array<struct<id:string,type:string>>"


def read_projects_json(spark: SparkSession, path: str) -> DataFrame:
    """Project documents; the older field p serves where pattern lacks, and documents without either are left out."""
    raw = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    return raw.withColumn("pattern", F.coalesce("pattern", "p")).drop("p").where("pattern is not null").withColumn("id", F.coalesce("id", F.sha2(F.to_json("pattern"), 256)))


def cells_of(projects: DataFrame) -> DataFrame:
    """Cells of project documents, numbered row by row."""
    return projects.select(F.col("id").alias("project_id"), "w", F.posexplode("pattern").alias("idx", "cell")).select("project_id", F.col("idx").cast("long").alias("idx"), F.col("cell.id").alias("thread_id"), (F.col("idx") % F.col("w")).alias("x"), F.floor(F.col("idx") / F.col("w")).alias("y"))


#: What is read of a chart's XML; an attribute has a line in front of its name.
_SIDE = "_width:string,_w:string,_height:string,_h:string"
_COLOUR = "array<struct<_index:string,_idx:string,_id:string,_number:string,_code:string,_thread:string,_dmcnumber:string,_name:string,_description:string,_red:string,_r:string,_green:string,_g:string,_blue:string,_b:string,_color:string,_hex:string,_rgb:string>>"
CHART = f"{_SIDE.replace(':', ' ')}, properties struct<_chartwidth:string,_chartheight:string,{_SIDE}>, format struct<{_SIDE},chartwidth:string,chartheight:string>, size struct<{_SIDE}>, grid struct<{_SIDE}>, palette struct<color:{_COLOUR},thread:{_COLOUR},entry:{_COLOUR},palette_item:{_COLOUR}>, colors struct<color:{_COLOUR},thread:{_COLOUR},entry:{_COLOUR}>, fullstitches struct<stitch:array<struct<_x:string,_y:string,_palindex:string>>>"


def read_chart_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cells and palette of chart XML files.

    Sizes beyond MAX_SIDE, cells outside the chart and files without any cell
    are left out, so is a file that is no XML. An entry's palette number is its
    index, else its place from 0; colour is RRGGBB in capitals, or null.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.from_xml("value", CHART).alias("c"))
    first = lambda paths: F.coalesce(*(F.nullif(F.trim(F.col(f"c.{p}")), F.lit("")).try_cast("int") for p in paths.split()))
    w = first("properties._chartwidth properties._width _width _w format.chartwidth format._width format._w size._width size._w grid._width grid._w")
    h = first("properties._chartheight properties._height _height _h format.chartheight format._height format._h size._height size._h grid._height grid._h")
    size = raw.select("file", "c", w.alias("w"), h.alias("h")).where(f"w between 1 and {MAX_SIDE} and h between 1 and {MAX_SIDE}")
    stitches = size.select("file", "w", "h", F.explode("c.fullstitches.stitch").alias("s")).select("file", "w", "h", *(F.col(f"s._{n}").try_cast("int").alias(as_) for n, as_ in (("x", "x"), ("y", "y"), ("palindex", "palette"))))
    cells = stitches.where("x >= 0 and x < w and y >= 0 and y < h").select("file", (F.col("y").cast("long") * F.col("w") + F.col("x")).alias("idx"), "x", "y", "palette")
    lists = "palette.color palette.thread palette.entry palette.palette_item colors.color colors.thread colors.entry"
    any_of = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(f"e._{n}")), F.lit("")) for n in names.split()))
    entries = size.select("file", F.posexplode(F.coalesce(*(F.col(f"c.{n}") for n in lists.split()))).alias("place", "e"))
    channels = [any_of(n).try_cast("int") for n in ("red r", "green g", "blue b")]
    mixed = F.when(channels[0].isNotNull() & channels[1].isNotNull() & channels[2].isNotNull(), F.format_string("%02X%02X%02X", *channels))
    hexed = F.upper(F.regexp_replace(any_of("color hex rgb"), "^#", ""))
    palette = entries.select("file", F.coalesce(any_of("index idx id").try_cast("int"), "place").alias("palette"), any_of("number code thread dmcnumber").alias("number"), any_of("name description").alias("name"), F.coalesce(mixed, F.when(hexed.rlike("^[0-9A-F]{6}$"), hexed)).alias("color"))
    return {"cells": cells, "palette": palette}


def write_sessions_csv(sessions: DataFrame, path: str) -> None:
    """Sessions by start, with quotes inside notes doubled."""
    sessions.orderBy("start_time").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_backup(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as compressed JSON under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def read_backup(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def changed_since(df: DataFrame, last_export: str | None) -> DataFrame:
    """What an incremental export holds: rows without a time or with a later one."""
    return df if last_export is None else df.where(F.col("updated_at").isNull() | (F.col("updated_at") > F.lit(last_export).cast("timestamp")))


def without_deleted(remote: DataFrame, tombstones: DataFrame, key: str = "project_id") -> DataFrame:
    return remote.join(tombstones.select(key), key, "left_anti")


def new_files(listing: DataFrame, own_device: str, last_import: str) -> DataFrame:
    """Files of other devices since the last import; files of an unknown device always count as another's."""
    other = (F.col("device_id") != own_device) | (F.col("device_id") == "dev_unknown")
    return listing.where(other & (F.col("created_at") > F.lit(last_import).cast("timestamp")))
