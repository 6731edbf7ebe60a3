"""Compressed documents of devices: coding, folders of files, and restoring from a backup."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


@F.pandas_udf(BinaryType())
def deflated(text: pd.Series) -> pd.Series:
    """A text's UTF-8 bytes as a zlib stream; null stays null."""
    return text.map(lambda t: zlib.compress(t.encode("utf-8", "surrogatepass")), na_action="ignore")


def _inflate(data: bytes) -> str | None:
    try:
        return zlib.decompress(data).decode("utf-8")
    except (zlib.error, UnicodeDecodeError):
        return None


@F.pandas_udf(StringType())
def inflated(data: pd.Series) -> pd.Series:
    """The text of a zlib stream; null where it is cut off, damaged or no UTF-8."""
    return data.map(_inflate, na_action="ignore")


def tagged(text: Column, tag: str) -> Column:
    """The tag, then the compressed text in Base64."""
    return F.concat(F.lit(tag), F.base64(deflated(text)))


def untagged(text: Column, tag: str) -> Column:
    """What tagged() was given; a text without the tag is taken for one that was never compressed."""
    rest = F.substring(text, len(tag) + 1, 2**31 - 1)
    return F.when(~text.startswith(tag), text).otherwise(inflated(F.try_to_binary(rest, F.lit("base64"))))


def device_documents(rows: DataFrame, device: str, *columns: str) -> DataFrame:
    """device, document: the rows of each device as a JSON array, in the order of the columns.

    A document is one file that a device reads whole, so it holds the rows of one
    device or project only.
    """
    return rows.groupBy(device).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("document"))


def write_documents(documents: DataFrame, device: str, path: str) -> None:
    """One zlib file for each device, in a folder of its name."""
    documents.select(device, "document").repartition(device).write.mode("overwrite").partitionBy(device).option("compression", "deflate").text(path)


def scan_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, modified, length, document, format, version, device_id, created_at: all files below a folder whose names fit the pattern.

    Files that are no zlib stream of a JSON text have a null document; a file
    that names no device is of dev_unknown.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    read = files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length", inflated("content").alias("text"))
    read = read.withColumn("document", F.when(F.try_parse_json("text").isNotNull(), F.col("text"))).drop("text")
    part = lambda name: F.get_json_object("document", f"$.{name}")
    return read.withColumns({"format": part("_format"), "version": part("_version").try_cast("int"), "device_id": F.coalesce(part("_deviceId"), F.lit("dev_unknown")), "created_at": part("_createdAt").try_cast("timestamp")})


def restore_backup(spark: SparkSession, path: str, target: str, schemas: dict[str, str]) -> dict[str, int]:
    """Puts every table of a backup in the place of the target's; rows by table.

    All tables are read through first, so a backup that lacks a table or holds a
    line that does not fit its schema raises an error before anything is replaced.
    """
    tables = {}
    counts = {}
    for name, schema in schemas.items():
        lines = spark.read.text(f"{path}/{name}").where("trim(value) <> ''")
        tables[name] = lines.select(F.from_json("value", f"{schema}, __damaged string", {"columnNameOfCorruptRecord": "__damaged"}).alias("row")).select("row.*")
        found = tables[name].agg(F.count(F.lit(1)).alias("n"), F.count("__damaged").alias("damaged")).first()
        if found.damaged:
            raise ValueError(f"{found.damaged} rows of {name} cannot be read")
        counts[name] = found.n
    for name, df in tables.items():
        df.drop("__damaged").write.mode("overwrite").parquet(f"{target}/{name}")
    return counts
