"""Charts written as XML, one file for each, streamed line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.adapters import EMPTY, SKIP

#: Lines in front of and behind a chart's own ones, by section.
HEADER, PALETTE, ENTRY, STITCHES, STITCH, END = range(6)


def escaped(text: Column) -> Column:
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(reference))
    return text


def used_threads(cells: DataFrame) -> DataFrame:
    """chart, idx, x, y, id of the stitched cells; a blend counts as its first thread."""
    return cells.where(~F.col("thread_id").isin(SKIP, EMPTY)).select("chart", "idx", "x", "y", F.substring_index("thread_id", "+", 1).alias("id")).where("id <> ''")


def numbered_palette(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """chart, id, r, g, b, number: colours from 1, first those of the chart's palette with a place, in its order, then by first appearance.

    palette has chart, id, place (null: where it first appears) and r, g, b; of
    rows with one id the one with the least place counts. A colour without a row
    is black. Windows hold the different colours of one chart.
    """
    seen = used_threads(cells).groupBy("chart", "id").agg(F.min("idx").alias("first"))
    own = palette.groupBy("chart", "id").agg(F.min("place").alias("place"), F.min_by(F.struct("r", "g", "b"), F.struct(F.col("place").isNull(), "place", "r", "g", "b")).alias("rgb"))
    both = seen.join(own, ["chart", "id"], "full").where("place is not null or first is not null")
    order = Window.partitionBy("chart").orderBy(F.col("place").asc_nulls_last(), F.col("first").asc_nulls_last(), "id")
    rgb = [F.coalesce(F.col(f"rgb.{c}"), F.lit(0)).cast("int").alias(c) for c in "rgb"]
    return both.select("chart", "id", *rgb, F.row_number().over(order).alias("number"))


def chart_lines(cells: DataFrame, palette: DataFrame, sizes: DataFrame) -> DataFrame:
    """chart, section, place, line: the XML of all charts; in the order of section and place they are its files.

    cells: chart, idx, x, y, thread_id; sizes: chart, w, h, where charts without
    cells have a row as well; charts without a positive size are left out.
    """
    sizes = sizes.where("w > 0 and h > 0").select("chart", "w", "h")
    numbers = numbered_palette(cells, palette)
    fixed = (
        (HEADER, F.lit('<?xml version="1.0" encoding="UTF-8"?>')),
        (HEADER, F.format_string('<chart width="%d" height="%d">', "w", "h")),
        (HEADER, F.format_string("  <format><chartwidth>%d</chartwidth><chartheight>%d</chartheight></format>", "w", "h")),
        (PALETTE, F.lit("  <palette>")),
        (STITCHES, F.lit("  </palette>")),
        (STITCHES, F.lit("  <fullstitches>")),
        (END, F.lit("  </fullstitches>")),
        (END, F.lit("</chart>")),
    )
    fixed = F.array(*(F.struct(F.lit(section).alias("section"), line.alias("line")) for section, line in fixed))
    frame = sizes.select("chart", F.posexplode(fixed).alias("place", "c")).select("chart", "c.section", F.col("place").cast("long").alias("place"), "c.line")
    name = escaped(F.col("id"))
    entries = numbers.join(sizes, "chart", "left_semi").select("chart", F.lit(ENTRY).alias("section"), F.col("number").cast("long").alias("place"), F.format_string('    <color index="%d" number="%s" name="%s" red="%d" green="%d" blue="%d"/>', "number", name, name, "r", "g", "b").alias("line"))
    stitches = used_threads(cells).join(sizes, "chart").where("x between 0 and w - 1 and y between 0 and h - 1").join(numbers.select("chart", "id", "number"), ["chart", "id"])
    rows = stitches.select("chart", F.lit(STITCH).alias("section"), F.col("idx").cast("long").alias("place"), F.format_string('    <stitch x="%d" y="%d" palindex="%d"/>', F.col("x").cast("long"), F.col("y").cast("long"), "number").alias("line"))
    return frame.unionByName(entries).unionByName(rows)


def write_charts(lines: DataFrame, path: str) -> None:
    """One file for each chart, in a folder of its name.

    A task sorts lines, which spills, and streams them into the file; it never
    holds a chart as one value. The largest chart sets how long the longest task takes.
    """
    lines.repartition("chart").sortWithinPartitions("chart", "section", "place").select("chart", "line").write.mode("overwrite").partitionBy("chart").text(path)
