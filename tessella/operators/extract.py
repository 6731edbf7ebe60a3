"""From drawing operators and texts of pages to a chart: cells, legends, bands of text, tiles.

rects: page_id, x, y, w, h, r, g, b; grids: page_id, pitch_x, pitch_y, origin_x,
origin_y; texts: page_id, item, x, y, text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import js_round
from tessella.operators import nearby
from tessella.plans.rounds import settled

#: Words of stitch types in three languages, in the order in which they are tried, codes and strands of a legend row.
TYPES = (
    ("bs", r"(?i)(back\s*stitch|backstitch|point\s*arri[èe]re|punto\s*atr[áa]s)"),
    ("threequarter", r"(?i)(three[\s-]?quarter|3\s*/\s*4|trois?\s*quarts?\s*de\s*point)"),
    ("quarter", r"(?i)(quarter\s*stitch|quart\s*de\s*point|cuarto\s*de\s*punto|1\s*/\s*4)"),
    ("half", r"(?i)(half\s*stitch|demi[\s-]?point|medio\s*punto|1\s*/\s*2)"),
    ("petite", r"(?i)(petite|petit\s*point)"),
    ("french-knot", r"(?i)(french\s*knot|nœud\s*de\s*broderie|nudo\s*franc[ée]s)"),
    ("full", r"(?i)(cross\s*stitch|point\s*de\s*croix|punto\s*de\s*cruz)"),
)
CODE = r"\b(B5200|D\d{3}|E\d{3,4}|\d{2,5})\b"
STRANDS = r"(?i)(\d+)\s*(?:strands?|brins?|hebras?|hilos?)"
PAGE = r"(?i)(?:page\s*)?(\d+)\s*(?:/|of|sur|de|von|aus)\s*(\d+)"
#: The threads of so many colours are broadcast; of more, they meet cells in a shuffle.
BROADCAST_COLOURS = 250_000
#: Publishers by strings in a file's data, most certain first.
PUBLISHERS = (("dmc", ("dmc creative", "dmc studio", "dmc ", "dmc, inc"), 0.95), ("flosscross", ("flosscross",), 0.9), ("patternkeeper", ("patternkeeper", "pattern keeper"), 0.9), ("kgchart", ("kg-chart", "kgchart"), 0.85))


def older_page_classes(pages: DataFrame) -> DataFrame:
    """Class by what lies on a page: page_id, page, n_lines, n_texts, n_single, mentions."""
    chart = (F.col("n_lines") > 50) & ((F.col("n_single") > 50) | (F.col("n_texts") > 1000) | (F.col("n_lines") > 2000))
    kind = F.when(chart, "chart").when(F.col("mentions"), "legend").when(F.col("page") == 1, "cover").otherwise("info")
    return pages.select("page_id", kind.alias("class"))


def cell_type(w: Column, h: Column) -> Column:
    """full, half or quarter by the shares of the pitch that a rectangle takes."""
    middle = lambda x: (x > 0.4) & (x < 0.65)
    return F.when((w > 0.9) & (h > 0.9), "full").when(middle(w) & (h > 0.9) | (w > 0.9) & middle(h), "half").when((w < 0.65) & (h < 0.65), "quarter").otherwise("full")


def snapped(rects: DataFrame, grids: DataFrame) -> DataFrame:
    """The cell of every rectangle by its middle, and its type; those before the first row or column go."""
    j = rects.join(grids.where("pitch_x <> 0 and pitch_y <> 0"), "page_id")
    at = lambda v, size, axis: js_round((F.col(v) + F.col(size) / 2 - F.col(f"origin_{axis}") - F.col(f"pitch_{axis}") / 2) / F.col(f"pitch_{axis}")).cast("long")
    out = j.select("page_id", at("x", "w", "x").alias("col"), at("y", "h", "y").alias("row"), "r", "g", "b", cell_type(F.col("w") / F.col("pitch_x"), F.col("h") / F.col("pitch_y")).alias("type"))
    return out.where("col >= 0 and row >= 0")


def matched(cells: DataFrame, legend: DataFrame, catalogue: DataFrame, reach: float = 25.0) -> DataFrame:
    """Code of every cell: the legend row of its very colour, else the nearest one in reach, else the nearest thread of the catalogue.

    legend: page_id, code, r, g, b, ord; catalogue: id, r, g, b, ord. Distances are taken once for each distinct colour of a page.
    """
    rgb = ["r", "g", "b"]
    d2 = sum(((F.col(c) - F.col(f"l_{c}")) * (F.col(c) - F.col(f"l_{c}")) for c in rgb), F.lit(0)).cast("long")
    distinct = cells.select("page_id", *rgb).distinct()
    # Legend rows are numbered in their order, so that one number has the squared distance and who is first of equal ones: pairs add up without a sort, and only those in reach count.
    listed = legend.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "code", *rgb))).alias("rows"))
    rows = listed.select("page_id", F.posexplode("rows").alias("pos", "row")).select("page_id", "pos", *(F.col(f"row.{c}").alias(f"l_{c}") for c in rgb))
    # Colours and legends of pages lie in few bytes of a file but not of memory, so none is broadcast for its size in files.
    pairs = distinct.join(rows.hint("merge"), "page_id").withColumn("d2", d2).where(F.sqrt(F.col("d2").cast("double")) < reach)
    least = pairs.groupBy("page_id", *rgb).agg(F.min(F.shiftleft("d2", 32) + F.col("pos")).alias("k"))
    row = F.get("rows", F.col("k").bitwiseAND(0xFFFFFFFF).cast("int"))
    near = least.join(listed.hint("merge"), "page_id").select("page_id", *rgb, row["code"].alias("near_code"), F.shiftright("k", 32).alias("d2"))
    met = settled(cells.select("page_id", "col", "row", *rgb).join(near.hint("merge"), ["page_id", *rgb], "left"), "legend_near")
    # The search goes by places along any three axes; of threads of one colour only the first can be found.
    first = catalogue.dropna(subset=rgb).groupBy(*rgb).agg(F.min_by("id", "ord").alias("thread_id"), F.min("ord").alias("ord"))
    threads = first.select("thread_id", "ord", *(F.col(c).cast("double").alias(f"c_{x}") for c, x in zip(rgb, "lab", strict=True)))
    far = settled(met.where("d2 is null").select(*rgb).distinct(), "far_colours")
    places = far.select(F.struct(*rgb).alias("rgb"), *(F.col(c).cast("double").alias(x) for c, x in zip(rgb, "lab", strict=True)))
    fallback = nearby.nearest_in_lab(places, threads).select("rgb.*", F.col("thread_id").alias("thread"))
    j = met.join(F.broadcast(fallback) if far.count() <= BROADCAST_COLOURS else fallback.hint("merge"), rgb, "left")
    exact, close = F.col("d2") == 0, F.col("d2").isNotNull()
    kind = F.when(exact, "legend-exact").when(close, "legend-nearest").when(F.col("thread").isNotNull(), "catalogue").otherwise("unknown")
    confidence = F.when(exact, 1.0).when(close, 0.95).when(F.col("thread").isNotNull(), 0.5).otherwise(0.0)
    return j.select("page_id", "col", "row", F.when(close, F.col("near_code")).otherwise(F.col("thread").cast("string")).alias("code"), kind.alias("kind"), confidence.alias("confidence"))


def bands(texts: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Lines of text on each page: from the top down, an item within the tolerance of a line's first item belongs to it. page_id, band, y, text.

    Where a line ends depends on where it began, so a page's items are read in
    order by one task, which keeps the line it is in and no page.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, band, first = None, -1, 0.0
        for batch in batches:
            number, firsts = [], []
            for page, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                y = math.nan if y is None else y
                if band < 0 or page != last:
                    last, band, first = page, 0, y
                elif first - y > tolerance:
                    band, first = band + 1, y
                number.append(band)
                firsts.append(None if math.isnan(first) else first)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), pa.array(number, pa.int32()), pa.array(firsts, pa.float64())], names=names)

    schema = "page_id long, item long, x double, text string, band int, first double"
    names = [f.split()[0] for f in schema.split(", ")]
    items = texts.select(F.col("page_id").cast("long").alias("page_id"), F.col("item").cast("long").alias("item"), F.nanvl(F.col("y").cast("double"), F.lit(None)).alias("y"), F.col("x").cast("double").alias("x"), F.col("text").cast("string").alias("text"))
    placed = items.repartition("page_id").sortWithinPartitions("page_id", F.desc_nulls_last("y"), "item").mapInArrow(numbered, schema)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("x", "item", "text"))), lambda t: t["text"])
    text = F.trim(F.regexp_replace(F.array_join(in_order, " "), r"\s+", " "))
    return placed.groupBy("page_id", "band").agg(F.max("first").alias("y"), text.alias("text"))


def stitch_type(text: Column) -> Column:
    out = F.lit("full")
    for name, words in reversed(TYPES):
        out = F.when(text.rlike(words), name).otherwise(out)
    return out


def legend_rows(lines: DataFrame) -> DataFrame:
    """Glyph, code, label, strands, type and confidence of the lines (page_id, band, text) that hold a code; of equal ones of a page the first."""
    code = F.nullif(F.regexp_extract("text", CODE, 1), F.lit(""))
    found = lines.withColumn("code", code).where("code is not null")
    at = F.regexp_instr("text", F.lit(CODE)) - 1
    before = F.trim(F.substr("text", F.lit(1), at))
    after = F.trim(F.substr("text", at + F.length("code") + 1))
    token = F.regexp_extract(before, r"(\S+)$", 1)
    found = found.withColumns({"glyph": F.when(F.length(token) <= 3, token).otherwise(""), "after": after})
    strands = F.nullif(F.regexp_extract("after", STRANDS, 1), F.lit("")).cast("int")
    label = F.trim(_without_first("after", STRANDS))
    for _, words in TYPES:
        label = F.regexp_replace(label, f"^(?s)(.*?){words}", "$1")
    label = F.trim(F.regexp_replace(label, r"[/\-–—|]+$", ""))
    found = found.withColumns({"strands": strands, "label": label, "type": stitch_type(F.col("text"))})
    sure = 0.6 + F.when(F.col("glyph") != "", 0.15).otherwise(0.0) + F.when(F.length("label") >= 2, 0.15).otherwise(0.0) + F.when(F.col("strands").isNotNull(), 0.1).otherwise(0.0)
    first = F.row_number().over(Window.partitionBy("page_id", "glyph", "code", "type").orderBy("band"))
    return found.withColumn("k", first).where("k = 1").select("page_id", "band", "glyph", "code", "label", "strands", "type", F.least(F.lit(1.0), sure).alias("confidence"))


def _without_first(column: str, pattern: str) -> Column:
    return F.regexp_replace(column, f"^(?s)(.*?){pattern}", "$1")


def page_markers(texts: DataFrame) -> DataFrame:
    """Number and count of "2 of 4" and its like in other languages: id, text; null where the count is less than the number."""
    number, total = (F.nullif(F.regexp_extract("text", PAGE, i), F.lit("")).cast("long") for i in (1, 2))
    good = total >= number
    return texts.select("id", F.when(good, number).alias("number"), F.when(good, total).alias("total"))


def tile_layout(total: Column, wide: Column) -> Column:
    """Rows and columns of so many tiles: the divisors nearest to the root; two lie side by side if the first is wide."""
    root = F.sqrt(total)
    pairs = F.transform(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), total)), lambda r: total % r == 0), lambda r: F.struct((F.abs(r - root) + F.abs(F.floor(total / r) - root)).alias("d"), r.alias("rows"), F.floor(total / r).cast("long").alias("cols")))
    best = F.array_min(pairs)
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    return F.when(total <= 1, F.struct(one.alias("rows"), one.alias("cols"))).when((total == 2) & wide, F.struct(one.alias("rows"), two.alias("cols"))).when(total == 2, F.struct(two.alias("rows"), one.alias("cols"))).otherwise(F.struct(best["rows"].alias("rows"), best["cols"].alias("cols")))


def assembled(tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of all tiles of a document on one grid: doc, col, row, code; where tiles overlap, the surer cell, then the earlier tile's.

    tiles: doc, tile (order on the pages), number (of the marker, or null), total (or null), cols, rows; cells: doc, tile, col, row, code, confidence.
    """
    w = Window.partitionBy("doc")
    marked = tiles.withColumns({"n": F.count(F.lit(1)).over(w), "n_marked": F.count("number").over(w), "said": F.first("total", ignorenulls=True).over(w.orderBy("tile").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "first": F.min(F.struct("tile", "cols", "rows")).over(w)})
    marked = marked.withColumn("total", F.coalesce("said", F.col("n")))
    by_marker = F.col("n_marked") == F.col("total")
    # With all markers only marked tiles count, in their order; else all tiles as they come.
    used = marked.where(~by_marker | F.col("number").isNotNull())
    order = w.orderBy(F.when(by_marker, F.col("number")), "tile")
    layout = tile_layout(F.col("total"), F.col("first.cols") > F.greatest(F.lit(1).cast("long"), F.col("first.rows")))
    placed = used.withColumns({"i": F.row_number().over(order) - 1, "layout": layout})
    head = F.first(F.struct("cols", "rows")).over(order)
    placed = placed.withColumn("head", head)
    placed = placed.select("doc", "tile", "i", ((F.col("i") % F.col("layout.cols")) * F.col("head.cols")).alias("dx"), (F.floor(F.col("i") / F.col("layout.cols")) * F.col("head.rows")).alias("dy"))
    j = cells.join(placed, ["doc", "tile"])
    at = j.groupBy("doc", (F.col("col") + F.col("dx")).alias("col"), (F.col("row") + F.col("dy")).alias("row"))
    return at.agg(F.max_by("code", F.struct("confidence", -F.col("i"))).alias("code"))


def publisher(files: DataFrame) -> DataFrame:
    """The publisher that a file's data (meta) names, or its text for one of them: id, meta, sample."""
    meta, body = F.lower(F.coalesce("meta", F.lit(""))), F.lower(F.coalesce("sample", F.lit("")))
    name, sure = F.lit("unknown"), F.lit(0.0)
    for who, words, confidence in reversed(PUBLISHERS):
        hit = F.lit(False)
        for word in words:
            hit = hit | meta.contains(word)
        if who == "dmc":
            hit = hit | body.contains("dmc") & body.contains("color key")
        name, sure = F.when(hit, who).otherwise(name), F.when(hit, confidence).otherwise(sure)
    return files.select("id", name.alias("publisher"), sure.alias("confidence"))
