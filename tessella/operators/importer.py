"""Recognising, reading and checking imported documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First bytes in hex, extensions and MIME types of the formats.
MAGIC = (("25504446", "pdf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("424D", "image"), ("504B0304", "zip"))
EXTENSIONS = {"oxs": "oxs", "xml": "oxs", "json": "json", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "webp": "image", "zip": "zip"}
MIMES = {"application/pdf": "pdf", "application/json": "json", "text/xml": "oxs", "application/xml": "oxs", "image/png": "image", "image/jpeg": "image", "image/gif": "image", "image/webp": "image", "image/bmp": "image"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def sniff(files: DataFrame) -> DataFrame:
    """name, head (the first bytes), mime: the format by bytes, then by the head's text, then by name, then by type."""
    start = F.hex("head")
    # RIFF, four bytes of length, WEBP.
    riff = F.when(start.startswith("52494646") & (F.substr(start, F.lit(17), F.lit(8)) == "57454250"), "image")
    by_bytes = F.coalesce(*(F.when(start.startswith(prefix), kind) for prefix, kind in MAGIC), riff)
    text = F.ltrim(F.decode(F.expr("try_validate_utf8(cast(substring(head, 1, 256) as string))").cast("binary"), "UTF-8"))
    by_text = F.when(text.startswith("<?xml") | F.lower(text).rlike(r"^<(chart|oxs|pattern)\b"), "oxs").when(text.startswith("{") | text.startswith("["), "json")
    magic = F.coalesce(by_bytes, by_text)
    ext = _lookup(F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)), EXTENSIONS)
    mime = _lookup(F.lower("mime"), MIMES)
    confidence = F.when(magic.isNotNull(), F.when(ext == magic, 1.0).otherwise(0.9)).when(ext.isNotNull(), 0.7).when(mime.isNotNull(), 0.6).otherwise(0.0)
    return files.select("name", F.coalesce(magic, ext, mime, F.lit("unknown")).alias("format"), confidence.alias("confidence"))


def best_strategy(scores: DataFrame) -> DataFrame:
    """Of each file's strategies with a score, the highest, the first registered of equal ones."""
    return scores.where("score > 0").groupBy("file").agg(F.max_by("strategy", F.struct("score", -F.col("ord"))).alias("strategy"), F.max("score").alias("score"))


def bulk_codes(texts: DataFrame) -> DataFrame:
    """id and code for every code in a free list: parts between delimiters, without brand words and hashes."""
    parts = F.split("text", r"[,;\s]+")
    bare = F.transform(parts, lambda p: F.upper(F.regexp_replace(p, r"(?i)^(anchor|anch\.|dmc\.?|#)+", "")))
    return texts.select("id", F.posexplode(F.filter(bare, lambda p: p != "")).alias("position", "code"))


def resolved_codes(codes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Codes joined to the catalogue's ids; unknown ones stay with no thread."""
    known = catalogue.groupBy(F.upper(F.col("id").cast("string")).alias("code")).agg(F.min("id").alias("thread_id"))
    return codes.join(known, "code", "left").select("id", "position", "code", "thread_id")


def hex_channels(text: Column) -> Column:
    """r, g, b of #rgb or #rrggbb; null for anything else."""
    bare = F.lower(F.regexp_replace(text, "^#", ""))
    full = F.when(bare.rlike("^[0-9a-f]{6}$"), bare).when(bare.rlike("^[0-9a-f]{3}$"), F.regexp_replace(bare, "(.)", "$1$1"))
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.when(full.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def name_hash(name: Column) -> Column:
    """h = h * 31 + code over the characters, kept in 32 bits with a sign."""
    wrap = lambda h: F.pmod(h + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))


#: Words of legends, materials and instructions, and codes of threads.
LEGEND_WORDS = r"(?i)(color\s*key|colour\s*key|colour\s*chart|symbol(e)?|l(é|e)gende|leyenda|nuancier|d['ʼ]?(é|e)chevettes?)"
MATERIAL_WORDS = r"(?i)\btool\s*kit\b|\bfournitures\b|\bpearl\s*cotton\b|\bmoulin(é|e)\b|\bembroidery\s*thread\b|\b1[1-9]\s*ct\b|\baida\b|\bevenweave\b|\blinen\b|\b(é|e)tamine\b"
INSTRUCTION_WORDS = r"(?i)\bwash\b|\bstart(ing)?\b|\bframe\b|\bbackstitch\b|\binstruction"
CODES = r"\b(B5200|D\d{3}|E\d{3,4}|\d{2,5})\b"


def page_roles(pages: DataFrame) -> DataFrame:
    """What a page is, and how sure that is: page_id, page, text, total (operators), colours, fills, large_image."""
    text = F.lower(F.coalesce("text", F.lit("")))
    legend = text.rlike(LEGEND_WORDS)
    # Codes are counted in the lower-cased text, in which those with letters do not match.
    codes = F.regexp_count(text, F.lit(CODES))
    fills, total = F.col("fills"), F.col("total")
    rules = (
        (total < 50, "blank", 1.0),
        ((F.col("colours") >= 50) & (fills >= 1000), "chart-vector-colour", 0.9),
        ((F.col("colours") >= 5) & (fills >= 1000), "chart-vector-bs", 0.9),
        ((fills >= 500) & legend, "chart-combined", 0.8),
        (legend & (codes >= 5), "legend", 0.85),
        (text.rlike(MATERIAL_WORDS), "materials", 0.75),
        (F.col("large_image") & (fills < 100), "cover", 0.9),
        ((F.col("page") == 1) & (total < 200) & (text != ""), "cover", 0.6),
        (text.rlike(INSTRUCTION_WORDS), "instructions", 0.7),
    )
    role, sure = F.lit("instructions"), F.lit(0.4)
    for when, name, confidence in reversed(rules):
        role, sure = F.when(when, name).otherwise(role), F.when(when, confidence).otherwise(sure)
    return pages.select("page_id", role.alias("role"), sure.alias("confidence"))


def pitch(rects: DataFrame, least: float = 0.5) -> DataFrame:
    """page_id and pitch of a chart along one axis: the commonest step over least between its distinct coordinates, the first along the axis of equal ones.

    rects: page_id, v (a coordinate), size (the rectangle's extent). Coordinates
    count to the hundredth, steps to the tenth. With fewer than three coordinates
    or no such step it is the upper median of the sizes above 0, and 0 without any.
    """
    distinct = rects.select("page_id", (F.floor(F.col("v") * 100 + 0.5) / 100).alias("v")).distinct()
    along = Window.partitionBy("page_id").orderBy("v")
    gaps = distinct.withColumns({"gap": F.col("v") - F.lag("v").over(along), "n": F.count(F.lit(1)).over(Window.partitionBy("page_id"))}).where((F.col("gap") > least) & (F.col("n") >= 3))
    steps = gaps.groupBy("page_id", (F.floor(F.col("gap") * 10 + 0.5) / 10).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"))
    commonest = steps.groupBy("page_id").agg(F.max_by("step", F.struct("n", -F.col("first"))).alias("step"))
    by_size = Window.partitionBy("page_id").orderBy("size")
    placed = rects.where("size > 0").withColumns({"i": F.row_number().over(by_size), "n": F.count(F.lit(1)).over(Window.partitionBy("page_id"))})
    middle = placed.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("page_id", F.col("size").cast("double").alias("middle"))
    out = rects.select("page_id").distinct().join(commonest, "page_id", "left").join(middle, "page_id", "left")
    return out.select("page_id", F.coalesce("step", "middle", F.lit(0.0)).alias("pitch"))


def validate(cells: DataFrame, legend: DataFrame, documents: DataFrame) -> DataFrame:
    """Findings on extractions and their severity: cells have doc, code, confidence; legend has doc, code, expected; documents has doc, width, height."""
    counts = cells.where("code is not null").groupBy("doc", "code").agg(F.count(F.lit(1)).alias("actual"))
    listed = legend.where("code is not null").withColumn("listed", F.lit(True))
    j = counts.join(listed, ["doc", "code"], "full_outer")
    finding = lambda df, name, severity, code=None: df.select("doc", code or F.lit(None).cast("string").alias("code"), F.lit(name).alias("finding"), F.lit(severity).alias("severity"))
    with_legend = listed.select("doc").distinct()
    cover = documents.join(cells.groupBy("doc").agg((F.count_if(F.col("confidence") > 0) / F.count(F.lit(1))).alias("c")), "doc", "left")
    share = F.coalesce("c", F.lit(0.0))
    sized = documents.where("width > 0 and height > 0")
    found = (
        finding(j.where("expected > 0 and abs(coalesce(actual, 0) - expected) > greatest(5.0d, expected * 0.1d)"), "COUNT_MISMATCH", "medium", "code"),
        finding(j.where("listed is null").join(with_legend, "doc", "left_semi"), "LEGEND_MISSING_CODE", "medium", "code"),
        finding(j.where("actual is null"), "LEGEND_UNUSED", "low", "code"),
        finding(cover.where(F.col("c").isNull()), "EMPTY_GRID", "error"),
        finding(cover.where(share < 0.5), "LOW_PALETTE_COVERAGE", "high"),
        finding(cover.where((share >= 0.5) & (share < 0.85)), "PALETTE_COVERAGE", "medium"),
        finding(sized.where("width > 1000 or height > 1000"), "GRID_TOO_LARGE", "medium"),
        finding(sized.where("width < 5 or height < 5"), "GRID_TOO_SMALL", "medium"),
    )
    return reduce(DataFrame.unionByName, found)


def materialised(cells: DataFrame) -> DataFrame:
    """A dense grid from sparse cells: every place of the bounding box, skipped where no cell is."""
    box = cells.groupBy("doc").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    rows = box.select("doc", "w", F.explode(F.sequence(F.lit(0).cast("long"), "h")).alias("y"))
    spine = rows.select("doc", "y", F.explode(F.sequence(F.lit(0).cast("long"), "w")).alias("x"))
    return spine.join(cells.select("doc", "x", "y", "code"), ["doc", "x", "y"], "left").select("doc", "x", "y", F.coalesce("code", F.lit("__skip__")).alias("code"))


def overall_confidence(grid: Column, palette: Column, meta: Column) -> Column:
    return 0.5 * grid + 0.3 * palette + 0.2 * meta


def review_mode(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "accept").when(confidence >= 0.8, "review").otherwise("guided")
