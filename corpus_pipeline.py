"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Every stage takes null and
empty texts, repeated rows, empty tables and further columns, whatever their
names: an operator sees them under names that none of its own columns has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, line_dedup, minhash, packing, quality_rules
from tessella.llm.common import cut, discard, read


OWN = ("doc_id", "text", "n_chars")


def hidden(docs: DataFrame) -> DataFrame:
    """docs with every column that is not one of documents' own under a name that no operator adds."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in OWN else f"__column_{i}") for i, c in enumerate(docs.columns)))


def shown(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names again."""
    return result.select(*(F.col(f"`{c}`" if c in OWN else f"__column_{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go."""
    trusted = quality_rules.trusted_labels(read(spark, sf_dir, "labels"))
    return shown(quality_rules.quality_rules(hidden(docs), trusted).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them the documents of which nothing is left."""
    clean = line_dedup.dedup_lines(hidden(docs), min_words=1).where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return shown(clean, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id; of repeated rows, one.

    Documents are told apart by a 64-bit hash of id and text, so different texts
    under one id are each judged by themselves. Of rows with equal id and text
    that differ in other columns, the one with the least values stays.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    marked = docs.withColumn("__key", key)
    found = cut(minhash.near_duplicates(marked.select("__key", "text"), doc_id="__key").select(F.col("doc_id").alias("__key"), "component_id"), "near_copies")
    rows = marked.select("__key", "doc_id").groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    rows = cut(found.distinct().join(rows, "__key"), "near_rows")
    # Ids that are null come last; a group has a row for each different text or id.
    stays = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__key"))["__key"].alias("stays"), F.count(F.lit(1)).alias("members")).where("members > 1")
    gone = rows.join(stays, "component_id").where("__key <> stays").select("__key", F.lit(True).alias("gone"), F.lit(False).alias("repeated"))
    fate = gone.unionByName(rows.where("copies > 1").select("__key", F.lit(False).alias("gone"), F.lit(True).alias("repeated")))
    fate = cut(fate.groupBy("__key").agg(F.max("gone").alias("gone"), F.max("repeated").alias("repeated")), "fate")
    discard(found, rows)
    once = marked.join(fate.select("__key"), "__key", "left_anti").select(docs.columns)
    several = marked.join(fate.where("repeated and not gone").select("__key"), "__key", "left_semi")
    least = several.groupBy("__key").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("least"))
    return once.unionByName(least.select(*(F.col("least").getField(c).alias(c) for c in docs.columns)))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return shown(decontam.decontaminate(hidden(docs), read(spark, sf_dir, "benchmark")).where("n_hit = 0"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its place in a sequence."""
    return packing.best_fit_pack(docs.select("doc_id", "text"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("minhash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("best-fit packing", pack)]

#: The likelihood ratio, SimHash and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage_{name.replace(' ', '_')}")
    return docs
