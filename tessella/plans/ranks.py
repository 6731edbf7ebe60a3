"""Row numbers within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.plans.rounds import settled


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their number, from 1, in their group by order, which must tell the rows of a group apart.

    Ranges of groups and order are numbered each by itself, and the counts of the
    same group in the ranges before are added, so a group that holds most of the
    table is spread over as many tasks as it has ranges.
    """
    by = [F.col(g) for g in group]
    dealt = rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    dealt = settled(dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order))), "ranges")
    sizes = dealt.groupBy("__range", *group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__range").alias("__r"), *(F.col(g).alias(f"__{g}") for g in group), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group), F.col("__range") == F.col("__r"))
    return dealt.join(offsets, same).select(*rows.columns, (F.col("__at") + F.col("__before")).cast("int").alias(name))
