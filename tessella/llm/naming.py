"""Dense numbers for the rows of a table, and joins on keys of which some are very common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_view, cut

_ROW_BITS = 33
#: A key that more than one in so many rows has is joined by broadcast, so at most so many keys are.
COMMON_KEYS = 1000


def numbered(df: DataFrame, number: str, name: str = "numbered") -> DataFrame:
    """df, written, with consecutive numbers from 0 in the order of its partitions and of the rows in them.

    A row's number is its place in its partition and the rows of the partitions
    before; only the counts, one for each partition, come together in one task.
    """
    at = cut(df.withColumn("__at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("__at", _ROW_BITS), F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = at.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return as_view(at, at.join(F.broadcast(offsets), part == F.col("__part")).select(*df.columns, (F.col("__before") + place).alias(number)))


def join_common(rows: DataFrame, table: DataFrame, keys: list[str], count: str | Column, of: int) -> DataFrame:
    """rows joined with table, in which keys are unique and count says how many rows have them; of: all rows.

    Keys of more than one in COMMON_KEYS rows are so few that they are broadcast;
    all others join by a shuffle in which no key is common. Keys must not be null.
    """
    count = F.col(count) if isinstance(count, str) else count
    limit = of // COMMON_KEYS + 1
    common, rest = table.where(count > limit), table.where(count <= limit)
    spread = rows.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(common), keys).unionByName(spread)
