"""Running values along a long order, in two levels: blocks of the order, and what each block hands to the next.

A window over a file's rows is one task however long the file is. Here the order is cut into blocks; each block is
summed up, the few sums run through the file, and every block then goes on from its own carry. The carry is a row at the
head of its block, so records are shuffled once, by file and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block along the order.
BLOCK = 1 << 20


def block_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def last_before(rows: DataFrame, keys: list[str], order: str, value: Column, width: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``last``, the latest ``value`` up to and with each row that is not null, along ``order`` and then ``ties``.

    ``order`` is a number that is not null; it is cut into blocks of ``width``.
    """
    rows = rows.withColumns({"__block": block_of(order, width), "__value": value, "__head": F.lit(False)})
    place = F.struct(order, *ties)
    sums = rows.groupBy(*keys, "__block").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), place)).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*keys, "__block", F.last("__sum", ignorenulls=True).over(before).alias("__value"), F.lit(True).alias("__head")).where("__value is not null")
    within = Window.partitionBy(*keys, "__block").orderBy(F.col("__head").desc(), order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.withColumn("last", F.last("__value", ignorenulls=True).over(within)).where("not __head").drop("__block", "__value", "__head")


def numbered(rows: DataFrame, keys: list[str], order: str, width: int = BLOCK) -> DataFrame:
    """Rows with ``n``, their number from 1 along ``order``."""
    rows = rows.withColumns({"__block": block_of(order, width), "__ahead": F.lit(None).cast("long")})
    sums = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy(*keys, "__block").orderBy(F.col("__ahead").isNull(), order)
    both = rows.unionByName(heads, allowMissingColumns=True)
    number = F.row_number().over(within) - 1 + F.max("__ahead").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("n", number).where("__ahead is null").drop("__block", "__ahead")
