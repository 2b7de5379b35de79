"""Running values in blocks equal those of one window, whatever the width of a block."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from filelake.operators import records as R
from filelake.operators.scans import last_before, numbered


@pytest.mark.parametrize("width", [1, 7, 100, 1 << 20])
def test_blocks_equal_one_window(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.randrange(3), x, rnd.randrange(9) if rnd.random() < 0.1 else None) for x in rnd.sample(range(-500, 3000), 900)]
    df = spark.createDataFrame(rows, "k int, x long, v int")
    w = Window.partitionBy("k").orderBy("x")
    want = df.withColumns({"n": F.row_number().over(w), "last": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    got = numbered(last_before(df, ["k"], "x", F.col("v"), width), ["k"], "x", width)
    pick = lambda d: sorted(map(tuple, d.select("k", "x", "v", "last", "n").collect()), key=str)
    assert pick(got) == pick(want)


@pytest.mark.parametrize("width", [3, 1 << 20])
def test_log_operators_by_blocks(spark, width):
    records = spark.createDataFrame([(1, 0, 60, "A0"), (1, 2, 6, "A1"), (1, 5, 60, "A2"), (1, 9, 60, "A3"), (1, 10, 7, "A4"), (2, 4, None, "A5"), (2, 30, 60, "A6")], "file_id long, offset long, rec_id int, h string")
    merged = sorted((r.file_id, r.offset, r.rec_id, r.h) for r in R.merge_continued(records, width=width).collect())
    assert merged == [(1, 0, None, "A0"), (1, 2, 6, "A1A2A3"), (1, 10, 7, "A4"), (2, 4, None, "A5A6")]
    sections = spark.createDataFrame([(1, 2, "a"), (1, 9, "b"), (2, 31, "c")], "file_id long, start long, name string")
    placed = sorted((r.file_id, r.offset, r.section) for r in R.assign_sections(records, sections, width).collect())
    assert placed == [(1, 2, "a"), (1, 5, "a"), (1, 9, "b"), (1, 10, "b")]


def test_one_long_file_spreads_over_tasks(spark):
    records = spark.range(200_000).select(F.lit(1).cast("long").alias("file_id"), (F.col("id") * 10).alias("offset"))
    sections = spark.range(20).select(F.lit(1).cast("long").alias("file_id"), (F.col("id") * 100_000).alias("start"), F.col("id").cast("string").alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = R.assign_sections(records, sections, 10_000)
        most = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 100_000 and placed.where("section <> cast(offset div 100000 as string)").count() == 0 and placed.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
