"""Streams in update mode over several batches, with replays and late rows."""

import datetime as dt

from filelake.sources.files import shared_path
from filelake.streaming import streams


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def drain(spark, source, schema, make, upserts, out):
    """Run over what is there, a file per batch, in the order in which the files were written."""
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.outputMode("update").foreachBatch(upserts.write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()


def test_latest_open_over_batches(spark):
    source, out, schema = shared_path(spark), shared_path(spark), "user_id long, generation long, ts timestamp"
    batches = [[(1, 1, at(1)), (2, 2, at(1, 5))], [(1, 3, at(2)), (3, 4, at(2))], [(2, 5, at(20))], [(3, 6, at(3)), (1, 7, at(20, 1))], [(2, 8, at(19))]]
    make = lambda s: streams.latest_open(s, "2 days")
    upserts = streams.Upserts(spark, out, ["user_id", "day"], make(spark.createDataFrame([], schema)).schema)
    for rows in batches:
        put(spark, source, rows, schema)
        drain(spark, source, schema, make, upserts, out)
    got = lambda: {r.user_id: (r.generation, r.ts) for r in streams.newest(upserts.read()).collect()}
    # (3, 6) came when its day was long over; (2, 8) is late, but its day is still open
    want = {1: (7, at(20, 1)), 2: (8, at(19)), 3: (4, at(2))}
    assert got() == want
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()]
    assert max(sizes) <= 2  # a batch writes what it changed
    first = spark.read.parquet(f"{out}/batch=0")
    upserts.write(spark.createDataFrame(first.collect(), first.schema), 0)  # the same batch again
    assert got() == want
    upserts.compact(2)
    upserts.compact(2)
    folders = {r.batch for r in spark.read.parquet(out).select("batch").distinct().collect()}
    assert got() == want and not folders & {0, 1}


def test_progress_over_batches(spark):
    rows = [(f, 10, 100 if f else 0) for f in range(3) for _ in range(7)]
    frame = spark.createDataFrame(rows, "file_id long, bytes long, total long").repartition(5)
    got = streams.run_once(frame, streams.scan_progress, ["file_id"], files_per_batch=1)
    assert sorted(map(tuple, got.collect())) == [(0, 70, 0, 7000), (1, 70, 100, 70), (2, 70, 100, 70)]
