"""Files in and out: whole files as rows, as they land, and triage results by viewer."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triage import route_files
from .access import located

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _named(raw: DataFrame, more: list[str] | None = None) -> DataFrame:
    return raw.select(
        *(more or []),
        F.xxhash64("path").alias("file_id"), F.substring_index("path", "/", -1).alias("name"), F.lit("").alias("mime"), F.col("length").alias("size"), "content"
    )


def shared_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Without that setting a session on one machine gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="filelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/filelake-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Within it, what a query has shuffled is dropped as soon as the query ends; for steps that are each written and read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, or to ``path``, and read back; what that shuffles is dropped."""
    spark, schema = df.sparkSession, df.schema
    path = path or shared_path(spark)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cut_apart(df: DataFrame, mark: Column) -> tuple[DataFrame, DataFrame, str]:
    """The rows of ``df`` with the mark and those without it, written at once, and the folder of the first, which can be dropped by itself."""
    spark, schema, path = df.sparkSession, df.schema, shared_path(df.sparkSession)
    with tidy(spark):
        df.withColumn("__mark", F.coalesce(mark.cast("int"), F.lit(0))).write.option("compression", "zstd").partitionBy("__mark").parquet(path)
    # a side without rows has no folder
    sides = [f"{path}/__mark={k}" for k in (1, 0)]
    made = [spark.read.schema(schema).parquet(side) if _folder(spark, side)[1] else spark.createDataFrame([], schema) for side in sides]
    return *made, sides[0]


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return lambda: store.delete(at, True), store.exists(at)


def discard(spark: SparkSession, path: str) -> None:
    """Drop a folder of intermediate data that nothing reads any more."""
    _folder(spark, path)[0]()


def read_files(spark: SparkSession, path: str, glob: str | None = None, paths: bool = False) -> DataFrame:
    """(file_id, name, mime, size, content) of every file below ``path``, with ``paths`` its path too; content is read only if it is used.

    A row holds a file of up to 2 GB; files of any size are read by ``sources.ranges``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return _named(raw, ["path"] if paths else [])


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_id, path, size) of every file below ``path``, without a byte of them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.xxhash64("path").alias("file_id"), "path", F.col("length").alias("size"))


def write_files(files: DataFrame, path: str) -> None:
    """Each row's ``content`` as the file ``name`` in the folder ``path``; a file appears when it is whole, so a task that runs twice does no harm."""

    def run(batches):
        store, folder = located(path)
        store.create_dir(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content or b"")
                store.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("name", "content").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same rows, for files as they land."""
    return _named(spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).load(path))


def write_by_viewer(files: DataFrame, path: str) -> None:
    """The triage result, one folder per viewer."""
    route_files(files).write.mode("overwrite").partitionBy("viewer_id").parquet(path)
