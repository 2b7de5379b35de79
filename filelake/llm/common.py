"""Helpers shared by the corpus operators: shared storage, components, small column idioms."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a session on one machine gets a temporary one, a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="filelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/filelake-{uuid.uuid4().hex}")
    return _made[-1]


#: Folders that this process has asked for and not dropped.
_made: list[str] = []


def made() -> int:
    """How many folders there are, for ``sweep``."""
    return len(_made)


def sweep(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Drop the folders made after ``since``: what has been read from them must be written elsewhere by then."""
    for path in _made[since:]:
        if not keep.startswith(path):
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Drop one folder of intermediate data."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut there."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


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


#: Bytes that may be broadcast.
BROADCAST_BYTES = 32 << 20


def small(rows: DataFrame, width: int | str, written: bool = False) -> DataFrame:
    """Marked for broadcast up to ``BROADCAST_BYTES``, at ``width`` bytes a row (or a column of them); joined by hash beyond that. ``written``: the rows are a table already."""
    rows = rows if written else materialise(rows)
    size = rows.agg(F.sum(F.lit(width) if isinstance(width, int) else F.expr(width))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, parts: int, part: int):
    """True where crc32 of the id as text leaves remainder ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: columns ``id``, ``component`` (smallest id).

    Alternating large-star and small-star rounds. Each round groups by node with map-side
    combining and writes its edges to the shared folder, so a lost executor costs one round.
    A node's neighbours are joined with its smallest one by hash; Spark splits such a join where a
    node has very many. Only ids that occur in an edge
    are returned; null ids and self-loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    spark, table = edges.sparkSession, shared_dir(edges.sparkSession)
    e = materialise(e, table)
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = e.union(e.select("v", "u")).toDF("n", "m")
        least = both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo"))
        e = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("lo").alias("v")).distinct()
        # small star: every smaller neighbour, and the node itself, link to the smallest
        least = e.groupBy("u").agg(F.min("v").alias("lo"))
        e = (
            e.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("lo").alias("v"))
            .where("u <> v")
            .distinct()
        )
        e, last, table = materialise(e, fresh := shared_dir(spark)), table, fresh
        discard(spark, last)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null becomes empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batches, rows: int = 256):
    """Arrow batches cut to a few rows, so that scratch arrays stay small however long the texts are."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
