"""Streams without state, with aggregates in update mode, and with a state per file; each gives what its batch form gives."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.triage import route_files
from ..operators.views import RUN, TAIL, _runs
from ..sources.files import shared_path

#: An unfinished character at the end of bytes.
CUT = re.compile(TAIL.removesuffix("$").encode("latin-1") + rb"\Z")


class Upserts:
    """What a stream in update mode has given so far: each batch writes only the rows that it changed, as a folder of its own.

    A batch that runs again replaces its folder, so replays do no harm. Read, the newest row of each key counts. ``compact``
    folds the folders of batches that are done into one, which is written whole before they are dropped from reading.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema):
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self._newest(self.spark.read.schema(self.schema).parquet(self.path))

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = self.schema.names
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in columns if c not in self.keys]), "batch").alias("row"))
        return newest.select(*self.keys, "row.*").select(*columns)

    def compact(self, upto: int) -> None:
        """Batches up to ``upto`` as one, under its number; later ones stay as they are."""
        manager = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = manager.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(f.getPath().getName().removeprefix("batch=")) for f in store.listStatus(root) if f.getPath().getName().startswith("batch="))
        done = [k for k in done if k <= upto]
        if len(done) > 1:
            folded = self._newest(self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/batch={k}" for k in done]))
            folded.write.mode("overwrite").parquet(f"{self.path}/_folded")
            # what has been folded wins over the older folders from here on, also if the next steps are cut short
            store.delete(manager.Path(f"{self.path}/batch={done[-1]}"), True)
            store.rename(manager.Path(f"{self.path}/_folded"), manager.Path(f"{self.path}/batch={done[-1]}"))
            for k in done[:-1]:
                store.delete(manager.Path(f"{self.path}/batch={k}"), True)


def run_once(rows: DataFrame, make: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, files_per_batch: int | None = None) -> DataFrame:
    """What ``make`` gives of ``rows`` as a stream, run over all that is there: written to the shared folder, read from there.

    Without ``keys`` rows are appended; with them the stream runs in update mode, and the newest row of each key is the result.
    """
    spark, source, out = rows.sparkSession, shared_path(rows.sparkSession), shared_path(rows.sparkSession)
    rows.write.parquet(source)
    reader = spark.readStream.schema(rows.schema)
    found = make((reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source))
    sink = found.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if keys is None:
        sink.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(found.schema).parquet(out)
    upserts = Upserts(spark, out, keys, found.schema)
    sink.outputMode("update").foreachBatch(upserts.write).start().awaitTermination()
    return upserts.read()


def triage_stream(files: DataFrame) -> DataFrame:
    """Routing is one expression per row, so a stream of files needs no state."""
    return route_files(files)


def latest_open(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(user_id, day, generation, ts): the newest open of each user and day, for a stream in update mode.

    State is a row per user and day and ends when the watermark, ``late`` behind the newest event, has passed the day; opens of days that are
    over by then are dropped. ``newest`` folds the days.
    """
    days = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("day"))
    opens = days.agg(F.max("generation").alias("generation"), F.max_by("ts", "generation").alias("ts"))
    return opens.select("user_id", F.col("day.start").alias("day"), "generation", "ts")


def newest(opens: DataFrame) -> DataFrame:
    """(user_id, generation, ts): over all days."""
    return opens.groupBy("user_id").agg(F.max("generation").alias("generation"), F.max_by("ts", "generation").alias("ts"))


def scan_progress(chunks: DataFrame) -> DataFrame:
    """(file_id, bytes_read, total, percent): bytes read of each file's total, as whole percent; on a stream in update mode a batch gives the files that went on."""
    read = chunks.groupBy("file_id").agg(F.sum("bytes").alias("bytes_read"), F.max("total").alias("total"))
    return read.withColumn("percent", F.floor(F.col("bytes_read") * 100 / F.greatest("total", F.lit(1))).cast("long"))


def _settled(buffer: bytes, max_run: int) -> int:
    """How many bytes of a buffer can be scanned now: up to the last run that more bytes could lengthen, less its full pieces."""
    cut = CUT.search(buffer[-3:])
    body = len(buffer) - (len(cut.group()) if cut else 0)
    at = next((m.start() for m in RUN.finditer(buffer, 0, body) if m.end() == body), body)
    while at + max_run <= body:
        at += max_run
        while at < body and buffer[at] & 0xC0 == 0x80:
            at += 1
    return at


def strings_stream(chunks: DataFrame, min_length: int = 4, max_run: int = 4096) -> DataFrame:
    """(file_id, offset, text) of printable strings in (file_id, offset, data, last) chunks that come in any order.

    The state of a file is its open run, the next offset and chunks that came early. A chunk that
    ends at or before the next offset is a repeat and dropped. The chunk marked ``last`` ends a
    file; the result is that of ``extract_strings`` on whole files, however they are cut.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, carry, early = state.get if state.exists else (0, b"", pickle.dumps({}))
        early, found, done = pickle.loads(early), [], at < 0
        for frame in frames:
            for offset, data, last in zip(frame["offset"], frame["data"], frame["last"], strict=True):
                if offset + len(data) > at or (last and offset == at):
                    early[int(offset)] = (bytes(data), bool(last))
        while not done and at in early:
            data, done = early.pop(at)
            buffer, start = bytes(carry) + data, at - len(carry)
            ready = len(buffer) if done else _settled(buffer, max_run)
            found += [(start + o, text) for o, text in _runs(buffer[:ready], min_length, max_run)]
            at, carry = at + len(data), buffer[ready:]
            early = {o: x for o, x in early.items() if o + len(x[0]) > at or (x[1] and o == at)}
            if not data and not done:
                break
        # a finished file keeps a mark, so that repeats stay without effect
        state.update((-1, b"", pickle.dumps({})) if done else (at, carry, pickle.dumps(early)))
        yield pd.DataFrame({"file_id": [key[0]] * len(found), "offset": [o for o, _ in found], "text": [t for _, t in found]}).astype({"file_id": "int64", "offset": "int64"})

    return chunks.groupBy("file_id").applyInPandasWithState(
        update, "file_id long, offset long, text string", "next long, carry binary, early binary", "append", GroupStateTimeout.NoTimeout
    )
