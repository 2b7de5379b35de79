"""Files in byte ranges, for files of any size: a data source of raw ranges, and lines, hex rows and strings without whole files.

A file is cut into ranges of equal size, each one task's work. What crosses a cut belongs to the
range it begins in, whose task reads on beyond its end; where a task must begin is told by a first pass, of which a
few numbers per range are carried through the file in order. So files are read twice and no bytes are shuffled, and a task
holds one range, or one line if that is longer.

Paths go through ``pyarrow.fs``, so the store must be one that it knows (file, hdfs, s3, gs). Files must not change between the passes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.views import RUN, hex_columns
from .access import Bytes, located

RANGE = 64 << 20
#: Bytes that tell whether a character or line break goes on at a cut.
SEAM = 4


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges")``: (path, size, offset, data), a partition per range, or per as many of a file's as ``taskBytes`` hold.

    Options: ``path``, a file or a folder that is searched through and through; ``rangeBytes``; ``taskBytes``. Empty files have no range, as Spark's file sources leave them out.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, size long, offset long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("rangeBytes", RANGE))
        self.task = max(int(options.get("taskBytes", 0)) // self.step, 1) * self.step

    def partitions(self) -> list[InputPartition]:
        store, at = located(self.path)
        root = store.get_file_info(at)
        found = [root] if root.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True))
        prefix = "file:" if isinstance(store, pafs.LocalFileSystem) else self.path[: len(self.path) - len(at)]
        hidden = lambda p: any(x[:1] in "._" for x in p[len(at) :].strip("/").split("/"))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not hidden(f.path))
        return [InputPartition((prefix + path, size, k)) for path, size in files for k in range(0, size, self.task)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, size, offset = partition.value
        with Bytes(path, size) as file:
            for at in range(offset, min(offset + self.task, size), self.step):
                data = file.read(at, at + self.step)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["path", "size", "offset", "data"])


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE, task_bytes: int = 0) -> DataFrame:
    """(file_id, name, path, size, offset, data) of every file below ``path``, a row and a partition per range; ids are those of ``read_files``.

    Small ranges can share a partition, as many of a file's as ``task_bytes`` hold.
    """
    spark.dataSource.register(ByteRanges)
    rows = spark.read.format("byte_ranges").option("rangeBytes", range_bytes).option("taskBytes", task_bytes).load(path)
    return rows.select(F.xxhash64("path").alias("file_id"), F.substring_index("path", "/", -1).alias("name"), "path", "size", "offset", "data")


def file_digests(rows: DataFrame) -> DataFrame:
    """(file_id, n, size, md5) of the rows of ``read_ranges``: how many ranges a file has, and the MD5 of its bytes in order.

    Ranges of a file are sorted in one task, which holds no more than an Arrow batch of them.
    """

    def run(batches):
        now, n, total, digest = None, 0, None, None
        for batch in batches:
            done = []
            for file_id, size, data in zip(*(batch.column(c) for c in range(3)), strict=True):
                if (file_id := file_id.as_py()) != now:
                    if digest:
                        done.append((now, n, total, digest.hexdigest()))
                    now, n, total, digest = file_id, 0, size.as_py(), hashlib.md5()
                digest.update(data.as_buffer())
                n += 1
            yield records(done)
        if digest:
            yield records([(now, n, total, digest.hexdigest())])

    def records(done):
        ids, counts, sizes, sums = zip(*done, strict=True) if done else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["file_id", "n", "size", "md5"])

    ordered = rows.select("file_id", "offset", "size", "data").repartition("file_id").sortWithinPartitions("file_id", "offset")
    return ordered.select("file_id", "size", "data").mapInArrow(run, "file_id long, n long, size long, md5 string")


def list_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE, glob: str | None = None) -> DataFrame:
    """(file_id, path, size, offset, stop) of every file below ``path``, without a byte of them; ranges are dealt over the tasks."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.xxhash64("path").alias("file_id"), "path", F.col("length").alias("size"))
    last = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / range_bytes)
    rows = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    rows = rows.select("file_id", "path", "size", (F.col("k") * range_bytes).alias("offset"), F.least((F.col("k") + 1) * range_bytes, F.col("size")).alias("stop"))
    return rows.repartition("file_id", "offset")


def _per_range(ranges: DataFrame, work, fields: str, carried: str = "") -> DataFrame:
    """``work(file, file_id, offset, stop, carry)`` of every range, which gives Arrow columns for the fields; a range at a time."""
    names = [f.split()[0] for f in fields.split(", ")]
    columns = ["file_id", "path", "size", "offset", "stop", *([carried] if carried else [])]

    def run(batches):
        for batch in batches:
            for file_id, path, size, offset, stop, *carry in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                with Bytes(path, size) as file:
                    for arrays in work(file, file_id, offset, stop, *carry):
                        yield pa.RecordBatch.from_arrays(arrays, names)

    return ranges.select(*columns).mapInArrow(run, fields)


def _line_starts(file: Bytes, offset: int, stop: int) -> np.ndarray:
    """Where the lines begin that begin in a range: at 0, and behind LF, CRLF or a CR alone."""
    around = np.frombuffer(file.read(offset - 1, stop), np.uint8)
    here, before = (around[1:], around[:-1]) if offset else (around, np.r_[np.uint8(0), around[:-1]])
    begins = (before == 10) | ((before == 13) & (here != 10))
    if not offset and len(begins):
        begins[0] = True
    starts = np.flatnonzero(begins) + offset
    # a break at the very end of the file begins an empty line; so does an empty file
    if stop == file.size and (stop == 0 or around[-1] in (10, 13)):
        starts = np.r_[starts, stop]
    return starts


def range_lines(ranges: DataFrame) -> DataFrame:
    """(file_id, line_no from 1, text) of files in UTF-8, as ``split_lines`` gives them of whole files.

    A line belongs to the range it begins in; its number is the count of lines that began before, carried over the ranges.
    """

    def count(file, file_id, offset, stop):
        yield [pa.array([file_id], pa.int64()), pa.array([offset], pa.int64()), pa.array([len(_line_starts(file, offset, stop))], pa.int64())]

    def lines(file, file_id, offset, stop, carry):
        starts = _line_starts(file, offset, stop)
        if not len(starts):
            return
        data, end, limit = bytearray(file.read(offset, stop)), stop, 1 << 16
        # the last line goes on until a break, which may be far behind the range
        while end < file.size and not re.search(rb"\n|\r[^\n]", data[max(int(starts[-1]) - offset, end - offset - limit - 1) :]):
            limit *= 2
            data += file.read(end, end + limit)
            end = min(end + limit, file.size)
        for k in range(0, len(starts), 4096):
            text = []
            for start, following in zip(starts[k : k + 4096], [*starts[k + 1 : k + 4097], None], strict=False):
                piece = bytes(data[start - offset : (following - offset) if following is not None else None])
                if following is None:
                    piece = re.split(rb"\r\n|\r|\n", piece, maxsplit=1)[0]
                text.append(piece.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                if start == 0:
                    text[-1] = text[-1].removeprefix("﻿")
            n = len(text)
            yield [pa.array([file_id] * n, pa.int64()), pa.array(np.arange(carry + k + 1, carry + k + n + 1)), pa.array(text, pa.string())]

    counted = _per_range(ranges, count, "file_id long, offset long, n long")
    before = Window.partitionBy("file_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    carried = counted.select("file_id", "offset", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"))
    return _per_range(ranges.join(carried, ["file_id", "offset"]), lines, "file_id long, line_no long, text string", "carry")


def range_hex(ranges: DataFrame) -> DataFrame:
    """(file_id, row_no, offset, hex, ascii), as ``hex_dump`` gives them of whole files; a row belongs to the range it begins in."""

    def rows(file, file_id, offset, stop):
        first = -(-offset // 16)
        for at in range(first * 16, stop, 1 << 20):
            last = min(-(-stop // 16) * 16, at + (1 << 20))
            data = file.read(at, last)
            parts = [data[k : k + 16] for k in range(0, len(data), 16)]
            n = len(parts)
            yield [pa.array([file_id] * n, pa.int64()), pa.array(np.arange(at // 16, at // 16 + n)), pa.array([file.size] * n, pa.int64()), pa.array(parts, pa.binary())]

    return hex_columns(_per_range(ranges, rows, "file_id long, row_no long, size long, part binary"))


def _walk(data: bytes, start: int, at: int, stop: int, max_run: int, runs: list[tuple[int, int]], found: list | None = None) -> int:
    """Where the first piece begins at or behind ``stop`` if one may begin at ``at``; ``found`` gets the pieces before it.

    ``data`` begins at byte ``start`` of the file, ``runs`` are the printable runs in it, by their places in the file.
    """
    for begin, end in runs:
        if at >= stop:
            break
        if end <= at:
            continue
        at = max(at, begin)
        while at < end and at < stop:
            piece = at
            at = min(at + max_run, end)
            while at < end and data[at - start] & 0xC0 == 0x80:
                at += 1
            if found is not None:
                found.append((piece, data[piece - start : at - start]))
    return max(at, stop)


def _range_runs(file: Bytes, offset: int, stop: int, max_run: int) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The bytes of a range with what a piece can reach into, where they begin, and their runs."""
    start = max(offset - SEAM, 0)
    data = file.read(start, stop + max_run + 2 * SEAM)
    return data, start, [(m.start() + start, m.end() + start) for m in RUN.finditer(data)]


def range_strings(ranges: DataFrame, min_length: int = 4, max_run: int = 4096) -> DataFrame:
    """(file_id, offset, text) of printable strings, as ``extract_strings`` gives them of whole files.

    Pieces of a run are cut from the run's beginning on, so a range must know where its first piece begins. A range with a
    break in it tells the next one that without knowing it itself; one that lies inside a run tells it for every place where its first piece may begin, ``max_run`` and a few.
    """
    reach = max_run + SEAM

    def summary(file, file_id, offset, stop):
        data, start, runs = _range_runs(file, offset, stop, max_run)
        over = next(((a, b) for a, b in runs if a <= offset and b >= stop and stop > offset), None)
        if over is None or offset == 0:
            # from the first break on nothing depends on what was before
            within = next((b for a, b in runs if a < offset < b), offset)
            table = [_walk(data, start, within, stop, max_run, runs) - stop]
        else:
            # all places where a piece may begin go from piece to piece at once
            inner, end = np.frombuffer(data, np.uint8) & 0xC0 == 0x80, over[1]
            at = offset + np.arange(reach + 1)
            while (active := at < stop).any():
                following = np.minimum(at + max_run, end)
                for _ in range(3):
                    following += (following < end) & inner[np.minimum(following, end - 1) - start]
                at = np.where(active, following, at)
            table = at - stop
        yield [pa.array([file_id], pa.int64()), pa.array([offset], pa.int64()), pa.array([stop], pa.int64()), pa.array([table], pa.list_(pa.int32()))]

    def carry(batches):
        now, at = None, 0
        for batch in batches:
            begins = []
            for file_id, offset, stop, table in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                now, at = file_id, at if file_id == now else 0
                begins.append(at)
                at = stop + (table[0] if len(table) == 1 else table[at - offset])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begins, pa.int64())], ["file_id", "offset", "begin"])

    def strings(file, file_id, offset, stop, begin):
        if begin >= stop:
            return
        data, start, runs = _range_runs(file, offset, stop, max_run)
        pieces: list[tuple[int, bytes]] = []
        _walk(data, start, begin, stop, max_run, runs, pieces)
        texts = [(at, piece.decode()) for at, piece in pieces]
        texts = [(at, t.removeprefix("﻿")) for at, t in texts if len(t) >= min_length]
        for k in range(0, len(texts), 4096):
            part = texts[k : k + 4096]
            yield [pa.array([file_id] * len(part), pa.int64()), pa.array([at for at, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())]

    summaries = _per_range(ranges, summary, "file_id long, offset long, stop long, table array<int>")
    ordered = summaries.repartition("file_id").sortWithinPartitions("file_id", "offset")
    begins = ordered.mapInArrow(carry, "file_id long, offset long, begin long")
    return _per_range(ranges.join(begins, ["file_id", "offset"]), strings, "file_id long, offset long, text string", "begin")
