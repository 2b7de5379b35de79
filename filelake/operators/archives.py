"""ZIP archives by their directory: listed without unpacking, entries dealt over tasks and inflated in pieces.

A listing reads the tail of an archive and its central directory. Each entry is then a row with the place of
its data, so the entries of one large archive spread over all tasks; a task reads its entry alone and holds one piece of it.
What is damaged is an error row: an archive without a readable directory, or one entry, whatever stands around it.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.access import Bytes

#: Bytes of unpacked content in a row, and of packed content read at once.
PIECE, CHUNK = 8 << 20, 1 << 20
#: What a directory tells of an entry.
ENTRY = {"entry_no": pa.int64(), "path": pa.string(), "at": pa.int64(), "packed": pa.int64(), "size": pa.int64(), "crc": pa.int64(), "method": pa.int32(), "locked": pa.bool_(), "error": pa.string()}


class Damaged(Exception):
    """An entry that can't be unpacked."""


def directory(file) -> Iterator[tuple]:
    """Fields of ``ENTRY`` of the files in a ZIP, folders left out; ``file`` is read at its tail and in its directory only."""
    with zipfile.ZipFile(file) as archive:
        for k, i in enumerate(archive.infolist()):
            if not i.is_dir():
                yield k, i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, bool(i.flag_bits & 1), None


def inflated(read, at: int, packed: int, size: int, crc: int, method: int, locked: bool, piece: int = PIECE) -> Iterator[bytes]:
    """The content of one entry in pieces; ``read(start, stop)`` gives bytes of the archive. Raises ``Damaged`` behind what is good."""
    if locked or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise Damaged("locked" if locked else f"method {method}")
    head = read(at, at + 30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise Damaged("no entry where the directory says")
    start = at + 30 + sum(struct.unpack("<HH", head[26:30]))
    machine = zlib.decompressobj(-15) if method else None
    check, total, waiting = 0, 0, bytearray()
    for k in range(start, start + packed, CHUNK):
        rest = read(k, min(k + CHUNK, start + packed))
        if not rest:
            raise Damaged("the archive ends inside the entry")
        while rest:
            if machine is None:
                out, rest = rest, b""
            else:
                try:
                    out = machine.decompress(rest, piece)
                except zlib.error as e:
                    raise Damaged(str(e)) from e
                rest = machine.unconsumed_tail
            check, total = zlib.crc32(out, check), total + len(out)
            if total > size:
                raise Damaged("longer than the directory says")
            waiting += out
            while len(waiting) >= piece:
                yield bytes(waiting[:piece])
                del waiting[:piece]
            if not out and not rest:
                break
    if machine is not None:
        # what the last input left to be given out
        out = machine.flush()
        check, total = zlib.crc32(out, check), total + len(out)
        waiting += out
        if not machine.eof:
            raise Damaged("the entry is not complete")
    if total != size or check != crc:
        raise Damaged("wrong checksum" if total == size else "shorter than the directory says")
    if waiting or not size:
        yield bytes(waiting)


def list_archives(files: DataFrame) -> DataFrame:
    """(file_id, archive, archive_size, entry_no, path, at, packed, size, crc, method, locked, error) of ZIP files.

    ``files`` are (file_id, path, size) rows, such as ``list_files`` gives. An archive whose directory can't be read is one row with its error.
    """

    def run(batches):
        for batch in batches:
            for file_id, path, size in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows = []
                try:
                    with Bytes(path, size) as file:
                        rows += directory(file.file)
                except (zipfile.BadZipFile, OSError, ValueError, struct.error, NotImplementedError) as e:
                    rows = [(*[None] * (len(ENTRY) - 1), str(e) or type(e).__name__)]
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    same = [pa.array([x] * len(part), t) for x, t in ((file_id, pa.int64()), (path, pa.string()), (size, pa.int64()))]
                    yield pa.RecordBatch.from_arrays(same + [pa.array(x, t) for x, t in zip(zip(*part, strict=True), ENTRY.values(), strict=True)], ["file_id", "archive", "archive_size", *ENTRY])

    schema = "file_id long, archive string, archive_size long, entry_no long, path string, at long, packed long, size long, crc long, method int, locked boolean, error string"
    return files.select("file_id", "path", "size").mapInArrow(run, schema)


def entry_pieces(entries: DataFrame, piece: int = PIECE) -> DataFrame:
    """(file_id, entry_no, path, piece_no, data, error): content of listed entries in pieces of ``piece`` bytes, of any size in all.

    Entries are dealt over the tasks. A damaged one ends with a row that has its error and no data; its sound beginning may stand before that.
    """
    columns = ["file_id", "archive", "archive_size", "entry_no", "path", "at", "packed", "size", "crc", "method", "locked", "error"]

    def run(batches):
        row = lambda file_id, no, path, k, data, error: pa.RecordBatch.from_arrays(
            [pa.array([file_id], pa.int64()), pa.array([no], pa.int64()), pa.array([path], pa.string()), pa.array([k], pa.int64()), pa.array([data], pa.binary()), pa.array([error], pa.string())],
            ["file_id", "entry_no", "path", "piece_no", "data", "error"],
        )
        for batch in batches:
            for file_id, archive, whole, no, path, *where, error in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if error is not None:
                    yield row(file_id, no, path, 0, None, error)
                    continue
                k = 0
                try:
                    with Bytes(archive, whole) as file:
                        for data in inflated(file.read, *where, piece):
                            yield row(file_id, no, path, k, data, None)
                            k += 1
                except (Damaged, OSError) as e:
                    yield row(file_id, no, path, k, None, str(e) or type(e).__name__)

    dealt = entries.select(*columns).repartition("file_id", "entry_no")
    return dealt.mapInArrow(run, "file_id long, entry_no long, path string, piece_no long, data binary, error string")


def unpacked(data: bytes, max_entry: int) -> Iterator[tuple[int | None, str | None, int | None, bytes | None, str | None]]:
    """(entry_no, path, size, content, error) of an archive in memory; a bad entry is a row, and so is a bad archive."""
    try:
        entries = [*directory(io.BytesIO(data))]
    except (zipfile.BadZipFile, OSError, ValueError, struct.error, NotImplementedError) as e:
        yield None, None, None, None, str(e) or type(e).__name__
        return
    for no, path, at, packed, size, crc, method, locked, _ in entries:
        if size > max_entry:
            yield no, path, size, None, "too large for a row, see entry_pieces"
            continue
        try:
            yield no, path, size, b"".join(inflated(lambda a, b: data[a:b], at, packed, size, crc, method, locked)), None
        except Damaged as e:
            yield no, path, size, None, str(e)


def explode_archives(files: DataFrame, max_entry: int = 500 << 20) -> DataFrame:
    """(file_id, path, size, content, error, entry_no): every file of each ZIP in a column ``content``, one row at a time.

    A corrupt archive is an error row without path, a corrupt entry one with its path. Entries above ``max_entry`` bytes come without content here:
    from files ``list_archives`` and ``entry_pieces`` give those of any size.
    """

    def run(batches):
        for batch in batches:
            kinds = [batch.column(0).type, pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
            for k in range(batch.num_rows):
                file_id, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                for no, path, size, content, error in unpacked(data, max_entry):
                    row = (file_id, path, size, content, error, no)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["file_id", "path", "size", "content", "error", "entry_no"])

    kind = dict(files.dtypes)["file_id"]
    return files.select("file_id", "content").mapInArrow(run, f"file_id {kind}, path string, size long, content binary, error string, entry_no long")


def entry_contents(pieces: DataFrame, max_bytes: int = 500 << 20) -> DataFrame:
    """(file_id, entry_no, path, size, content, error): pieces put together again where an entry is no larger than ``max_bytes``; else without content."""
    whole = pieces.groupBy("file_id", "entry_no", "path").agg(
        F.sum(F.octet_length("data")).alias("size"), F.max("error").alias("error"), F.sort_array(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("piece_no", "data")))).alias("parts")
    )
    small = F.col("error").isNull() & (F.col("size") <= max_bytes)
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    return whole.select("file_id", "entry_no", "path", "size", F.when(small, joined).alias("content"), "error")
