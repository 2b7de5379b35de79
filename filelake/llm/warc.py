"""WARC archives: a writer with revisit records, and a salvage reader.

The reader checks every record (member checksum, version line, headers, length, payload digest).
After a failed check it searches for the next gzip member or version line that passes, goes on
there, and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import chain

import pyarrow as pa
from pyarrow import fs as pafs

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table

VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
#: Bytes first read for a header block, and its greatest length; the writer refuses a longer one, the reader takes it for damage.
HEADER_STEP, MAX_HEADER = 8_192, 64 << 20
#: The greatest length of a block, likewise: more than a Spark row of two gigabytes takes anyway.
MAX_BLOCK = (1 << 31) - MAX_HEADER
#: Bytes of a member's records that wait for its checks.
HELD = 4 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, payload: bytes, digest: str, uri: str = "", refers_to: str = "", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record. A revisit has the HTTP head only, whose Content-Length still tells the payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        fields.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        fields += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    headers = "WARC/1.1\r\n".encode() + "\r\n".join(fields).encode() + CRLF * 2
    if len(block) > MAX_BLOCK:
        raise ValueError(f"the block of {record_id} has {len(block)} bytes; {MAX_BLOCK} can be read")
    if len(headers) > MAX_HEADER:
        raise ValueError(f"headers of {record_id} have {len(headers)} bytes; {MAX_HEADER} can be read")
    return headers + block + CRLF * 2


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so that equal records give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Window:
    """A forward window over a stream: bytes by absolute offset, dropped when passed."""

    def __init__(self, stream, step: int = 1 << 20):
        self.stream, self.step, self.base, self.buf, self.over = stream, step, 0, bytearray(), False
        self.hits: dict[bytes, tuple[int, int]] = {}  # the last hit of a pattern, and up to where it is known

    def fill(self, end: int) -> bool:
        while not self.over and self.base + len(self.buf) < end:
            got = self.stream.read(self.step)
            self.over = not got
            self.buf += got
        return self.base + len(self.buf) >= end

    def get(self, start: int, end: int) -> bytes:
        self.fill(end)
        return bytes(self.buf[start - self.base : end - self.base])

    def drop(self, upto: int) -> None:
        if upto - self.base > self.step:
            del self.buf[: upto - self.base]
            self.base = upto

    def _hit(self, what: bytes, start: int) -> int:
        """The next hit of one pattern in the buffer, or -1; starts only grow, so that no byte is searched twice."""
        at, upto = self.hits.get(what, (-1, 0))
        if at < start:
            begin = max(start, upto)
            at = self.buf.find(what, begin - self.base)
            at = at if at < 0 else at + self.base
            self.hits[what] = (at, at + 1 if at >= 0 else max(begin, self.base + len(self.buf) - len(what) + 1))
        return at

    def find(self, whats: tuple[bytes, ...], start: int) -> int:
        """Offset of the first occurrence of any of ``whats``, or -1; only bytes before it may be dropped."""
        longest = max(map(len, whats))
        while True:
            hits = [x for x in (self._hit(what, start) for what in whats) if x >= 0]
            # the patterns share no bytes, so one that is cut off at the end of the buffer begins after every whole hit
            if hits:
                return min(hits)
            if self.over:
                return -1
            start = max(start, self.base + len(self.buf) - longest + 1)
            self.drop(start)
            self.fill(self.base + len(self.buf) + 1)


def _digest(data: bytes, told: str) -> tuple[str, str]:
    """The SHA-1 of ``data`` in base32, and "", "wrong", or "unknown" if ``told`` is by another algorithm or absent."""
    sha = hashlib.sha1(data).digest()
    found, (name, _, value) = base64.b32encode(sha).decode(), told.strip().partition(":")
    if name.lower().replace("-", "") != "sha1" or not value:
        return found, "unknown" if told.strip() else ""
    return found, "" if value.upper() == found or value.lower() == sha.hex() else "wrong"


def _fields(block: bytes) -> dict | None:
    """Header lines by lower-case name; a line that begins with a blank or tab goes on with the one before."""
    fields, name = {}, None
    for line in block.split(CRLF)[1:]:
        if line[:1] in (b" ", b"\t"):
            if name is None:
                return None
            fields[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        name = name.strip().lower().decode("utf-8", "replace")
        fields[name] = value.strip().decode("utf-8", "replace")
    return fields


def _parse(data: bytes | bytearray, at: int = 0) -> tuple[dict | None, int, str]:
    """The record at offset ``at`` of ``data``: (fields, its length with the closing lines, reason of failure).

    A failed record has a length where its own leads to the closing lines, or, if truncated, might.
    A payload digest is checked if it is a SHA-1 (base32 or hex); of other algorithms ``note`` tells that it was not.
    """
    if not data.startswith(VERSION, at):
        return None, 0, "no version line"
    # most false heads show in the line behind theirs
    first = data.find(CRLF, at, at + 256) + 2
    second = data.find(CRLF, first, first + 4096)
    if second > first > 1 and data.find(b":", first, second) < 0:
        return None, 0, "malformed header"
    stop = data.find(CRLF * 2, at, at + MAX_HEADER)
    if stop < 0:
        torn = any(b":" not in line and line[:1] not in (b" ", b"\t") for line in data[at : at + MAX_HEADER].split(CRLF)[1:-1])
        return None, 0, "malformed header" if torn else "no end of headers"
    fields = _fields(bytes(data[at:stop]))
    if fields is None:
        return None, 0, "malformed header"
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return None, 0, "no content length"
    if len(size) > 18 or int(size) > MAX_BLOCK:
        return None, 0, "block too long"
    start, end = stop + 4, stop + 4 + int(size)
    length = end + 4 - at
    if len(data) < end + 4:
        return None, length, "truncated block"
    if data[end : end + 4] != CRLF * 2:
        return None, 0, "length mismatch"
    if fields.get("content-type", "").startswith("application/http"):
        gap = data.find(CRLF * 2, start, end)
        if gap < 0:
            return None, length, "no HTTP head"
        for line in data[start:gap].split(CRLF)[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                fields["http-length"] = int(value)
        start = gap + 4
    fields["payload"] = bytes(data[start:end])
    told = fields.get("warc-payload-digest", "")
    fields["note"], fields["digest"] = "", told.partition(":")[2].upper()
    if fields.get("warc-type") != "revisit":
        fields["digest"], state = _digest(fields["payload"], told)
        if state == "wrong":
            return None, length, "payload digest mismatch"
        fields["note"] = "digest not checked" if state else ""
    return fields, length, ""


class _Member:
    """The records of a gzip member, unpacked piece by piece; afterwards ``end``, ``whole`` and ``reason`` are known.

    ``whole`` tells that the member's own checks hold. Of a damaged one everything up to the damage is unpacked, to the byte.
    """

    def __init__(self, window: _Window, at: int, step: int = 16_384):
        self.window, self.end, self.step, self.whole, self.reason = window, at, step, False, ""

    def pieces(self):
        z, step = zlib.decompressobj(31), 1024
        while not z.eof:
            if not self.window.fill(self.end + 1):
                self.reason = "truncated member"
                return
            piece = self.window.get(self.end, self.end + step)
            before, step = z.copy(), self.step
            try:
                got = z.decompress(piece)
            except zlib.error as e:
                self.reason = f"bad member: {str(e)[:80]}"
                yield b"".join(self._last(before, piece))
                return
            self.end += len(piece) - len(z.unused_data)
            yield got
        self.whole = True

    def _last(self, z, piece: bytes, parts: tuple[int, ...] = (64, 1)):
        """What a piece gives before its damage, in ever smaller parts."""
        for k in range(0, len(piece), parts[0]):
            part = piece[k : k + parts[0]]
            before = z.copy() if parts[1:] else None
            try:
                yield z.decompress(part)
            except zlib.error:
                if before is not None:
                    yield from self._last(before, part, parts[1:])
                return

    def records(self):
        """Each record that passes its own checks, as soon as it is unpacked."""
        buf, at, need, seeking, begun = bytearray(), 0, len(VERSION), False, False
        for piece in chain(self.pieces(), [None]):
            buf += piece or b""
            if not begun and len(buf) >= len(VERSION):
                begun = True
                if not buf.startswith(VERSION):
                    self.whole, self.reason = False, "member without version line"
                    return
            while at < len(buf) and (len(buf) >= need or piece is None):
                if seeking:
                    hit = buf.find(VERSION, at)
                    at, seeking = (hit, False) if hit >= 0 else (max(at, len(buf) - len(VERSION) + 1), True)
                    if seeking:
                        break
                fields, size, failed = _parse(buf, at)
                if fields is not None:
                    at += size
                    yield fields
                    continue
                short = len(buf) - at < len(VERSION) or failed == "truncated block" or failed == "no end of headers" and len(buf) - at < MAX_HEADER
                if short and piece is not None:
                    # headers are looked at again when there is twice as much of them
                    need = at + size if failed == "truncated block" else at + max(len(VERSION), 2 * (len(buf) - at))
                    break
                if short and not self.whole:
                    # cut off by the damage: what its payload quotes is no record
                    return
                # go on behind the record, else at the next version line
                self.reason, seeking = self.reason or failed, True
                at += size if size and failed != "truncated block" else 1
            if at > 1 << 20:
                drop = min(at, len(buf))
                del buf[:drop]
                at, need = at - drop, need - drop


def salvage(stream):
    """Yield ('record', offset, length, reason, fields) and ('gap', offset, length, reason, None) of an archive.

    The file may be plain or compressed, with one record a member or many, and may change between the two. A damaged
    record whose own length still leads to its end goes as a whole. In a damaged member the records that pass their own
    checks are kept, with length 0, and its bytes are a gap; what stands behind the damage in it can't be unpacked.
    Memory is one record, or as many bytes as a damaged length promises (``MAX_BLOCK`` at most, the rest of the file at most),
    the compressed bytes of one member, ``HELD`` bytes of its records, and a window of about a megabyte.
    """
    window, at, bad, why = _Window(stream), 0, -1, ""

    while window.fill(at + 1):
        head = window.get(at, at + len(VERSION))
        found, held, end, reason = [], 0, at, ""
        if head.startswith(MAGIC):
            one = _Member(window, at)
            some = False
            for fields in one.records():
                some = True
                found.append(fields)
                held += len(fields["payload"]) + 1024
                if held > HELD:
                    # the member is not read to its end, so its checks are not known yet
                    for fields in found:
                        yield "record", at, 0, fields["note"] or "in a long member", fields
                    found, held = [], 0
            end, reason = one.end, one.reason
            after = end if one.whole else at + 1
            ok = one.whole and not reason and some
        elif head == VERSION:
            ahead, after = HEADER_STEP, at + 1
            fields, size, reason = _parse(window.get(at, at + ahead))
            while reason == "no end of headers" and ahead < MAX_HEADER and window.fill(at + ahead):
                ahead *= 4
                fields, size, reason = _parse(window.get(at, at + ahead))
            if fields is None and reason == "truncated block" and window.fill(at + size):
                fields, size, reason = _parse(window.get(at, at + size))
            ok, end = fields is not None, at + size
            found = [fields] if ok else []
            # a record whose length holds is damaged as a whole: what its payload quotes is no record
            after = at + size if size and reason != "truncated block" else after
        else:
            ok, reason, after = False, "no record here", at + 1
        if ok:
            if bad >= 0:
                yield "gap", bad, at - bad, why, None
                bad = -1
            for fields in found:
                yield "record", at, end - at, fields["note"], fields
            at = end
            window.drop(at)
            continue
        if bad < 0:
            bad, why = at, reason
        # records of a member around its damaged one are whole: keep them, quarantine the member's bytes
        for fields in found:
            yield "record", at, 0, "in a damaged member", fields
        at = window.find((MAGIC, VERSION), after)
        if at < 0:
            break
    end = window.base + len(window.buf)
    if bad >= 0:
        while not window.over:
            window.fill(window.base + len(window.buf) + 1)
            end = window.base + len(window.buf)
        yield "gap", bad, end - bad, why, None


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write one record per row to ``path`` (a shared file system pyarrow knows) and return the manifest.

    Of rows with equal payloads of at least ``least_bytes`` the smallest key is the response and
    the others revisit it (rows that repeat that key too are responses); null payloads are empty,
    a null key never is the response of others. Digests are grouped with map-side combining and
    joined back by an outer join that Spark may split where one payload is very common. Files
    get their final name only when whole, with the attempt in it: the manifest lists those of the
    attempt that counts, so neither a retried nor a second attempt changes what is read.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    first = rows.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "sha", "left").select("page_id", "url", "html", F.when(F.col("size") >= least_bytes, F.col("first")).alias("first"))

    def run(batches):
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, out, name, n, size, number = task.partitionId(), None, "", 0, 0, 0

        def close():
            out.close()
            store.move(f"{root}/{name}.tmp", f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"file": name, "records": n, "bytes": size}], schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, first = (batch.column(c)[k].as_py() for c in range(4))
                if out is None:
                    name, n, size, number = f"part-{part:06d}-{number:04d}-{task.taskAttemptId()}.warc.gz", 0, 0, number + 1
                    out = store.open_output_stream(f"{root}/{name}.tmp")
                payload = html.encode()
                revisit = first is not None and first != page
                data = member(record("revisit" if revisit else "response", f"urn:page:{page}", payload, sha1_base32(payload), url or "", f"urn:page:{first}"))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(rows.mapInArrow(run, "file string, records long, bytes long"))


READ_SCHEMA = "file string, kind string, offset long, length long, reason string, type string, record_id string, refers_to string, uri string, digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, files: DataFrame, payload: bool = True) -> DataFrame:
    """All records and gaps of the archives named in ``files.file`` below ``path``; one task streams a file."""
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def run(batches):
        store, root = pafs.FileSystem.from_uri(path)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for kind, offset, length, reason, f in salvage(stream):
                        f = f or {}
                        body = f.get("payload")
                        size = f.get("http-length") if f.get("warc-type") == "revisit" else len(body) if body is not None else None
                        ids = [(f.get(x) or "").strip("<>") or None for x in ("warc-record-id", "warc-refers-to")]
                        rows.append([name, kind, offset, length, reason, f.get("warc-type"), *ids, f.get("warc-target-uri"), f.get("digest"), size, body if payload else None])
                        held += len(body or b"") if payload else 200
                        if held > 1 << 22:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    n = max(1, min(files.count(), 4096))
    return files.select("file").repartition(n, "file").mapInArrow(run, READ_SCHEMA)


def op3_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = shared_dir(spark)
    manifest = write_archives(pages, path)
    records = read_archives(spark, path, manifest, payload=False).where("kind = 'record'")
    kind = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as {kind})")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", number("refers_to")).alias("refers_to"),
    )


QUERIES = {"op3_warc": op3_warc}
ORACLES: dict[str, str] = {
    "op3_warc": """with p as (select page_id, coalesce(html, '') as t from pages), q as (select page_id, octet_length(encode(t)) as n, sha1(t) as h, min(page_id) over (partition by t) as first from p)
select page_id, cast(n as bigint) as payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, cast(5 * (i // 4) + 1 as int), 5))::int >> cast(15 - 5 * (i % 4) as int)) & 31) + 1)::int, 1)), '') as payload_digest,
 case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from q"""
}
