"""Readers that users add, extraction of every routed file in one pass, and archives inside archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import batched
from typing import NamedTuple

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_name
from ..sources.files import cut_apart, cut_lineage, discard, shared_path
from .archives import explode_archives
from .packages import docx_numbered, odf_text, ods_grids, slide_text, workbook_grids
from .triage import is_zip, with_route
from .views import _runs, with_encoding, with_text


class Reader(NamedTuple):
    """A format: its extensions, a cheap test and the final test as columns over ``extension`` and ``head``, and content to texts."""

    viewer_id: str
    extensions: tuple[str, ...]
    sniff: Callable[[], Column]
    matches: Callable[[], Column]
    extract: Callable[[bytes], Iterable[str]]


def register_reader(readers: tuple[Reader, ...], viewer_id: str, extensions, sniff, matches, extract) -> tuple[Reader, ...]:
    """The readers with one more, after those there are."""
    if any(r.viewer_id == viewer_id for r in readers):
        raise ValueError(f"there is a reader {viewer_id} already")
    return (*readers, Reader(viewer_id, tuple(extensions), sniff, matches, extract))


def _names(data: bytes) -> Iterator[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        yield from (i.filename for i in archive.infolist() if not i.is_dir())


def _none(data: bytes) -> Iterator[str]:
    raise ValueError("no readable block")


def _strings(data: bytes) -> Iterator[str]:
    return (text for _, text in _runs(data, 4, 4096))


def office_texts(files: DataFrame) -> DataFrame:
    """(file_id, seq, text) of office packages: paragraphs with their list prefixes, slides, ODF text, rows of sheets with tabs between cells.

    Texts are written to the shared folder kind by kind; the unpacked entries are dropped then.
    """
    spark, path = files.sparkSession, shared_path(files.sparkSession)
    entries = cut_lineage(explode_archives(files.where(is_zip(F.col("content")))).where("content is not null"), path)
    parts = [
        docx_numbered(entries).select("file_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), "seq", F.concat_ws(" ", "prefix", "text").alias("text")),
        slide_text(entries).select("file_id", F.lit(1).alias("kind"), F.col("slide_no").cast("long").alias("part"), "seq", "text"),
        odf_text(entries).select("file_id", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("part"), "seq", "text"),
        workbook_grids(entries).select("file_id", F.lit(3).alias("kind"), F.col("sheet_no").alias("part"), F.col("row").alias("seq"), F.array_join("cells", "\t").alias("text")),
        ods_grids(entries).select("file_id", F.lit(4).alias("kind"), F.col("sheet_no").alias("part"), F.col("row").alias("seq"), F.array_join("cells", "\t").alias("text")),
    ]
    found = reduce(DataFrame.unionByName, [cut_lineage(part) for part in parts])
    discard(spark, path)
    w = Window.partitionBy("file_id").orderBy("kind", "part", "seq")
    return found.select("file_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), "text")


def extract_all(files: DataFrame, readers: tuple[Reader, ...] = ()) -> DataFrame:
    """(file_id, viewer_id, seq, text, error): each file by the reader it is routed to.

    Documents and code give lines, decoded by the encoding that is found, archives the names of their entries, office packages their texts,
    all else printable strings. Where a reader fails, or an office file gives no text, the error
    is a row with a null text and the strings follow. A reader that a user adds takes the place of a fixed one of its name.
    """
    extractors = {"archive": _names, "office": _none} | {r.viewer_id: r.extract for r in readers}
    textual = [v for v in ("doc", "code") if v not in extractors]

    def rows(viewer: str, data: bytes) -> Iterator[tuple[str | None, str | None]]:
        try:
            yield from ((text, None) for text in extractors.get(viewer, _strings)(data))
        except Exception as e:  # noqa: BLE001  damage of any kind is data here
            yield None, str(e) or type(e).__name__
            yield from ((text, None) for text in _strings(data))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file_id, viewer, data = (batch.column(c)[k].as_py() for c in range(3))
                for part in batched(enumerate(rows(viewer, data or b"")), 4096):
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file_id] * n, pa.int64()), pa.array([viewer] * n), pa.array([i for i, _ in part], pa.int64()), pa.array([r[0] for _, r in part], pa.string()), pa.array([r[1] for _, r in part], pa.string())],
                        ["file_id", "viewer_id", "seq", "text", "error"],
                    )

    routed = with_route(files, [(r.viewer_id, r.extensions, r.sniff, r.matches) for r in readers]).select("file_id", "viewer_id", "content")
    packages, others, path = cut_apart(routed, F.col("viewer_id") == "office")
    is_text = F.col("viewer_id").isin(textual)
    lines = with_text(with_encoding(others.where(is_text))).select("file_id", "viewer_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n", -1)).alias("seq", "text"))
    lines = lines.select("file_id", "viewer_id", F.col("seq").cast("long").alias("seq"), "text", F.lit(None).cast("string").alias("error"))
    office = office_texts(packages)
    bare = cut_lineage(packages.join(office.select("file_id").distinct(), "file_id", "left_anti").select("file_id", "viewer_id", "content"))
    discard(files.sparkSession, path)
    rest = others.where(~is_text).unionByName(bare)
    whole = office.select("file_id", F.lit("office").alias("viewer_id"), "seq", "text", F.lit(None).cast("string").alias("error"))
    return whole.unionByName(lines).unionByName(rest.mapInArrow(run, "file_id long, viewer_id string, seq long, text string, error string"))


def extraction_report(extracted: DataFrame) -> DataFrame:
    """(viewer_id, files, rows, chars, failed): what each branch of ``extract_all`` gave, and how many of its files failed."""
    by_file = extracted.groupBy("viewer_id", "file_id").agg(F.count("text").alias("rows"), F.sum(F.length("text")).alias("chars"), F.max(F.col("error").isNotNull()).alias("failed"))
    return by_file.groupBy("viewer_id").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count_if("failed").alias("failed"))


def nested_archives(files: DataFrame, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Where entries of archives in archives stand, and what they hold: lineage and contents.

    Lineage is (file_id, name, parent, path, depth, error, digest), a row per file and per entry of each archive down to ``max_depth``; an entry's
    id is a hash of its archive's id and its place in it, so two entries of one path are two. Contents are (digest, content), each once. An archive
    that occurs in many places, or on many levels, is unpacked once. Each level is written to the shared folder,
    so a lost executor costs one level.
    """
    blank, head = F.lit(None).cast("string"), F.substring("content", 1, 4096).alias("head")
    digest = F.sha2("content", 256).alias("digest")
    held = [cut_lineage(files.select("file_id", "name", "content", digest))]
    level = held[0].select("file_id", "name", F.lit(None).cast("long").alias("parent"), blank.alias("path"), F.lit(0).alias("depth"), blank.alias("error"), "digest", head)
    lineage, opened = level, None
    for depth in range(1, max_depth + 1):
        archives = with_route(level.where("digest is not null").select("file_id", "name", "digest", F.col("head").alias("content"))).where("viewer_id = 'archive'").select("file_id", "digest")
        archives = cut_lineage(archives)
        wanted = archives.select("digest").distinct()
        fresh = wanted if opened is None else wanted.join(opened.select(F.col("archive").alias("digest")), "digest", "left_anti")
        # the bytes of archives seen for the first time, from wherever they stand
        source = held[0].select("digest", "content")
        for more in held[1:]:
            source = source.unionByName(more.select("digest", "content"))
        bytes_of = source.join(fresh, "digest", "left_semi").dropDuplicates(["digest"])
        entries = explode_archives(bytes_of.select(F.col("digest").alias("file_id"), "content").repartition("file_id"))
        entries = cut_lineage(entries.select(F.col("file_id").alias("archive"), "entry_no", "path", "content", "error", digest))
        held.append(entries)
        places = entries.select("archive", "entry_no", "path", "error", "digest", head)
        opened = places if opened is None else opened.unionByName(places)
        level = archives.select(F.col("file_id").alias("parent"), F.col("digest").alias("archive")).join(opened, "archive")
        level = cut_lineage(level.select(
            F.xxhash64("parent", "entry_no").alias("file_id"), base_name(F.col("path")).alias("name"), "parent", "path", F.lit(depth).alias("depth"), "error", "digest", "head"
        ))
        lineage = lineage.unionByName(level)
        if level.isEmpty():
            break
    contents = held[0].select("digest", "content")
    for more in held[1:]:
        contents = contents.unionByName(more.select("digest", "content"))
    return lineage.drop("head"), contents.where("digest is not null").dropDuplicates(["digest"])


def expand_nested(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """(file_id, name, content, parent, path, depth, error): the files, and the entries of archives in them down to ``max_depth``.

    An archive or entry that can't be read is a row with its error and without content. Lineage and contents as ``nested_archives`` gives them, joined.
    """
    lineage, contents = nested_archives(files, max_depth)
    return lineage.join(contents, "digest", "left").select("file_id", "name", "content", "parent", "path", "depth", "error")
