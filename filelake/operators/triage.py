"""What a file really is: signatures, text test, and routing to a viewer without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import file_extension

HEAD = 4096
#: Viewers in order and the extensions each lists (fixed values).
VIEWERS = [
    ("doc", "html htm svg md markdown"),
    ("office", "docx xlsx pptx doc xls ppt ods odt odp"),
    ("archive", "zip"),
    ("pdf", "pdf"),
    ("media", "png jpg jpeg webp gif ico mp4 webm mp3 wav ogg"),
    ("code", "txt log json jsonc yml yaml toml ini cfg conf env js mjs cjs jsx ts tsx py sql sh bash bat ps1 c h cpp hpp cs java kt go rs rb php swift lua r css scss xml csv tsv tex diff patch"),
]
LEGACY = ["doc", "xls", "ppt"]


def viewers(spark: SparkSession) -> DataFrame:
    """The registry as a table: ord, viewer_id, extensions."""
    return spark.createDataFrame([(k, v, e.split()) for k, (v, e) in enumerate(VIEWERS)], "ord int, viewer_id string, extensions array<string>")


def file_heads(files: DataFrame, n: int = HEAD) -> DataFrame:
    """Extension and the first bytes; the content goes no further."""
    return files.select("file_id", file_extension(F.col("name")).alias("extension"), F.substring("content", 1, n).alias("head"))


def _starts(head: Column, hexes: str) -> Column:
    return F.substring(head, 1, len(hexes) // 2) == F.unhex(F.lit(hexes))


def _at(head: Column, at: int, hexes: str) -> Column:
    return F.substring(head, at + 1, len(hexes) // 2) == F.unhex(F.lit(hexes))


def is_zip(head: Column) -> Column:
    return _starts(head, "504B0304")


def is_ole(head: Column) -> Column:
    return _starts(head, "D0CF11E0A1B11AE1")


def is_pdf(head: Column) -> Column:
    return _starts(head, "25504446")


def _byte(head: Column, at: int) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(head, at, 1)), 16, 10).try_cast("int"), F.lit(-1))


def is_mpeg_audio(head: Column) -> Column:
    """An MPEG frame header: sync bits set, version not reserved, layer not reserved."""
    b = _byte(head, 2)
    return (_byte(head, 1) == 255) & (b >= 224) & (F.floor(b / 8) % 4 != 1) & (F.floor(b / 2) % 4 != 0)


#: Media signatures in order: kind, format, parts (offset, bytes) (fixed values).
MEDIA = [
    ("image", "png", [(0, "89504E470D0A1A0A")]), ("image", "jpeg", [(0, "FFD8FF")]), ("image", "gif", [(0, "474946383761")]), ("image", "gif", [(0, "474946383961")]),
    ("image", "webp", [(0, "52494646"), (8, "57454250")]), ("image", "ico", [(0, "00000100")]), ("audio", "wav", [(0, "52494646"), (8, "57415645")]),
    ("video", "mp4", [(4, "66747970")]), ("video", "webm", [(0, "1A45DFA3")]), ("audio", "ogg", [(0, "4F676753")]), ("audio", "mp3", [(0, "494433")]),
]


def media(head: Column) -> Column:
    """Struct (kind, format) of the first signature that fits, or null."""
    out = None
    for kind, fmt, parts in MEDIA:
        test = F.lit(True)
        for at, h in parts:
            test = test & _at(head, at, h)
        value = F.struct(F.lit(kind).alias("kind"), F.lit(fmt).alias("format"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.when(is_mpeg_audio(head), F.struct(F.lit("audio").alias("kind"), F.lit("mp3").alias("format")))


def has_text_bom(head: Column) -> Column:
    return _starts(head, "EFBBBF") | _starts(head, "FFFE") | _starts(head, "FEFF")


def has_nul(head: Column) -> Column:
    return F.decode(head, "ISO-8859-1").contains("\x00")


def stray_bytes(head: Column) -> Column:
    """Control bytes that text doesn't hold."""
    view = F.decode(head, "ISO-8859-1")
    return F.length(view) - F.length(F.regexp_replace(view, r"[\x00-\x07\x0B\x0E-\x1A\x1C-\x1F\x7F]", ""))


def is_probably_text(head: Column) -> Column:
    return (F.octet_length(head) == 0) | has_text_bom(head) | (~has_nul(head) & (stray_bytes(head) / F.octet_length(head) <= 0.01))


def sniffed(files: DataFrame) -> DataFrame:
    """file_id, extension and every test of the head as a column, each computed once."""
    heads = file_heads(files)
    h = F.col("head")
    return heads.select(
        "file_id", "extension", is_zip(h).alias("is_zip"), is_ole(h).alias("is_ole"), is_pdf(h).alias("is_pdf"), media(h).alias("media"), F.coalesce(is_probably_text(h), F.lit(False)).alias("is_text")
    )


def _signature(viewer: str) -> Column:
    zip_, ole = F.col("is_zip"), F.col("is_ole")
    return {"doc": F.col("is_text"), "office": zip_ | ole, "archive": zip_, "pdf": F.col("is_pdf"), "media": F.col("media").isNotNull(), "code": F.col("is_text")}[viewer]


def _matches(viewer: str) -> Column:
    ext, lists = F.col("extension"), dict(VIEWERS)
    office = lists["office"].split()
    return {
        "doc": ext.isin(lists["doc"].split()) & F.col("is_text"),
        "office": (ext.isin([e for e in office if e not in LEGACY]) & (F.col("is_zip") | F.col("is_ole"))) | (ext.isin(LEGACY) & F.col("is_ole")),
        "archive": (ext == "zip") & F.col("is_zip"),
        "pdf": (ext == "pdf") & F.col("is_pdf"),
        "media": F.col("media").isNotNull(),
        "code": F.col("is_text"),
    }[viewer]


def candidates_by_extension(files: DataFrame) -> DataFrame:
    """Viewers that list the extension: an equi-join with the (fixed, small) registry."""
    listed = viewers(files.sparkSession).select("ord", "viewer_id", F.explode("extensions").alias("extension"))
    heads = files.select("file_id", file_extension(F.col("name")).alias("extension"))
    return heads.join(F.broadcast(listed), "extension").select("file_id", "viewer_id", F.lit(0).alias("source"), "ord")


def candidates_by_signature(files: DataFrame) -> DataFrame:
    """Viewers whose signature test holds and that don't list the extension: an array per row, no shuffle."""
    tests = []
    for k, (v, e) in enumerate(VIEWERS):
        tests.append(F.when(_signature(v) & ~F.col("extension").isin(e.split()), F.struct(F.lit(v).alias("viewer_id"), F.lit(k).alias("ord"))))
    found = sniffed(files).select("file_id", F.explode(F.array_compact(F.array(*tests))).alias("c"))
    return found.select("file_id", "c.viewer_id", F.lit(1).alias("source"), "c.ord")


def candidate_union(files: DataFrame) -> DataFrame:
    """Extension candidates, then signature candidates, in order and without repeats."""
    return candidates_by_extension(files).unionByName(candidates_by_signature(files))


def with_route(files: DataFrame, more=()) -> DataFrame:
    """``files`` with extension, viewer_id and source: extension candidates first, then signatures, then the fallback.

    The choice is one CASE over the registry, so nothing is shuffled and streams can use it.
    ``more`` are added viewers (id, extensions, sniff, matches), in order after the fixed ones;
    their tests are columns over ``extension`` and ``head``.
    """
    known = [(v, e.split(), lambda v=v: _signature(v), lambda v=v: _matches(v)) for v, e in VIEWERS]
    choice = None
    for source in (0, 1):
        for v, e, sniff, matches in [*known, *more]:
            listed = F.col("extension").isin(list(e))
            test = matches() & (listed if source == 0 else ~listed & sniff())
            value = F.struct(F.lit(v).alias("viewer_id"), F.lit(source).alias("source"))
            choice = F.when(test, value) if choice is None else choice.when(test, value)
    choice = choice.otherwise(F.struct(F.lit("fallback").alias("viewer_id"), F.lit(2).alias("source")))
    h = F.col("head")
    tests = {"is_zip": is_zip(h), "is_ole": is_ole(h), "is_pdf": is_pdf(h), "media": media(h), "is_text": F.coalesce(is_probably_text(h), F.lit(False))}
    sniffed_ = files.withColumns({"extension": file_extension(F.col("name")), "head": F.substring("content", 1, HEAD)}).withColumns(tests)
    chosen = sniffed_.withColumn("c", choice).withColumns({"viewer_id": F.col("c.viewer_id"), "source": F.col("c.source")})
    return chosen.drop("head", "c", *tests)


def route_files(files: DataFrame) -> DataFrame:
    """(file_id, extension, viewer_id, source); the content goes no further."""
    return with_route(files).select("file_id", "extension", "viewer_id", "source")


def mislabelled_files(files: DataFrame) -> DataFrame:
    """Files routed to another viewer than the first one that lists their extension."""
    expected = None
    for v, e in VIEWERS:
        test = F.col("extension").isin(e.split())
        expected = F.when(test, v) if expected is None else expected.when(test, v)
    routed = route_files(files).withColumn("expected_viewer", expected)
    return routed.where("expected_viewer <> viewer_id").select("file_id", "extension", "expected_viewer", "viewer_id")


def route_report(files: DataFrame) -> DataFrame:
    """Files and bytes per viewer and extension, with totals."""
    routed = with_route(files).withColumn("bytes", F.octet_length("content").cast("long"))
    return routed.rollup("viewer_id", "extension").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def encrypted_packages(files: DataFrame) -> DataFrame:
    """OLE files whose bytes hold both stream names of an encrypted package (UTF-16LE)."""
    hold = lambda name: F.contains(F.col("content"), F.unhex(F.lit(name.encode("utf-16-le").hex())))
    return files.where(is_ole(F.col("content")) & hold("EncryptedPackage") & hold("EncryptionInfo")).select("file_id")


#: MIME types by extension of package images and of files inside archives (fixed values).
IMAGE_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml"}
NESTED_MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "pdf": "application/pdf", "mp4": "video/mp4", "mp3": "audio/mpeg",
}
#: Families and kinds of document extensions (fixed values).
SUB_FORMATS = {
    "html": ("doc", "html"), "htm": ("doc", "html"), "svg": ("doc", "svg"), "md": ("doc", "markdown"), "markdown": ("doc", "markdown"),
    **{e: ("office", e) for e in ("docx", "xlsx", "pptx")}, **{e: ("legacy", e) for e in LEGACY}, **{e: ("odf", e) for e in ("ods", "odt", "odp")},
}


def _by_extension(path: Column, kinds: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)))


def sniff_image_mime(content: Column) -> Column:
    """The MIME type of an image by its first bytes; SVG only where the first 1,024 bytes are plain; else null."""
    view = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    view = F.when(_starts(content, "EFBBBF"), F.substr(view, F.lit(4))).otherwise(view)
    svg = view.rlike(r"\A[\x00-\x7E]*\z") & (view.rlike(r"\A\s*<svg") | (view.rlike(r"\A\s*<\?xml") & view.contains("<svg")))
    return (
        F.when(_starts(content, "89504E47"), "image/png")
        .when(_starts(content, "FFD8FF"), "image/jpeg")
        .when(_starts(content, "474946383761") | _starts(content, "474946383961"), "image/gif")
        .when(_starts(content, "52494646") & _at(content, 8, "57454250"), "image/webp")
        .when(_starts(content, "424D"), "image/bmp")
        .when(_starts(content, "00000100"), "image/x-icon")
        .when(svg, "image/svg+xml")
    )


def image_mime(content: Column, path: Column) -> Column:
    """The MIME type by bytes, else by extension, else null."""
    return F.coalesce(sniff_image_mime(content), _by_extension(path, IMAGE_MIME))


def nested_mime(path: Column) -> Column:
    """The MIME type of an archive entry by its extension, empty where unknown."""
    return F.coalesce(_by_extension(path, NESTED_MIME), F.lit(""))


def sub_format(files: DataFrame) -> DataFrame:
    """(file_id, extension, family, kind) by extension, null where it is no document's; a map lookup, no join."""
    ext = file_extension(F.col("name"))
    known = F.create_map(*[x for e, (f, k) in SUB_FORMATS.items() for x in (F.lit(e), F.struct(F.lit(f).alias("family"), F.lit(k).alias("kind")))])
    found = files.select("file_id", ext.alias("extension")).withColumn("f", F.try_element_at(known, F.col("extension")))
    return found.select("file_id", "extension", "f.family", "f.kind")
