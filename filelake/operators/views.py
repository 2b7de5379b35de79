"""Tables from bytes and text: lines, hex rows, printable strings, encodings."""

from __future__ import annotations

import codecs
import re

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .charsets import guess_of
from .triage import _starts

#: A printable run: tab, ASCII, and well-formed UTF-8 sequences.
RUN = re.compile(
    rb"(?:[\x09\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: An incomplete UTF-8 sequence at the end of a one-character-per-byte view.
TAIL = (
    r"([\xC2-\xDF]|\xE0[\xA0-\xBF]?|[\xE1-\xEC\xEE\xEF][\x80-\xBF]?|\xED[\x80-\x9F]?|\xF0([\x90-\xBF][\x80-\xBF]?)?"
    r"|[\xF1-\xF3][\x80-\xBF]{0,2}|\xF4([\x80-\x8F][\x80-\xBF]?)?)$"
)


def text_preview(files: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    size = F.octet_length("content")
    return files.select("file_id", F.substring("content", 1, max_bytes).alias("preview"), (size > max_bytes).alias("truncated"))


def split_lines(texts: DataFrame) -> DataFrame:
    """(file_id, line_no from 1, text) at CRLF, CR or LF; a trailing empty line stays."""
    rows = texts.select("file_id", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("p", "text"))
    return rows.select("file_id", (F.col("p") + 1).alias("line_no"), "text")


def clip_lines(lines: DataFrame, n: int = 10_000) -> DataFrame:
    clipped = F.when(F.length("text") > n, F.concat(F.left("text", F.lit(n)), F.lit("…"))).otherwise(F.col("text"))
    return lines.select("file_id", "line_no", clipped.alias("text"))


def line_page(lines: DataFrame, first: int, last: int) -> DataFrame:
    return lines.where(F.col("line_no").between(first, last))


def hex_dump(files: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """(file_id, row_no, offset, hex, ascii): a row per 16 bytes."""
    size = F.octet_length("content")
    end = F.floor((size - 1) / 16) if last is None else F.least(F.floor((size - 1) / 16), F.lit(last))
    rows = files.where(size > first * 16).select("file_id", "content", size.alias("size"), F.explode(F.sequence(F.lit(first).cast("long"), end)).alias("row_no"))
    part = F.col("content").substr((F.col("row_no") * 16 + 1).cast("int"), F.lit(16))
    return hex_columns(rows.select("file_id", "row_no", "size", part.alias("part")))


def hex_columns(rows: DataFrame) -> DataFrame:
    """(file_id, row_no, offset, hex, ascii) of (file_id, row_no, size, part): 16 bytes of a file of that size."""
    width = F.greatest(F.lit(8), F.length(F.lower(F.hex(F.col("size") - 1))))
    spaced = F.trim(F.regexp_replace(F.lower(F.hex("part")), "(..)", "$1 "))
    split = F.when(F.length(spaced) > 24, F.concat(F.left(spaced, F.lit(23)), F.lit("  "), F.substr(spaced, F.lit(25)))).otherwise(spaced)
    ascii_ = F.regexp_replace(F.decode("part", "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    return rows.select(
        "file_id", "row_no", F.lpad(F.lower(F.hex(F.col("row_no") * 16)), width, F.lit("0")).alias("offset"), F.rpad(split, 48, " ").alias("hex"), ascii_.alias("ascii")
    )


def with_encoding(files: DataFrame) -> DataFrame:
    """Files with ``encoding``, ``bom``, ``guessed`` and ``confidence``; columns of these names are replaced.

    A byte order mark counts, else UTF-8 (its last character may be cut), else the code page whose pair model makes text of the
    bytes; what none makes text of is called UTF-8 with ``guessed`` false and confidence 0. Only bytes that are neither go to the models. Null
    content is UTF-8 without confidence.
    """
    c = F.col("content")
    view = F.decode(c, "ISO-8859-1")
    cut = F.encode(F.regexp_replace(view, TAIL, ""), "ISO-8859-1")
    bom = F.when(_starts(c, "EFBBBF"), "utf-8").when(_starts(c, "FFFE"), "utf-16le").when(_starts(c, "FEFF"), "utf-16be")
    marked = files.withColumns({"__bom": bom, "__valid": F.coalesce(F.is_valid_utf8(c.cast("string")) | F.is_valid_utf8(cut.cast("string")), F.lit(False))})
    found = marked.withColumn("__page", guess_of(c, F.col("__bom").isNull() & ~F.col("__valid")))
    by_page = F.col("__page.label").isNotNull() & F.col("__bom").isNull() & ~F.col("__valid")
    return found.withColumns(
        {
            "encoding": F.coalesce("__bom", F.when(by_page, F.col("__page.label")), F.lit("utf-8")), "bom": F.col("__bom").isNotNull(), "guessed": F.col("__bom").isNull() & (F.col("__valid") | by_page),
            "confidence": F.when(F.col("__bom").isNotNull() | F.col("__valid"), F.lit(1.0)).otherwise(F.coalesce("__page.confidence", F.lit(0.0))),
        }
    ).drop("__bom", "__valid", "__page")


def detect_encoding(files: DataFrame) -> DataFrame:
    """(file_id, encoding, bom, guessed, confidence), as ``with_encoding`` finds them."""
    return with_encoding(files.select("file_id", "content")).select("file_id", "encoding", "bom", "guessed", "confidence")


def _runs(data: bytes, min_length: int, max_run: int):
    """(offset, text) of printable runs; a piece ends with the character that brings it to ``max_run`` bytes."""
    for m in RUN.finditer(data):
        at, stop = m.start(), m.end()
        while at < stop:
            end = min(at + max_run, stop)
            while end < stop and data[end] & 0xC0 == 0x80:
                end += 1
            text = data[at:end].decode()
            if len(text) >= min_length:
                yield at, text.removeprefix("﻿")
            at = end


def extract_strings(files: DataFrame, min_length: int = 4, max_run: int = 4096) -> DataFrame:
    """(file_id, offset, text) of printable strings in any bytes: Arrow batches, map-only."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file_id, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                found = [*_runs(data, min_length, max_run)]
                if found:
                    offsets, text = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([file_id] * len(found), pa.int64()), pa.array(offsets, pa.int64()), pa.array(text, pa.string())], ["file_id", "offset", "text"])

    return files.select("file_id", "content").mapInArrow(run, "file_id long, offset long, text string")


def cap_strings(strings: DataFrame, max_n: int = 200_000, max_chars: int = 16_000_000) -> DataFrame:
    """The longest prefix of a file's strings within both caps."""
    w = Window.partitionBy("file_id").orderBy("offset")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = strings.withColumns({"n": F.row_number().over(w), "chars": F.sum(F.length("text")).over(running)})
    return kept.where((F.col("n") <= max_n) & (F.col("chars") <= max_chars)).select("file_id", "offset", "text")


def strings_summary(strings: DataFrame, max_n: int = 200_000, max_chars: int = 16_000_000) -> DataFrame:
    found = strings.groupBy("file_id").agg(F.count("*").alias("found"), F.sum(F.length("text")).alias("chars"))
    return found.select("file_id", "found", ((F.col("found") > max_n) | (F.col("chars") > max_chars)).alias("truncated"))


#: Labels that a user can choose from (fixed values), and the codec of each label besides UTF-8.
ENCODINGS = ["utf-8", "windows-1251", "ibm866", "koi8-r", "shift_jis"]
CODECS = {
    "windows-1251": "cp1251", "ibm866": "cp866", "koi8-r": "koi8_r", "shift_jis": "cp932", "windows-1252": "cp1252", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be",
}


def encoding_options(detected: DataFrame) -> DataFrame:
    """(file_id, ord, label): the supported labels, and the detected one where it is none of them. Within each row, no shuffle."""
    labels = F.array_distinct(F.concat(F.array(*map(F.lit, ENCODINGS)), F.array("encoding")))
    return detected.select("file_id", F.posexplode(labels).alias("ord", "label"))


def with_text(files: DataFrame) -> DataFrame:
    """Files with ``text``, their content decoded by ``encoding``: malformed bytes become U+FFFD, a byte order mark goes.

    UTF-8 and unknown labels stay in the JVM; other code pages go through an Arrow helper, which
    gets no other bytes. Where a column ``truncated`` is true, an end that cuts a character is dropped.
    """
    label, content = F.lower("encoding"), F.col("content")
    truncated = F.coalesce("truncated", F.lit(False)) if "truncated" in files.columns else F.lit(False)
    other = label.isin(list(CODECS))

    @F.pandas_udf("string")
    def coded(data: pd.Series, labels: pd.Series, cut: pd.Series) -> pd.Series:
        # bytes that a single-byte code page leaves open are control characters
        codecs.register_error("control", lambda e: ("".join(map(chr, e.object[e.start : e.end])), e.end))

        def one(b, name, truncated):
            if b is None:
                return None
            errors = "control" if name.startswith("windows") else "replace"
            text = codecs.getincrementaldecoder(CODECS[name])(errors).decode(b, not truncated)
            return text.removeprefix("\ufeff") if name.startswith("utf") else text

        return pd.Series([one(*x) for x in zip(data, labels, cut, strict=True)], dtype=object)

    view = F.decode(content, "ISO-8859-1")
    whole = F.when(truncated, F.encode(F.regexp_replace(view, TAIL, ""), "ISO-8859-1")).otherwise(content)
    utf8 = F.regexp_replace(F.make_valid_utf8(whole.cast("string")), "^\ufeff", "")
    helped = coded(F.when(other, content), label, truncated)
    return files.withColumn("text", F.when(other, helped).otherwise(utf8))


def decode_files(files: DataFrame) -> DataFrame:
    """(file_id, text) of (file_id, encoding, truncated, content), as ``with_text`` decodes them."""
    return with_text(files).select("file_id", "text")


def clean_paragraphs(texts: DataFrame, word: bool = True) -> DataFrame:
    """(file_id, para_no, text): split at CR and FF, controls dropped, trimmed, blank ones left out; ``word`` makes cell marks and line breaks blanks."""
    text = F.regexp_replace("text", r"[\x07\x0B]", " ") if word else F.col("text")
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    parts = F.filter(F.transform(F.split(text, r"[\r\x0C]+"), clean), lambda x: x != "")
    return texts.select("file_id", F.posexplode(parts).alias("para_no", "text"))
