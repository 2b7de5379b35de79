"""Streams equal batches; decoding, readers and broken parts."""

import random

from pyspark.sql import functions as F

from filelake.operators import packages as P
from filelake.operators import readers
from filelake.operators import views as V
from filelake.plans import catalogue
from filelake.streaming import streams


def test_strings_stream_is_batch(spark, sf_dir):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(catalogue.QUERIES["strings_stream"](spark, sf_dir)) == rows(catalogue.QUERIES["extract_strings"](spark, sf_dir))


def test_settled_prefix_at_any_cut():
    rnd = random.Random(3)
    for _ in range(200):
        data = b"".join(rnd.choice([b"abc", "é".encode(), "漢".encode(), "😀".encode(), b"\x00", b"\xff", b"\xe2\x82", b"\n"]) for _ in range(60))
        found, carry, start = [], b"", 0
        cuts = sorted({0, len(data), *(rnd.randrange(len(data)) for _ in range(6))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            buffer, start = carry + data[a:b], a - len(carry)
            ready = streams._settled(buffer, 16) if b < len(data) else len(buffer)
            found += [(start + o, t) for o, t in V._runs(buffer[:ready], 4, 16)]
            carry = buffer[ready:]
        assert found == [*V._runs(data, 4, 16)]


def test_code_pages(spark):
    rows = [(1, "windows-1251", False, "Привет".encode("cp1251") + b"\x98"), (2, "ibm866", False, "Привет".encode("cp866")), (3, "koi8-r", False, "Привет".encode("koi8_r")), (4, "shift_jis", True, "日本".encode("cp932")[:-1]),
            (5, "utf-8", True, "aé".encode()[:-1]), (6, "nope", False, b"a\xff"), (7, "utf-8", None, None)]
    df = spark.createDataFrame([(i, e, t, c and bytearray(c)) for i, e, t, c in rows], "file_id long, encoding string, truncated boolean, content binary")
    got = dict(map(tuple, V.decode_files(df).collect()))
    assert got == {1: "Привет\x98", 2: "Привет", 3: "Привет", 4: "日", 5: "a", 6: "a�", 7: None}


def test_broken_part_gives_no_rows(spark):
    entries = spark.createDataFrame([(1, "word/document.xml", bytearray(b"<w:p")), (2, "content.xml", None)], "file_id long, path string, content binary")
    assert P.docx_paragraphs(entries).count() == P.odf_text(entries).count() == 0


def test_added_reader_and_failure(spark):
    files = spark.createDataFrame([(1, "a.abc", bytearray(b"\x00\x01xx,yyyy")), (2, "b.zip", bytearray(b"PK\x03\x04\x00\x00name"))], "file_id long, name string, content binary")
    more = readers.register_reader((), "abc", ["abc"], lambda: F.lit(False), lambda: F.col("extension") == "abc", lambda b: [b[2:4].decode()])
    got = sorted((r.file_id, r.seq, r.viewer_id, r.text or "", bool(r.error)) for r in readers.extract_all(files, more).collect())
    assert got == [(1, 0, "abc", "xx", False), (2, 0, "archive", "", True), (2, 1, "archive", "name", False)]
