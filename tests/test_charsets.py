"""The code-page models on texts of the test tables, and decoding by what they find."""

import pyarrow.parquet as pq
import pytest

from filelake.operators import charsets, readers
from filelake.operators import views as V
from filelake.plans import catalogue
from filelake.plans.fixtures import frame


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.text, r.coded) for r in frame(spark, sf_dir, "fx_coded").collect()]


@pytest.mark.parametrize("label", ["windows-1251", "ibm866", "koi8-r", "shift_jis", "windows-1252"])
def test_pages_are_found(texts, label):
    samples = [t.encode(V.CODECS[label]) for t, page in texts if page == label]
    samples = [b for b in samples if len(b) >= 200]
    right = sum(charsets.guess(b)[0] == label for b in samples)
    assert len(samples) >= 5 and right >= 0.95 * len(samples)


def test_cut_and_long_samples(texts):
    kana = next(t for t, page in texts if page == "shift_jis" and len(t) > 300)
    assert charsets.guess(kana.encode("cp932")[:301])[0] == charsets.guess((kana * 400).encode("cp932"))[0] == "shift_jis"


def test_bytes_that_are_no_text(sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    for head in ("D0CF11E0A1B11AE1", "89504E470D0A1A0A", "FFD8FF"):
        for t in docs:
            assert charsets.guess(bytes.fromhex(head) + (t or "").encode()) == (None, 0.0)
    assert charsets.guess(bytes(range(256)) * 40)[0] is None and charsets.guess(b"") == (None, 0.0)


def test_labels_of_hard_rows(spark):
    rows = [(1, None), (2, b""), (3, "é".encode()[:1]), (4, b"\xff\xfea\x00"), (5, "Привет, как дела? ".encode("cp1251") * 9), (6, b"\xef\xbb\xbf"), (7, bytes(range(128, 256)) * 3)]
    files = spark.createDataFrame([(i, b and bytearray(b) if b is not None else None, "x") for i, b in rows], "file_id long, content binary, encoding string")
    got = {r.file_id: (r.encoding, r.bom, r.guessed, r.confidence > 0.9) for r in V.detect_encoding(files).collect()}
    assert got == {
        1: ("utf-8", False, False, False), 2: ("utf-8", False, True, True), 3: ("utf-8", False, True, True), 4: ("utf-16le", True, False, True), 5: ("windows-1251", False, True, True),
        6: ("utf-8", True, False, True), 7: ("utf-8", False, False, False),
    }


def test_extraction_goes_by_encoding(spark):
    rows = [(1, "a.txt", b"\xff\xfe" + "один\nдва".encode("utf-16-le")), (2, "b.md", ("Привет, как дела сегодня?\r\n" * 5).encode("koi8_r")), (3, "c.txt", b"\xef\xbb\xbfplain\rtext"), (4, "d.txt", None)]
    files = spark.createDataFrame(rows, "file_id long, name string, content binary")
    got = {}
    for r in sorted(readers.extract_all(files).collect()):
        got.setdefault(r.file_id, []).append(r.text)
    assert got[1] == ["один", "два"] and got[2] == ["Привет, как дела сегодня?"] * 5 + [""] and got[3] == ["plain", "text"] and 4 not in got  # null content routes to strings, and has none


def test_small_fixture_is_all_there(spark, sf_dir):
    assert catalogue.coded(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_text_behind_heads_is_no_page():
    # capitals and blanks with accents, which windows-1252 makes text of
    text = "ACCIÓN!! CIÓNAÑO!! QUE!! ESCIÓN!! LA!! ÑCO,!! ÍDOCIÓN!! ".encode()
    for head in ("D0CF11E0A1B11AE1", "89504E470D0A1A0A", "FFD8FF"):
        for times in (1, 3, 40, 2000):
            assert charsets.guess(bytes.fromhex(head) + text * times) == (None, 0.0)
    # the same text in its page stays that, and Cyrillic that is UTF-8 in part does
    assert charsets.guess(text.decode().encode("cp1252") * 3)[0] == "windows-1252"
    assert charsets.guess(("Итив " * 25).encode("cp866"))[0] == "ibm866"


def test_options_of_text_behind_heads(spark):
    text = "ACCIÓN!! CIÓNAÑO!! QUE!! ESCIÓN!! LA!! ÑCO,!! ÍDOCIÓN!! ".encode() * 20
    files = spark.createDataFrame([(1, bytearray(b"\x89PNG\r\n\x1a\n" + text))], "file_id long, content binary")
    assert [(r.ord, r.label) for r in V.encoding_options(V.detect_encoding(files)).orderBy("ord").collect()] == list(enumerate(V.ENCODINGS))


def test_single_accented_words_are_western():
    assert charsets.guess(("il mare è blu, la casa è rossa " * 9).encode("cp1252"))[0] == "windows-1252"
    assert charsets.guess(("и в с о к " * 30).encode("cp1251"))[0] == "windows-1251"


def test_page_is_looked_for_behind_long_ascii(spark):
    late = b"a plain line of text\n" * 4000 + ("il mare è blu, perché no, città " * 9).encode("cp1252")
    files = spark.createDataFrame([(1, bytearray(late))], "file_id long, content binary")
    assert [(r.encoding, r.guessed) for r in V.detect_encoding(files).collect()] == [("windows-1252", True)]
