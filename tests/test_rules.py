"""Edge cases of the rules, on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from filelake.functions import scalars as S
from filelake.operators import archives as A
from filelake.operators import records as R
from filelake.operators import triage as T
from filelake.operators import views as V


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_file_extension(spark):
    names = ["a.TXT", ".env", "a.", "a.b.c", "noext", "..a"]
    assert values(spark, [(n,) for n in names], "n string", S.file_extension(F.col("n"))) == ["txt", "", "", "c", "", "a"]


def test_cell_refs(spark):
    got = values(spark, [("A1",), ("xfd1048576",), ("A0",), ("1A",), (" B2 ",)], "r string", S.parse_cell_ref(F.col("r")))
    assert [tuple(x) if x else None for x in got] == [(0, 0), (1048575, 16383), None, None, (1, 1)]


def test_formats(spark):
    rows = [(14, None), (22, None), (9, None), (49, None), (164, '"d"0'), (164, "[h]:mm"), (164, "0%"), (164, "General")]
    assert values(spark, rows, "i int, c string", S.num_fmt_kind(F.col("i"), F.col("c"))) == ["date", "date", "percent", "general", "general", "date", "percent", "general"]


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1152, 1048576, 2**50]
    assert values(spark, [(s,) for s in sizes], "s long", S.format_bytes(F.col("s"))) == ["0 B", "1023 B", "1.00 KiB", "1.13 KiB", "1.00 MiB", "1024.00 TiB"]


def test_part_paths(spark):
    rows = [("ppt/slides/_rels/s.rels", "../m/i.png"), ("ppt/p.xml", "a/./b.xml"), ("x", "/x/y"), ("x", "http://h/x")]
    assert values(spark, rows, "o string, t string", S.resolve_part_path(F.col("o"), F.col("t"))) == ["ppt/m/i.png", "ppt/a/b.xml", "x/y", "http://h/x"]


def test_field_codes(spark):
    rows = [("a\x13code\x14kept\x15b",), ("a\x15b",), ("plain",)]
    assert values(spark, rows, "t string", S.strip_field_codes(F.col("t"))) == ["akeptb", "ab", "plain"]


def test_counters(spark):
    rows = [(4, "decimal"), (28, "lowerLetter"), (1994, "upperRoman")]
    assert values(spark, rows, "n int, f string", S.format_counter(F.col("n"), F.col("f"))) == ["4.", "ab.", "MCMXCIV."]


@pytest.mark.parametrize(
    ("data", "text"), [(b"", True), (b"abc\x00", False), (b"a" * 99 + b"\x01", True), (b"a" * 98 + b"\x01\x02", False), (b"\xff\xfea\x00", True)]
)
def test_text_test(spark, data, text):
    assert values(spark, [(bytearray(data),)], "h binary", T.is_probably_text(F.col("h"))) == [text]


def test_strings():
    runs = lambda b: [*V._runs(b, 4, 4096)]
    assert runs(b"abc\x00abcd\t") == [(4, "abcd\t")]
    assert runs(b"\xc0\x80abcd\xed\xa0\x80") == [(2, "abcd")]
    assert [len(t) for _, t in runs(b"a" * 4096)] == [4096]
    assert [len(t) for _, t in runs(b"a" * 4099)] == [4096]
    assert runs("﻿abcd".encode()) == [(0, "abcd")]


def test_list_numbering_restarts(spark):
    paras = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1), (1, 3, 0, 1), (1, 4, 0, 0), (1, 5, 0, 1), (1, 6, 7, 0)], "file_id long, seq long, num_id long, ilvl long")
    levels = spark.createDataFrame([(0, 0, "decimal"), (0, 1, "lowerLetter")], "num_id long, ilvl long, fmt string")
    got = R.list_numbering(paras, levels).orderBy("seq").collect()
    assert [r.prefix for r in got] == ["1.", "a.", "b.", "2.", "a.", "•"]


def test_corrupt_archive_is_a_row(spark):
    got = A.explode_archives(spark.createDataFrame([(1, bytearray(b"PK\x03\x04 no"))], "file_id long, content binary")).collect()
    assert len(got) == 1 and got[0].path is None and got[0].error


def test_md_fixture_is_whole(spark, sf_dir):
    from filelake.plans.fixtures import frame

    assert frame(spark, sf_dir, "fx_md").count() == frame(spark, sf_dir, "fx_lines").count()


def test_md_fences_over_blocks(spark):
    import random
    import re

    from filelake.operators.markdown import md_blocks

    rnd, rows, want = random.Random(9), [], {}
    for file_id in range(4):
        state = ""
        for line_no in range(1, 5001):
            text = rnd.choice(["```", "~~~", " ```py", "~~~ x", "```", None]) if rnd.random() < 0.004 else "word"
            rows.append((file_id, line_no, text))
            opens, closes = re.search(r"^\s*(```|~~~)(.*)$", text or ""), re.search(r"^\s*(```|~~~)\s*$", text or "")
            if state and closes and closes[1] == state:
                state, want[file_id, line_no] = "", "fence_close"
            elif state:
                want[file_id, line_no] = "code"
            elif opens:
                state, want[file_id, line_no] = opens[1], "fence_open"
            else:
                want[file_id, line_no] = "text"
    rnd.shuffle(rows)
    got = md_blocks(spark.createDataFrame(rows, "file_id long, line_no long, text string")).collect()
    assert len(got) == len(rows) and {(r.file_id, r.line_no): r["class"] for r in got} == want


def test_relationships_hold_within_a_part(spark):
    refs = spark.createDataFrame([(1, "a.xml", 0, "rId1")], "file_id long, part string, seq long, rel_id string")
    rels = spark.createDataFrame([(1, "a.xml", "rId1", "x", False), (1, "b.xml", "rId1", "y", False), (1, "a.xml", "rId2", "z", True)], "file_id long, part string, rel_id string, target string, external boolean")
    assert [tuple(r) for r in R.resolve_rels(refs, rels).collect()] == [(1, "a.xml", 0, "rId1", "x")]


def test_list_definitions_of_each_file(spark):
    paragraphs = spark.createDataFrame([(1, 1, 7, 0), (1, 2, 7, 11), (1, 3, 7, 0), (1, 4, 7, 11), (2, 1, 7, 0), (2, 2, 8, 0)], "file_id long, seq long, num_id long, ilvl long")
    levels = spark.createDataFrame([(1, 7, 0, "decimal"), (1, 7, 11, "lowerRoman"), (2, 7, 0, "bullet")], "file_id long, num_id long, ilvl long, fmt string")
    got = {(r.file_id, r.seq): r.prefix for r in R.list_numbering(paragraphs, levels).collect()}
    assert got == {(1, 1): "1.", (1, 2): "i.", (1, 3): "2.", (1, 4): "i.", (2, 1): "•", (2, 2): "•"}


def test_grid_leaves_out_row_minus_one(spark):
    cells = spark.createDataFrame([(1, 0, -1, 0, "lost"), (2, 0, -1, 0, "lost"), (2, 0, 1, 1, "x")], "file_id long, sheet_no long, row long, col long, value string")
    assert sorted((r.file_id, r.row, r.cells) for r in R.sheet_grid(cells).collect()) == [(2, 0, ["", ""]), (2, 1, ["", "x"])]


def test_implied_rows(spark):
    # row elements: 5; no number; without cells of its own row; no number after a cell of row 20; 3
    rows = [(0, 0, 4, None, 0), (1, 0, 4, None, None), (2, 1, None, None, 0), (3, 2, None, 20, 0), (4, 3, None, None, None), (5, 4, 2, None, 0)]
    cells = spark.createDataFrame([(1, 0, *r) for r in rows], "file_id long, sheet_no long, pos long, row_pos long, row_no long, ref_row long, ref_col long")
    assert [(r.row, r.col) for r in R.implied_positions(cells).orderBy("pos").collect()] == [(4, 0), (4, 1), (5, 0), (20, 0), (21, 1), (2, 0)]


def test_encrypted_names_stand_at_whole_bytes(spark):
    ole, names = bytes.fromhex("D0CF11E0A1B11AE1"), ["EncryptedPackage".encode("utf-16-le"), "EncryptionInfo".encode("utf-16-le")]
    shifted = bytes.fromhex(f"0{names[0].hex()}0")
    rows = [(1, ole + names[0] + b"x" + names[1]), (2, ole + shifted + names[1]), (3, names[0] + names[1]), (4, None)]
    assert [r.file_id for r in T.encrypted_packages(spark.createDataFrame(rows, "file_id long, content binary")).collect()] == [1]


def test_long_letters(spark):
    assert values(spark, [(0,), (701,), (702,), (18277,), (18278,), (475254,)], "n long", S.col_letters(F.col("n"))) == ["A", "ZZ", "AAA", "ZZZ", "AAAA", "AAAAA"]


def test_markdown_classes(spark):
    from filelake.operators import markdown as M

    kinds = [
        ("# A", "atx"), ("####### b", "text"), ("#c", "text"), ("# #", "atx"), ("  - x", "list"), ("12) y", "list"), ("1234567890. y", "text"), ("*no", "text"), ("* * *", "rule"), ("*_*", "rule"), ("-*-", "text"),
        ("> q", "quote"), ("title", "text"), ("===", "setext"), ("", "blank"), ("---", "rule"), ("| a | b |", "text"), ("|:-|-:|", "table_sep"), ("|::|-|", "text"), ("\t~~~ x", "fence_open"), ("# in", "code"), ("```", "code"), ("~~~", "fence_close"), ("-", "text"),
    ]
    blocks = M.md_blocks(spark.createDataFrame([(1, k, t) for k, (t, _) in enumerate(kinds, 1)], "file_id long, line_no long, text string"))
    assert [r["class"] for r in blocks.orderBy("line_no").collect()] == [k for _, k in kinds]
    assert [(r.level, r.text) for r in M.md_outline(blocks).orderBy("line_no").collect()] == [(1, "A"), (1, "#"), (1, "title")]


def test_corrupt_archives_stay_as_rows(spark):
    import io
    import zipfile

    from filelake.operators import readers

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("bad.zip", b"PK\x03\x04broken")
        z.writestr("a.txt", b"x")
    found = readers.expand_nested(spark.createDataFrame([(1, "f.zip", buffer.getvalue())], "file_id long, name string, content binary")).collect()
    assert sorted((r.depth, r.path or "", r.error is not None) for r in found) == [(0, "", False), (1, "a.txt", False), (1, "bad.zip", False), (2, "", True)]


def test_office_texts_are_extracted(spark):
    from filelake.operators import readers
    from filelake.plans.documents import _parts, _zip

    rows = [(1, "p.docx", _zip(_parts([3], ["a <b>"]))), (2, "q.docx", b"PK\x03\x04 broken package"), (3, "n.txt", b"one\ntwo")]
    found = readers.extract_all(spark.createDataFrame(rows, "file_id long, name string, content binary")).collect()
    texts = lambda k: [r.text for r in sorted(found, key=lambda r: r.seq) if r.file_id == k]
    assert texts(1) == ["1. a <b>    L3", "cell", "a <b>\n3", "H3", "a <b>  x", "item", "a <b>\t300%\ti3"]
    assert texts(2)[0] is None and "broken package" in " ".join(texts(2)[1:]) and texts(3) == ["one", "two"]


def test_extraction_drops_packages_and_entries(spark, tmp_path, monkeypatch):
    import uuid

    from filelake.operators import readers
    from filelake.plans.documents import _parts, _zip
    from filelake.sources import files

    for module in (files, readers):
        monkeypatch.setattr(module, "shared_path", lambda spark: f"file://{tmp_path}/{uuid.uuid4().hex}", raising=False)
    rows = [(1, "p.docx", _zip(_parts([3], ["a <b>"]))), (2, "q.docx", b"PK\x03\x04 broken package"), (3, "n.txt", b"one\ntwo")]
    extracted = readers.extract_all(spark.createDataFrame(rows, "file_id long, name string, content binary"))
    kept = [spark.read.parquet(f"file://{x}") for x in tmp_path.iterdir() if any(x.rglob("*.parquet"))]
    assert not [x for x in kept if "path" in x.columns]
    assert sorted(bytes(r.content) for x in kept if "content" in x.columns for r in x.collect()) == [b"PK\x03\x04 broken package", b"one\ntwo"]
    assert {r.file_id for r in extracted.collect()} == {1, 2, 3}
    # no package at all
    assert [r.text for r in readers.extract_all(spark.createDataFrame(rows[2:], "file_id long, name string, content binary")).orderBy("seq").collect()] == ["one", "two"]
