"""List definitions and ODF sheets from their packages."""

import random

from filelake.operators import packages as P
from filelake.operators import readers
from filelake.operators import records as R
from filelake.plans.documents import _zip


def test_numbering_part(spark):
    xml = """<numbering><abstractNum abstractNumId="1"><lvl ilvl="0"><numFmt val="bullet"/></lvl><lvl ilvl="x"/></abstractNum><abstractNum abstractNumId="2"><lvl ilvl="0"/><lvl><numFmt val="lowerRoman"/></lvl></abstractNum>
     <num numId="4"><abstractNumId val="2"/></num><num numId="5"><abstractNumId val="9"/></num><num numId="4"><abstractNumId val="1"/></num><num><abstractNumId val="2"/></num></numbering>"""
    entries = spark.createDataFrame([(1, "word/numbering.xml", bytearray(xml.encode())), (2, "word/numbering.xml", bytearray(b"<broken"))], "file_id long, path string, content binary")
    # the last list of an id counts; a missing number is 0, and the last level of a number counts
    assert sorted(tuple(r) for r in P.parse_numbering(entries).collect()) == [(1, 0, 0, "lowerRoman"), (1, 4, 0, "bullet")]


def test_numbering_equals_counters_with_restarts(spark):
    rnd, paragraphs, want = random.Random(3), [], {}
    levels = [(f, n, d, rnd.choice(["decimal", "bullet", "decimal"])) for f in range(3) for n in range(3) for d in (0, 1, 2, 5)]
    formats = {(f, n, d): form for f, n, d, form in levels}
    for f in range(3):
        counters = {}
        for seq in range(200):
            n, d = rnd.randrange(4), rnd.choice([0, 1, 2, 3, 5])
            paragraphs.append((f, seq, n, d))
            if formats.get((f, n, d), "bullet") == "bullet":
                want[f, seq] = "•"
                continue
            own = counters.setdefault(n, {})
            own[d] = own.get(d, 0) + 1
            for deeper in [x for x in own if x > d]:
                del own[deeper]
            want[f, seq] = f"{own[d]}."
    rnd.shuffle(paragraphs)
    frame = spark.createDataFrame(paragraphs, "file_id long, seq long, num_id long, ilvl long")
    got = R.list_numbering(frame, spark.createDataFrame(levels, "file_id long, num_id long, ilvl long, fmt string")).collect()
    assert {(r.file_id, r.seq): r.prefix for r in got} == want


def test_no_definitions_are_bullets(spark):
    paragraphs = spark.createDataFrame([(1, 0, 7, 0)], "file_id long, seq long, num_id long, ilvl long")
    assert [r.prefix for r in R.list_numbering(paragraphs, spark.createDataFrame([], "file_id long, num_id long, ilvl long, fmt string")).collect()] == ["•"]


def test_sheet_runs(spark):
    xml = """<d><body><spreadsheet><table name="T"><table-row number-rows-repeated="2"><covered-table-cell/><table-cell number-columns-repeated="3"><p>a</p><p>b</p></table-cell><table-cell boolean-value="true"/></table-row>
      <table-row number-rows-repeated="0"/><table-row><table-cell number-columns-repeated="1000" value="7"/><table-cell/></table-row></table><table/></spreadsheet></body></d>"""
    entries = spark.createDataFrame([(1, "content.xml", bytearray(xml.encode()))], "file_id long, path string, content binary")
    grid = sorted((r.sheet_no, r.row, r.cells, r.truncated) for r in P.ods_grids(entries).collect())
    assert grid == [(0, 0, ["a\nb", "", "", "true", ""], False), (0, 1, ["a\nb", "", "", "true", ""], False), (0, 2, [""] * 5, False), (0, 3, ["7", "", "", "", ""], False)]


def test_repeats_are_copied_up_to_the_cap(spark):
    xml = "<d><body><spreadsheet><table>" + "<table-row number-rows-repeated='9999'><table-cell value='1'/></table-row>" * 3 + "</table></spreadsheet></body></d>"
    entries = spark.createDataFrame([(1, "content.xml", bytearray(xml.encode()))], "file_id long, path string, content binary")
    raw = P.parse_ods(entries)
    assert raw.count() == 6 and R.ods_cells(raw, 2000, 50).count() == 2000
    assert [(r.total_rows, r.total_cols) for r in R.ods_extent(raw).collect()] == [(29997, 1)]


def test_texts_of_lists_and_sheets(spark):
    word = '<w:document xmlns:w="w"><w:body>' + "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{d}"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for d, t in ((0, "x"), (1, "y"), (0, "z"))) + "</w:body></w:document>"
    lists = '<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="upperRoman"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    sheet = "<d><body><spreadsheet><table><table-row><table-cell value='1'/><table-cell><p>b</p></table-cell></table-row></table></spreadsheet></body></d>"
    rows = [(1, "a.docx", _zip([("word/document.xml", word), ("word/numbering.xml", lists)])), (2, "b.ods", _zip([("content.xml", sheet)]))]
    got = sorted((r.file_id, r.seq, r.text) for r in readers.extract_all(spark.createDataFrame(rows, "file_id long, name string, content binary")).collect())
    assert got == [(1, 0, "I. x"), (1, 1, "• y"), (1, 2, "II. z"), (2, 0, "1\tb")]
