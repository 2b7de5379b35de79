"""Parts of office packages as tables: relationships, workbooks, sheets, paragraphs, slides, ODF text, images.

Parts come one per row from ``explode_archives``, so parsing spreads over the cluster; a part is
one row in memory. Parts that are not well-formed give no rows: ``unreadable_files`` finds them.
Elements match by local name.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SYMBOLS, is_safe_href, parse_cell_ref, resolve_part_path
from .records import implied_positions, last_cell_wins, list_numbering, ods_cells, ods_extent, resolve_cells, sheet_grid, slide_order
from .triage import image_mime

#: The namespace of relationship ids; hard blanks for a tab of a text and of an ODF text; repeats of blanks and of table rows in texts count below these.
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
NBSP = " "
TEXT_TAB, ODF_TAB, BLANKS, ROWS = 4, 3, 100, 1000
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _kids(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e if _name(c) in names]


def _kid(e: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(_kids(e, name)), None)


def _attr(e: ET.Element | None, name: str) -> str | None:
    """An attribute by local name, whatever its namespace."""
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _whole(text: str | None, default: int | None) -> int | None:
    """A whole number; ``default`` where the text is missing, null where it is something else."""
    if text is None or not text.strip():
        return default
    try:
        return int(value) if (value := float(text)) == int(value) else None
    except (ValueError, OverflowError):
        return None


def _walked(parts: DataFrame, walk: Callable[[ET.Element], Iterator[tuple]], fields: dict[str, str]) -> DataFrame:
    """(file_id, path, fields...) of every row that ``walk`` makes of a part; one Arrow batch a part."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    rows = [*walk(ET.fromstring(batch.column(2)[k].as_py() or b""))]
                except (ET.ParseError, ValueError, LookupError):
                    continue
                if rows:
                    same = [pa.array([batch.column(c)[k].as_py()] * len(rows), t) for c, t in ((0, pa.int64()), (1, pa.string()))]
                    own = [pa.array(x, KINDS[t]) for x, t in zip(zip(*rows, strict=True), fields.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays(same + own, ["file_id", "path", *fields])

    schema = ", ".join(f"`{n}` {t}" for n, t in ({"file_id": "long", "path": "string"} | fields).items())
    return parts.select("file_id", "path", "content").mapInArrow(run, schema)


def parse_rels(entries: DataFrame) -> DataFrame:
    """(file_id, part, rel_id, target, type, external) of every .rels part; of equal ids in a part the last counts."""
    shape = "Relationship array<struct<_Id string, _Target string, _Type string, _TargetMode string>>"
    xml = F.from_xml(F.col("content").cast("string"), shape, {"ignoreNamespace": "true"})
    rows = entries.where("endswith(path, '.rels')").select("file_id", F.col("path").alias("part"), F.posexplode(xml["Relationship"]).alias("pos", "r"))
    rows = rows.where("r._Id is not null and r._Target is not null").groupBy("file_id", "part", F.col("r._Id").alias("rel_id")).agg(F.max_by("r", "pos").alias("r"))
    external = F.lower(F.coalesce("r._TargetMode", F.lit(""))) == "external"
    return rows.select("file_id", "part", "rel_id", F.col("r._Target").alias("target"), F.coalesce("r._Type", F.lit("")).alias("type"), external.alias("external"))


def parse_workbook(entries: DataFrame) -> DataFrame:
    """(file_id, kind, idx, name, value): kinds sheet (name, rel id), shared (text), xf (format id), fmt (idx is the id, code)."""

    def text(e: ET.Element) -> str:
        # level by level, as deep as text elements stand
        found, level = [], [e]
        while level:
            found += ["".join(x.itertext()) for x in level if _name(x) == "t"]
            level = [c for x in level if _name(x) != "t" for c in x]
        return "".join(found)

    def walk(root: ET.Element) -> Iterator[tuple]:
        if _name(root) == "workbook":
            for k, s in enumerate(_kids(_kid(root, "sheets"), "sheet")):
                yield "sheet", k, _attr(s, "name"), s.get(REL + "id")
        elif _name(root) == "sst":
            for k, s in enumerate(_kids(root, "si")):
                yield "shared", k, None, text(s)
        elif _name(root) == "styleSheet":
            for k, x in enumerate(_kids(_kid(root, "cellXfs"), "xf")):
                yield "xf", k, None, str(_whole(x.get("numFmtId"), 0) or 0)
            for f in _kids(_kid(root, "numFmts"), "numFmt"):
                if (k := _whole(f.get("numFmtId"), 0)) is not None and f.get("formatCode") is not None:
                    yield "fmt", k, None, f.get("formatCode")

    parts = entries.where(F.col("path").isin("xl/workbook.xml", "xl/sharedStrings.xml", "xl/styles.xml"))
    return _walked(parts, walk, {"kind": "string", "idx": "long", "name": "string", "value": "string"}).drop("path")


def parse_sheet(entries: DataFrame) -> DataFrame:
    """(file_id, path, row_pos, row_no, pos, ref, type, style, raw) of every cell of the sheets, ``pos`` in document order.

    ``row_pos`` counts row elements, ``row_no`` is an element's number from 0 (-1 where it has none, null where it
    is no number), ``ref`` the cell's own reference, for ``parse_cell_ref`` and ``implied_positions``.
    """

    def walk(root: ET.Element) -> Iterator[tuple]:
        data, pos = _kid(root, "sheetData"), 0
        for at, row in enumerate(_kids(root if data is None else data, "row")):
            number = _whole(row.get("r"), 0)
            for c in _kids(row, "c"):
                inline, value = _kid(c, "is"), _kid(c, "v")
                raw = "".join("".join(t.itertext()) for t in inline.iter() if _name(t) == "t") if inline is not None else "".join(value.itertext()) if value is not None else ""
                yield at, None if number is None else number - 1, pos, c.get("r"), c.get("t") or "", _whole(c.get("s"), 0), raw
                pos += 1

    fields = {"row_pos": "long", "row_no": "long", "pos": "long", "ref": "string", "type": "string", "style": "long", "raw": "string"}
    return _walked(entries.where("path like 'xl/worksheets/%.xml'"), walk, fields)


def workbook_grids(entries: DataFrame, max_rows: int = 2000, max_cols: int = 50) -> DataFrame:
    """Dense rows of display strings of every sheet of a workbook: ``sheet_grid`` of what the parts hold.

    Sheets are numbered as the workbook lists them; one whose relationship is missing or external is left out.
    """
    owner = "xl/_rels/workbook.xml.rels"
    book, rels = parse_workbook(entries), parse_rels(entries.where(F.col("path") == owner)).where("not external")
    of = lambda kind, *columns: book.where(F.col("kind") == kind).select("file_id", *columns)
    sheets = of("sheet", F.col("idx").alias("sheet_no"), F.col("value").alias("rel_id")).join(rels, ["file_id", "rel_id"])
    sheets = sheets.select("file_id", "sheet_no", resolve_part_path(F.lit(owner), F.col("target")).alias("path"))
    cells = parse_sheet(entries).join(sheets, ["file_id", "path"]).withColumn("at", parse_cell_ref(F.col("ref")))
    cells = cells.withColumns({"ref_row": F.col("at.row"), "ref_col": F.col("at.col")})
    places = implied_positions(cells).withColumnsRenamed({"row": "ref_row", "col": "ref_col"})
    placed = cells.drop("ref_row", "ref_col").join(places, ["file_id", "sheet_no", "pos"])
    formats = of("xf", F.col("idx").alias("xf_idx"), F.col("value").cast("long").alias("num_fmt_id"))
    codes = of("fmt", F.col("idx").alias("num_fmt_id"), F.col("value").alias("code"))
    values = resolve_cells(placed, of("shared", "idx", F.col("value").alias("text")), formats, codes)
    return sheet_grid(last_cell_wins(values), max_rows, max_cols)


def _run_text(run: ET.Element) -> str:
    """Text of a word run; field codes and drawings have none."""
    out = []
    for c in run:
        match _name(c):
            case "t":
                out.append("".join(c.itertext()))
            case "tab":
                out.append(NBSP * TEXT_TAB)
            case "br":
                out.append("\n")
            case "sym":
                out.append(SYMBOLS.get((_attr(c, "char") or "").upper(), "•"))
            case "noBreakHyphen":
                out.append("‑")
    return "".join(out)


def _word_paragraphs(root: ET.Element) -> Iterator[tuple[str, ET.Element]]:
    """Paragraphs of a document's body and of its tables' cells, in order."""
    body = _kid(root, "body")
    for block in [] if body is None else body:
        if _name(block) == "p":
            yield "body", block
        elif _name(block) == "tbl":
            for tr in _kids(block, "tr"):
                for tc in _kids(tr, "tc"):
                    for p in _kids(tc, "p"):
                        yield "cell", p


def docx_paragraphs(entries: DataFrame) -> DataFrame:
    """(file_id, seq, place, style, num_id, ilvl, text) of word/document.xml; ``place`` is body or cell, ``num_id`` null outside lists."""

    def walk(root: ET.Element) -> Iterator[tuple]:
        for seq, (place, p) in enumerate(_word_paragraphs(root)):
            props = _kid(p, "pPr")
            listed = _kid(props, "numPr")
            num = None if listed is None else _whole(_attr(_kid(listed, "numId"), "val"), 0)
            level = None if num is None else _whole(_attr(_kid(listed, "ilvl"), "val"), 0) or 0
            runs = [r for c in p for r in ([c] if _name(c) == "r" else _kids(c, "r") if _name(c) in ("hyperlink", "fldSimple") else [])]
            yield seq, place, (_attr(_kid(props, "pStyle"), "val") or "").lower(), num, level, "".join(map(_run_text, runs))

    fields = {"seq": "long", "place": "string", "style": "string", "num_id": "long", "ilvl": "long", "text": "string"}
    return _walked(entries.where("path = 'word/document.xml'"), walk, fields).drop("path")


def parse_numbering(entries: DataFrame) -> DataFrame:
    """(file_id, num_id, ilvl, fmt) of word/numbering.xml: the levels of the abstract list that each list names; of equal ids the last counts."""

    def walk(root: ET.Element) -> Iterator[tuple]:
        abstract: dict[int, dict[int, str]] = {}
        for a in _kids(root, "abstractNum"):
            if (number := _whole(_attr(a, "abstractNumId"), 0)) is not None:
                levels = abstract[number] = {}
                for level in _kids(a, "lvl"):
                    form = _kid(level, "numFmt")
                    if (depth := _whole(_attr(level, "ilvl"), 0)) is not None:
                        levels[depth] = _attr(level if form is None else form, "val") or "decimal"
        lists = {}
        for n in _kids(root, "num"):
            of = _kid(n, "abstractNumId")
            if (number := _whole(_attr(n, "numId"), 0)) is not None:
                lists[number] = abstract.get(_whole(_attr(n if of is None else of, "val"), 0), {})
        yield from ((number, depth, form) for number, levels in lists.items() for depth, form in levels.items())

    return _walked(entries.where("path = 'word/numbering.xml'"), walk, {"num_id": "long", "ilvl": "long", "fmt": "string"}).drop("path")


def docx_numbered(entries: DataFrame) -> DataFrame:
    """``docx_paragraphs`` with ``prefix``, the counter or bullet of list paragraphs (null outside lists), by the package's own definitions."""
    paragraphs = docx_paragraphs(entries)
    listed = paragraphs.where("num_id is not null").select("file_id", "seq", "num_id", "ilvl")
    return paragraphs.join(list_numbering(listed, parse_numbering(entries)), ["file_id", "seq"], "left").select(*paragraphs.columns, "prefix")


def docx_links(entries: DataFrame) -> DataFrame:
    """(file_id, seq, kind, label, url, safe) of hyperlinks whose relationship has a safe target."""

    def walk(root: ET.Element) -> Iterator[tuple]:
        links = (c for _, p in _word_paragraphs(root) for c in _kids(p, "hyperlink"))
        for seq, link in enumerate(links):
            if link.get(REL + "id"):
                yield seq, link.get(REL + "id"), "".join(map(_run_text, _kids(link, "r")))

    found = _walked(entries.where("path = 'word/document.xml'"), walk, {"seq": "long", "rel_id": "string", "label": "string"})
    rels = parse_rels(entries.where("path = 'word/_rels/document.xml.rels'")).select("file_id", "rel_id", F.col("target").alias("url"))
    safe = is_safe_href(F.col("url")) & ~F.col("url").startswith("#")
    return found.join(rels, ["file_id", "rel_id"]).where(safe).select("file_id", "seq", F.lit("link").alias("kind"), "label", "url", F.lit(True).alias("safe"))


def _drawn(p: ET.Element) -> str:
    """Text of a drawing paragraph: runs, cached fields, breaks."""
    out = []
    for c in p:
        match _name(c):
            case "r":
                out += ["\n" if _name(x) == "br" else "".join(x.itertext()) for x in _kids(c, "t", "br")]
            case "fld":
                out += ["".join(t.itertext()) for t in _kids(c, "t")]
            case "br":
                out.append("\n")
    return "".join(out)


def _shapes(tree: ET.Element) -> Iterator[str]:
    """Paragraphs below a shape tree: shapes, connectors, groups, the chosen alternative, tables, diagrams."""
    for e in tree:
        match _name(e):
            case "sp" | "cxnSp":
                yield from map(_drawn, _kids(_kid(e, "txBody"), "p"))
            case "grpSp":
                yield from _shapes(e)
            case "AlternateContent":
                branch = _kid(e, "Choice")
                branch = _kid(e, "Fallback") if branch is None else branch
                yield from _shapes(branch) if branch is not None else ()
            case "tbl":
                yield from _table(e)
            case "graphicFrame":
                table = next((t for t in e.iter() if _name(t) == "tbl"), None)
                if table is not None:
                    yield from _table(table)
                else:
                    yield from (s for t in e.iter() if _name(t) == "t" and (s := "".join(t.itertext())))


def _table(table: ET.Element) -> Iterator[str]:
    for tr in _kids(table, "tr"):
        for tc in _kids(tr, "tc"):
            yield from map(_drawn, _kids(_kid(tc, "txBody"), "p"))


def slide_text(entries: DataFrame) -> DataFrame:
    """(file_id, slide_no, seq, text): paragraphs of the slides, numbered in the order of the presentation."""

    def order(root: ET.Element) -> Iterator[tuple]:
        for seq, s in enumerate(_kids(_kid(root, "sldIdLst"), "sldId")):
            yield seq, s.get(REL + "id")

    def walk(root: ET.Element) -> Iterator[tuple]:
        tree = _kid(_kid(root, "cSld"), "spTree")
        if _name(root) == "sld" and tree is not None:
            yield from enumerate(_shapes(tree))

    owner = "ppt/_rels/presentation.xml.rels"
    refs = _walked(entries.where("path = 'ppt/presentation.xml'"), order, {"seq": "long", "rel_id": "string"}).withColumn("part", F.lit(owner))
    slides = slide_order(refs, parse_rels(entries.where(F.col("path") == owner)))
    slides = slides.select("file_id", "slide_no", resolve_part_path(F.lit(owner), F.col("target")).alias("path"))
    text = _walked(entries.where("path like 'ppt/%.xml' and path <> 'ppt/presentation.xml'"), walk, {"seq": "long", "text": "string"})
    return slides.join(text, ["file_id", "path"]).select("file_id", "slide_no", "seq", "text")


def _inline(e: ET.Element) -> str:
    """Text of an ODF paragraph with its breaks, tabs and runs of blanks."""
    out = [e.text or ""]
    for c in e:
        match _name(c):
            case "line-break":
                out.append("\n")
            case "tab":
                out.append(NBSP * ODF_TAB)
            case "s":
                n = _whole(_attr(c, "c"), 1)
                out.append(NBSP * (n if n and 0 < n < BLANKS else 1))
            case _:
                out.append(_inline(c))
        out.append(c.tail or "")
    return "".join(out)


def _flow(parent: ET.Element, kind: str, deep: bool = False) -> Iterator[tuple]:
    """(kind, level, text) of paragraphs, headings, lists and tables; ``deep`` looks into any other element too."""
    for e in parent:
        match _name(e):
            case "p":
                yield kind, None, _inline(e)
            case "h":
                level = _whole(_attr(e, "outline-level"), 1)
                yield ("h", level, _inline(e)) if level is not None and 1 <= level <= 6 else (kind, None, _inline(e))
            case "list":
                for item in _kids(e, "list-item"):
                    yield from _flow(item, "list")
            case "table" if not deep and kind == "p":
                for row in _kids(e, "table-row"):
                    n = _whole(_attr(row, "number-rows-repeated"), 1)
                    cells = [*_row(row)]
                    for _ in range(n if n and 0 < n < ROWS else 1):
                        yield from cells
            case _ if deep:
                yield from _flow(e, kind, True)


def _row(row: ET.Element) -> Iterator[tuple]:
    for cell in _kids(row, "table-cell"):
        paragraphs = _kids(cell, "p")
        if paragraphs:
            yield from (("cell", None, _inline(p)) for p in paragraphs)
        else:
            yield "cell", None, _attr(cell, "value") or _attr(cell, "date-value") or _attr(cell, "boolean-value") or NBSP


def odf_text(entries: DataFrame) -> DataFrame:
    """(file_id, seq, kind, level, text) of content.xml; kinds p, h, list, cell, and box for text boxes of slides."""

    def walk(root: ET.Element) -> Iterator[tuple]:
        body = _kid(root, "body")
        text, slides = _kid(body, "text"), _kid(body, "presentation")
        rows = [] if text is None else _flow(text, "p")
        if slides is not None:
            rows = (r for page in _kids(slides, "page") for box in page.iter() if _name(box) == "text-box" for r in _flow(box, "box", True))
        for seq, (kind, level, content) in enumerate(rows):
            yield seq, kind, level, content

    fields = {"seq": "long", "kind": "string", "level": "int", "text": "string"}
    return _walked(entries.where("path = 'content.xml'"), walk, fields).drop("path")


def parse_ods(entries: DataFrame) -> DataFrame:
    """(file_id, sheet_no, name, row_no, row_repeat, seq, span, covered, text) of the sheets of content.xml, as runs: repeats are numbers here.

    Each row begins with an entry of ``seq`` -1 that stands for the row. A cell's text is its paragraphs', else its value.
    """

    def walk(root: ET.Element) -> Iterator[tuple]:
        for number, table in enumerate(_kids(_kid(_kid(root, "body"), "spreadsheet"), "table")):
            for at, row in enumerate(_kids(table, "table-row")):
                same = number, _attr(table, "name"), at, _whole(_attr(row, "number-rows-repeated"), 1)
                yield *same, -1, 0, True, None
                for seq, cell in enumerate(_kids(row, "table-cell", "covered-table-cell")):
                    covered = _name(cell) == "covered-table-cell"
                    text = "\n".join(map(_inline, _kids(cell, "p"))) or _attr(cell, "value") or _attr(cell, "date-value") or _attr(cell, "boolean-value") or ""
                    yield *same, seq, 1 if covered else _whole(_attr(cell, "number-columns-repeated"), 1), covered, None if covered else text

    fields = {"sheet_no": "long", "name": "string", "row_no": "long", "row_repeat": "long", "seq": "long", "span": "long", "covered": "boolean", "text": "string"}
    return _walked(entries.where("path = 'content.xml'"), walk, fields).drop("path")


def ods_grids(entries: DataFrame, max_rows: int = 2000, max_cols: int = 50) -> DataFrame:
    """Dense rows of every sheet of an ODF spreadsheet, as ``sheet_grid`` gives them; repeats are copied up to the cap only."""
    raw = parse_ods(entries)
    return sheet_grid(ods_cells(raw, max_rows, max_cols), max_rows, max_cols, ods_extent(raw))


def embedded_images(entries: DataFrame) -> DataFrame:
    """(file_id, path, mime) of package images that a part refers to; what can't be shown is dropped."""
    rels = parse_rels(entries).where("not external")
    named = rels.select("file_id", resolve_part_path(F.col("part"), F.col("target")).alias("path")).distinct()
    images = entries.select("file_id", "path", image_mime(F.col("content"), F.col("path")).alias("mime")).where("mime is not null")
    return images.join(named, ["file_id", "path"], "left_semi")


def unreadable_files(routed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_id) of files routed to the office viewer of which no block can be read."""
    return routed.where("viewer_id = 'office'").join(blocks, "file_id", "left_anti").select("file_id")
