"""Ordered records: as-of sections, continuations, pieces, list numbering, spreadsheet cells, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import excel_serial_to_date, format_bytes, format_counter, format_percent, num_fmt_kind
from .scans import BLOCK, last_before, numbered


def resolve_rels(refs: DataFrame, rels: DataFrame) -> DataFrame:
    """References to parts of the package; external and missing targets drop. Ids hold within the part that refers."""
    inside = rels.where("not external").select("file_id", "part", "rel_id", "target")
    return refs.join(inside, ["file_id", "part", "rel_id"]).select("file_id", "part", "seq", "rel_id", "target")


def slide_order(refs: DataFrame, rels: DataFrame) -> DataFrame:
    """Slides numbered from 1 in the order of the presentation part's references to them, unresolved ones left out."""
    w = Window.partitionBy("file_id").orderBy("seq")
    return resolve_rels(refs, rels).select("file_id", F.row_number().over(w).alias("slide_no"), "target")


def shared_string_lookup(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """Cells of type s get the shared string of their index; the raw text stays where there is none. Only they join."""
    index = F.when(F.trim("raw") == "", F.lit(0).cast("long")).otherwise(F.col("raw").try_cast("long"))
    texts = shared.select("file_id", F.col("idx").alias("__idx"), F.col("text").alias("__text"))
    wanted = cells.where("type = 's'").withColumn("__idx", index).join(texts, ["file_id", "__idx"], "left")
    return wanted.select(*cells.columns, F.coalesce("__text", "raw").alias("value")).unionByName(
        cells.where("type is null or type <> 's'").withColumn("value", F.col("raw"))
    )


def style_lookup(cells: DataFrame, xf: DataFrame, fmts: DataFrame) -> DataFrame:
    """Style index (missing is 0) to number format id and custom code; out of range is plain."""
    with_id = cells.withColumn("xf_idx", F.coalesce("style", F.lit(0))).join(xf, ["file_id", "xf_idx"], "left")
    return with_id.join(fmts, ["file_id", "num_fmt_id"], "left").select(*cells.columns, F.coalesce("num_fmt_id", F.lit(0)).alias("num_fmt_id"), "code")


def resolve_cells(cells: DataFrame, shared: DataFrame, xf: DataFrame, fmts: DataFrame) -> DataFrame:
    """Display strings: shared and literal text, TRUE and FALSE, and numbers by their format (dates as ISO)."""
    styled = style_lookup(shared_string_lookup(cells, shared), xf, fmts)
    kind = num_fmt_kind(F.col("num_fmt_id"), F.col("code"))
    when = excel_serial_to_date(F.col("raw").try_cast("double"))
    date = F.when(F.date_trunc("day", when) == when, F.date_format(when, "yyyy-MM-dd")).otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
    number = F.when(kind == "date", F.coalesce(date, F.col("raw"))).when(kind == "percent", format_percent(F.col("raw"))).otherwise(F.col("raw"))
    text = (
        F.when(F.col("type").isin("s", "inlineStr"), F.col("value"))
        .when(F.col("type") == "b", F.when(F.col("raw") == "1", "TRUE").otherwise("FALSE"))
        .when(F.col("type").isin("e", "str"), F.col("raw"))
        .otherwise(number)
    )
    return styled.select("file_id", "sheet_no", "pos", F.col("ref_row").alias("row"), F.col("ref_col").alias("col"), text.alias("value"))


def implied_positions(cells: DataFrame, width: int = BLOCK) -> DataFrame:
    """Positions of cells in document order: (file_id, sheet_no, pos, row, col).

    A cell without a column stands right of the cell before it, across rows too. One without a row
    stands in its row element ``row_pos``, of number ``row_no``; cells come without these two
    columns where each has a row of its own. A sheet's cells spread over blocks of ``width`` positions.
    """
    keys = ["file_id", "sheet_no"]
    counted = numbered(cells, keys, "pos", width)
    seen = last_before(counted, keys, "pos", F.when(F.col("ref_col").isNotNull(), F.struct("ref_col", "n")), width).withColumnRenamed("last", "seen")
    col = F.coalesce(F.col("seen.ref_col") + F.col("n") - F.col("seen.n"), F.col("n") - 1).alias("col")
    if "row_pos" in cells.columns:
        seen = seen.join(implied_rows(cells), ["file_id", "sheet_no", "row_pos"]).withColumn("ref_row", F.coalesce("ref_row", "row"))
    return seen.select("file_id", "sheet_no", "pos", F.col("ref_row").alias("row"), col)


def implied_rows(cells: DataFrame) -> DataFrame:
    """(file_id, sheet_no, row_pos, row): numbers of row elements; one whose number is no number follows the greatest row of a cell so far.

    With b(e) such elements up to e that hold a cell of their own row, the greatest row less b(e)
    only grows where a given number does, so it is a running maximum.
    """
    own = F.col("ref_row").isNull()
    rows = cells.groupBy("file_id", "sheet_no", "row_pos").agg(F.max("row_no").alias("row_no"), F.max("ref_row").alias("given"), F.max(own).alias("own"))
    w = Window.partitionBy("file_id", "sheet_no").orderBy("row_pos")
    bare = F.count(F.when(F.col("row_no").isNull() & F.col("own"), 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("bare", bare).withColumn("over", F.greatest("given", F.when(F.col("own"), F.col("row_no"))) - F.col("bare"))
    before = F.greatest(F.max("over").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return rows.withColumn("before", before).select("file_id", "sheet_no", "row_pos", F.coalesce("row_no", F.col("bare") + F.col("before")).alias("row"))


def last_cell_wins(cells: DataFrame) -> DataFrame:
    return cells.groupBy("file_id", "sheet_no", "row", "col").agg(F.max_by("value", "pos").alias("value"))


def sheet_extent(cells: DataFrame) -> DataFrame:
    return cells.groupBy("file_id", "sheet_no").agg((F.max("row") + 1).alias("total_rows"), (F.max("col") + 1).alias("total_cols"))


def sheet_grid(cells: DataFrame, max_rows: int = 2000, max_cols: int = 50, extent: DataFrame | None = None) -> DataFrame:
    """Dense rows of display strings, gaps empty; cells beyond the cap, or above row 0, are dropped before they are grouped. The extent is that of the cells if none is given."""
    cells = cells.where("row >= 0 and col >= 0")
    extent = (sheet_extent(cells) if extent is None else extent).where("total_rows > 0 and total_cols > 0")
    rows, cols = F.least("total_rows", F.lit(max_rows)), F.least("total_cols", F.lit(max_cols))
    frame = extent.select(
        "file_id", "sheet_no", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("row"), cols.alias("n"),
        ((F.col("total_rows") > max_rows) | (F.col("total_cols") > max_cols)).alias("truncated"),
    )
    shown = cells.where((F.col("row") < max_rows) & (F.col("col") < max_cols)).groupBy("file_id", "sheet_no", "row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("long"), "value"))).alias("m")
    )
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return frame.join(shown, ["file_id", "sheet_no", "row"], "left").select("file_id", "sheet_no", "row", cell.alias("cells"), "truncated")


def _ods_runs(raw: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Row runs (keys, row_no, first_row, row_repeat) and cells with their column and the width of what stands left of them."""
    keys = ["file_id", *(["sheet_no"] if "sheet_no" in raw.columns else [])]
    valid = lambda c, top: F.when(F.col(c).between(1, top), F.col(c)).otherwise(1)
    before = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = raw.select(*keys, "row_no", valid("row_repeat", 9999).alias("row_repeat")).distinct()
    rows = rows.withColumn("first_row", F.coalesce(F.sum("row_repeat").over(before), F.lit(0)))
    left = Window.partitionBy(*keys, "row_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    width = F.when(F.col("seq") < 0, 0).when(F.col("covered"), 0).otherwise(valid("span", 999))
    cells = raw.withColumn("width", width).withColumn("col", F.coalesce(F.sum("width").over(left), F.lit(0)))
    return rows, cells, keys


def ods_cells(raw: DataFrame, max_rows: int | None = None, max_cols: int | None = None) -> DataFrame:
    """Repeated rows are copied, repeated columns advance; of a repeat only the first cell has the text, covered cells take no column.

    With ``max_rows`` and ``max_cols`` copies beyond them are never made. ``sheet_no``, where the input has it, parts sheets; a row with ``seq`` -1 is no cell, it stands for its row.
    """
    rows, cells, keys = _ods_runs(raw)
    last = F.col("first_row") + F.col("row_repeat") - 1
    if max_rows is not None:
        rows, last = rows.where(F.col("first_row") < max_rows), F.least(last, F.lit(max_rows - 1))
    cells = cells.where("not covered and seq >= 0")
    if max_cols is not None:
        cells = cells.where(F.col("col") < max_cols)
    both = cells.drop("row_repeat").join(rows, [*keys, "row_no"])
    return both.select(*keys, F.explode(F.sequence(F.col("first_row"), last)).alias("row"), "col", F.col("text").alias("value"))


def ods_extent(raw: DataFrame) -> DataFrame:
    """(file_id, sheet_no, total_rows, total_cols): all copies of rows, and the widest row with its covered cells."""
    rows, cells, keys = _ods_runs(raw)
    height = rows.groupBy(*keys).agg(F.sum("row_repeat").cast("long").alias("total_rows"))
    width = F.sum("width") + F.count_if(F.col("covered") & (F.col("seq") >= 0))
    widest = cells.groupBy(*keys, "row_no").agg(width.alias("n")).groupBy(*keys).agg(F.max("n").cast("long").alias("total_cols"))
    return height.join(widest, keys)


def assign_sections(records: DataFrame, sections: DataFrame, width: int = BLOCK) -> DataFrame:
    """As-of: the section with the greatest start at or before a record; no range join, and a file's records spread over blocks of ``width`` offsets."""
    both = sections.select("file_id", F.col("start").alias("offset"), F.col("name"), F.lit(0).alias("side")).unionByName(
        records.select("file_id", "offset", F.lit(None).cast("string").alias("name"), F.lit(1).alias("side"))
    )
    placed = last_before(both, ["file_id"], "offset", F.col("name"), width, ("side",))
    return placed.where("side = 1 and last is not null").select("file_id", "offset", F.col("last").alias("section"))


def merge_continued(records: DataFrame, continues: int = 60, width: int = BLOCK) -> DataFrame:
    """A continuing record's data is appended to the record before it; without one it stays as an error row (rec_id null).

    The record that a row belongs to is found in blocks of ``width`` offsets; only a record and its own continuations meet in one row.
    """
    first = F.when(F.coalesce(F.col("rec_id") != continues, F.lit(False)), F.struct("offset", "rec_id"))
    owned = last_before(records.select("file_id", "offset", "rec_id", "h"), ["file_id"], "offset", first, width)
    merged = owned.groupBy("file_id", F.col("last.offset").alias("start"), F.col("last.rec_id").alias("rec_id")).agg(
        F.min("offset").alias("offset"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "h"))), lambda x: x["h"]), "").alias("h")
    )
    return merged.select("file_id", "offset", "rec_id", "h")


def assemble_pieces(pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """Texts put together from positioned pieces, each clipped at the next one's start and at the total."""
    w = Window.partitionBy("file_id").orderBy("piece_no")
    both = pieces.withColumn("next", F.lead("cp_start").over(w)).join(totals, "file_id")
    stop = F.least(F.coalesce("next", "total"), F.col("total"))
    part = F.substr("text", F.lit(1), F.greatest(stop - F.col("cp_start"), F.lit(0)).cast("int"))
    return both.select("file_id", "piece_no", part.alias("part")).groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "part"))), lambda x: x["part"]), "").alias("text")
    )


def list_numbering(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """Prefix of each list paragraph: a shallower ordered item restarts deeper counters; bullets and unknown lists count nothing.

    ``levels`` are each file's own definitions, or, without ``file_id``, the same for all files; of a level defined twice any one counts. Paragraphs are
    sorted once, by list: for each level in use, whose number the definitions bound, one running count of its items, and that count as it
    was when a shallower item last passed.
    """
    key = [c for c in ("file_id", "num_id") if c in levels.columns]
    formats = levels.dropDuplicates([*key, "ilvl"]).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("ilvl").cast("long"), "fmt"))).alias("formats"))
    known = paragraphs.join(formats, key, "left").withColumn("fmt", F.try_element_at("formats", F.col("ilvl").cast("long"))).drop("formats")
    ordered = F.col("fmt") != "bullet"
    depths = sorted(r[0] for r in levels.where(ordered).select(F.col("ilvl").cast("long")).distinct().collect())
    upto = Window.partitionBy("file_id", "num_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = {d: F.count(F.when(ordered & (F.col("ilvl") == d), 1)).over(upto) for d in depths}
    counted = known.withColumns({f"__n{k}": at[d] for k, d in enumerate(depths)})
    before = {f"__b{k}": F.last(F.when(ordered & (F.col("ilvl") < d), F.col(f"__n{k}")), ignorenulls=True).over(upto) for k, d in enumerate(depths)}
    counted = counted.withColumns(before)
    number = F.lit(None).cast("long")
    for k, d in enumerate(depths):
        number = F.when(F.col("ilvl") == d, F.col(f"__n{k}") - F.coalesce(f"__b{k}", F.lit(0))).otherwise(number)
    prefix = F.when(ordered, format_counter(F.col("__number"), F.col("fmt"))).otherwise("•")
    return counted.withColumn("__number", number).select("file_id", "seq", prefix.alias("prefix"))


def archive_summary(entries: DataFrame) -> DataFrame:
    files = entries.where("not endswith(path, '/')").groupBy("file_id").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))
    return files.withColumn("size_text", format_bytes(F.col("bytes")))


def archive_listing(entries: DataFrame, cap: int = 10_000) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("path")
    files = entries.where("not endswith(path, '/')")
    ranked = files.withColumns({"rank": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("file_id"))})
    return ranked.where(F.col("rank") <= cap).select("file_id", "rank", "path", "size", (F.col("n") > cap).alias("truncated"))


def heading_tags(paragraphs: DataFrame, style: Column) -> DataFrame:
    """h1 to h6 by style name, else p."""
    tags = {"title": "h1", **{f"heading{k}": f"h{k}" for k in range(1, 7)}}
    out = F.lit("p")
    for name, tag in tags.items():
        out = F.when(F.lower(style) == name, tag).otherwise(out)
    return paragraphs.withColumn("tag", out)


def asset_refs(pages: DataFrame) -> DataFrame:
    """Distinct local scripts and styles that a page names in script and link tags."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<(?:script|link)\b[^>]*>)"), F.lit(1))
    ref = F.regexp_extract("tag", r'(?i)(?:src|href)="([^"]*)"', 1)
    found = pages.select("page_id", F.explode(tags).alias("tag")).select("page_id", ref.alias("ref"))
    found = found.where(~F.col("ref").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)") & F.col("ref").rlike(r"\.(?:js|mjs|css)$"))
    return found.select("page_id", F.regexp_replace("ref", r"^(?:\./|/)", "").alias("path")).distinct()


def bundle_weight(refs: DataFrame, assets: DataFrame, limit: int = 102_400) -> DataFrame:
    total = refs.join(assets, "path").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    return total.withColumn("over", F.col("bytes") > limit)
