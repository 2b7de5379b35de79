"""Markdown as a table of classified lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_safe_href

#: Characters that count as blank.
BLANKS = " \t\n\x0b\f\r"


def _lead(text):
    return F.ltrim(text, F.lit(BLANKS))


def _bare(text):
    """The text without blanks at either end."""
    return F.rtrim(_lead(text), F.lit(BLANKS))


def _char(text, at):
    return F.substr(text, F.lit(at) if isinstance(at, int) else at, F.lit(1))


def _is_blank(char):
    return char.isin(*BLANKS)


def _only(text, marks: str):
    """At least one character, all of them of ``marks``."""
    return (text != "") & (F.ltrim(text, F.lit(marks)) == "")


def fence_mark(text):
    """The mark of a line that opens or closes a fence, else empty."""
    first = F.left(_lead(text), F.lit(3))
    return F.when(first.isin("```", "~~~"), first).otherwise("")


def atx_marks(text):
    """Number signs of a heading line: one to six, then a blank and at least one character more; else 0."""
    n = F.length(text) - F.length(F.ltrim(text, F.lit("#")))
    return F.when(n.between(1, 6) & _is_blank(_char(text, n + 1)) & (F.length(text) >= n + 2), n).otherwise(0)


def atx_title(text):
    """What stands between the number signs of a heading line; signs alone count as one sign."""
    rest = _lead(F.ltrim(text, F.lit("#")))
    title = F.rtrim(F.rtrim(F.rtrim(rest, F.lit(BLANKS)), F.lit("#")), F.lit(BLANKS))
    return F.when(rest == "", " ").when(title == "", _char(rest, 1)).otherwise(title)


def is_rule(text):
    """Three or more hyphens, or stars and underscores, with nothing but blanks between."""
    marks = F.translate(text, BLANKS, "")
    return (F.length(marks) >= 3) & (_only(marks, "-") | _only(marks, "*_"))


def is_underline(text):
    return _only(_bare(text), "=") | _only(_bare(text), "-")


def list_body(text):
    """What follows the marker of a list item and its blank: a bullet, or up to nine digits with a stop or bracket; else null."""
    lead = _lead(text)
    digits = F.length(lead) - F.length(F.ltrim(lead, F.lit("0123456789")))
    width = F.when(_char(lead, 1).isin("-", "*", "+"), 1).when(digits.between(1, 9) & _char(lead, digits + 1).isin(".", ")"), digits + 1)
    return F.when(_is_blank(_char(lead, width + 1)), _lead(F.substr(lead, width + 1)))


def row_cells(text):
    """Cells of a table row between its bars; bars at its ends close it and add no cell."""
    parts = F.split(_bare(text), F.lit("[|]"))
    first = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
    last = F.size(parts) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.transform(F.slice(parts, first, F.greatest(last - first + 1, F.lit(0))), _bare)


def is_delimiter(text):
    """Two cells or more, each of hyphens with a colon at either end or not."""
    cells = row_cells(text)
    hyphens = lambda c: _only(F.substr(c, F.when(c.startswith(":"), 2).otherwise(1), F.length(c) - F.when(c.startswith(":"), 1).otherwise(0) - F.when(c.endswith(":") & (F.length(c) > 1), 1).otherwise(0)), "-")
    return F.contains(text, F.lit("|")) & (F.size(cells) >= 2) & F.forall(cells, hyphens)


#: Line numbers of a block in which fences are folded at once.
FENCE_BLOCK = 1024


def fence_states(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, text, before, after) of the lines that look like fences: the open mark before and after each.

    Each block of lines is folded from every state that it may begin in; a file's blocks hand
    their states on, and then each block is folded from its own. Other lines are never gathered.
    """
    mark = fence_mark(F.col("text"))
    rows = lines.where(mark != "").select("file_id", F.floor(F.col("line_no") / FENCE_BLOCK).alias("block"), F.struct("line_no", "text", mark.alias("mark"), (_bare(F.col("text")) == mark).alias("bare")).alias("row"))
    blocks = rows.groupBy("file_id", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    step = lambda a, x: F.when(a == "", x["mark"]).when(x["bare"] & (x["mark"] == a), "").otherwise(a)
    ends = {n: F.aggregate("rows", F.lit(s), step) for n, s in (("none", ""), ("ticks", "```"), ("tildes", "~~~"))}
    files = blocks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("block", *[c.alias(n) for n, c in ends.items()]))).alias("blocks"))
    last = lambda a: F.element_at(a, -1)
    starts = F.aggregate(
        "blocks", F.array(F.lit("")), lambda a, x: F.array_append(a, F.when(last(a) == "", x["none"]).when(last(a) == "```", x["ticks"]).otherwise(x["tildes"]))
    )
    begun = files.select(F.col("file_id").alias("f"), F.explode(F.arrays_zip(F.col("blocks.block").alias("b"), F.slice(starts, 1, F.size("blocks")).alias("start"))).alias("z"))
    begun = begun.select("f", F.col("z.b").alias("b"), F.col("z.start").alias("start"))
    own = blocks.join(begun, F.col("file_id").eqNullSafe(F.col("f")) & F.col("block").eqNullSafe(F.col("b")))
    states = own.select("file_id", "rows", F.aggregate("rows", F.array("start"), lambda a, x: F.array_append(a, step(last(a), x))).alias("states"))
    flat = states.select("file_id", "states", F.posexplode("rows").alias("at", "row"))
    return flat.select("file_id", "row.line_no", "row.text", F.get("states", F.col("at")).alias("before"), F.get("states", F.col("at") + 1).alias("after"))


def md_blocks(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, class, level, text): fence state carried in line order, the rest by patterns in rank order."""
    others = lines.where(F.coalesce(fence_mark(F.col("text")), F.lit("")) == "").select("file_id", "line_no", "text", *[F.lit(None).cast("string").alias(c) for c in ("before", "after")])
    upto = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.coalesce(F.last("after", ignorenulls=True).over(upto), F.lit(""))
    fence = F.when(F.col("before") == "", "fence_open").when(F.col("before").isNotNull() & (F.col("after") == ""), "fence_close").when(F.coalesce("before", "state") != "", "code").otherwise("")
    flat = fence_states(lines).unionByName(others).withColumn("state", state).withColumn("fence", fence)
    w = Window.partitionBy("file_id").orderBy("line_no")
    t = F.col("text")
    is_quote, is_item = _lead(t).startswith(">"), list_body(t).isNotNull()
    own = (
        F.when(F.col("fence") != "", F.col("fence"))
        .when(_lead(t) == "", "blank")
        .when(atx_marks(t) > 0, "atx")
        .when(is_quote, "quote")
        .when(is_delimiter(t), "table_sep")
        .when(is_rule(t), "rule")
        .when(is_item, "list")
        .otherwise("text")
    )
    # an underline of text above it is a heading, whatever it were alone
    kind = F.when(is_underline(t) & ~F.col("own").isin("fence_open", "fence_close", "code") & (F.lag("own").over(w) == "text"), "setext").otherwise(F.col("own"))
    level = F.when(F.col("class") == "atx", atx_marks(t)).when(F.col("class") == "setext", F.when(_lead(t).startswith("="), 1).otherwise(2))
    return flat.withColumn("own", own).withColumn("class", kind).select("file_id", "line_no", "class", level.alias("level"), "text")


def md_outline(blocks: DataFrame) -> DataFrame:
    """Headings in order; a setext heading takes the line above its underline."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    rows = blocks.withColumn("above", F.lag("text").over(w)).where(F.col("class").isin("atx", "setext"))
    return rows.select("file_id", "line_no", "level", F.when(F.col("class") == "atx", atx_title(F.col("text"))).otherwise(F.trim("above")).alias("text"))


def md_block_profile(blocks: DataFrame) -> DataFrame:
    classes = ["atx", "blank", "code", "fence_close", "fence_open", "list", "quote", "rule", "setext", "table_sep", "text"]
    return blocks.groupBy("file_id").pivot("class", classes).count().na.fill(0)


def md_tasks(blocks: DataFrame) -> DataFrame:
    body = list_body(F.col("text"))
    box = (_char(body, 1) == "[") & _char(body, 2).isin(" ", "x", "X") & (_char(body, 3) == "]") & _is_blank(_char(body, 4))
    tasks = blocks.where(F.col("class") == "list").where(box).select("file_id", _char(body, 2).alias("mark"))
    return tasks.groupBy("file_id").agg(F.count(F.when(F.lower("mark") == "x", 1)).alias("done"), F.count(F.when(F.col("mark") == " ", 1)).alias("open"))


def md_code_blocks(blocks: DataFrame) -> DataFrame:
    """Fenced blocks: number, language and content."""
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = blocks.where(F.col("class").isin("fence_open", "code")).withColumn("block", F.count(F.when(F.col("class") == "fence_open", 1)).over(w))
    code = F.filter(F.array_sort(F.collect_list(F.struct("line_no", "class", "text"))), lambda x: x["class"] == "code")
    return inside.groupBy("file_id", "block").agg(
        F.max(F.when(F.col("class") == "fence_open", F.regexp_extract(_lead(F.substr(_lead(F.col("text")), F.lit(4))), r"^\S*", 0))).alias("language"),
        F.array_join(F.transform(code, lambda x: x["text"]), "\n").alias("content"),
    )


#: Forms of images, links and bare links within a line (fixed values).
IMAGE, LINK, AUTOLINK = r"!\[([^\]]*)\]\(([^)\s]+)\)", r"\[([^\]]+)\]\(([^)\s]+)\)", r"<(https?:[^<>\s]+)>"
SAFE_LINK = r"\[[^\]]+\]\((?i:https?:|mailto:|#)[^)\s]*\)"
#: Stands for what has been taken out of a line.
TAKEN = "\x01"


def md_links(blocks: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, seq, label, url, safe): images, links and <http..> links outside fences and code spans.

    ``seq`` counts within a line and kind. An image is not a link too, nor is what a safe link holds.
    """
    rows = blocks.where(~F.col("class").isin("fence_open", "code", "fence_close")).select("file_id", "line_no", F.regexp_replace("text", "`[^`\n]+`", TAKEN).alias("t"))
    rows = rows.withColumn("u", F.regexp_replace("t", IMAGE, TAKEN)).withColumn("v", F.regexp_replace("u", SAFE_LINK, TAKEN))

    def found(kind, column, pattern):
        label, url = (F.lit(""), 1) if kind == "autolink" else (None, 2)
        one = lambda m, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("seq"), F.replace(F.regexp_extract(m, pattern, 1) if label is None else label, F.lit(TAKEN), F.lit("")).alias("label"),
            F.regexp_extract(m, pattern, url).alias("url"),
        )
        return F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), one)

    links = F.concat(found("image", "t", IMAGE), found("link", "u", LINK), found("autolink", "v", AUTOLINK))
    return rows.select("file_id", "line_no", F.explode(links).alias("x")).select("file_id", "line_no", "x.kind", "x.seq", "x.label", "x.url", is_safe_href(F.col("x.url")).alias("safe"))


def md_tables(blocks: DataFrame) -> DataFrame:
    """(file_id, table_line, row, col, align, text) of tables; row 0 is the head, short rows are padded and extra cells dropped.

    A table is known by the line number of its delimiter row; rows follow until a blank line or
    one without a bar. One window by file; a second delimiter row starts a table of its own.
    """
    w = Window.partitionBy("file_id").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (F.col("class") == "table_sep") & F.col("above").contains("|")
    stops = ~F.col("text").contains("|") | F.col("text").rlike(r"^\s*$")
    rows = blocks.withColumn("above", F.lag("text").over(w)).withColumns(
        {"table": F.last(F.when(starts, F.struct("line_no", "above", "text")), ignorenulls=True).over(upto), "stop": F.last(F.when(stops, F.col("line_no")), ignorenulls=True).over(upto)}
    )
    inside = rows.where("table is not null and (stop is null or stop < table.line_no)")
    own = F.when(F.col("line_no") == F.col("table.line_no"), F.col("above")).otherwise(F.col("text"))
    head, marks = row_cells(F.col("table.above")), row_cells(F.col("table.text"))
    mark = F.coalesce(F.get("marks", F.col("col")), F.lit(""))
    colons = mark.startswith(":").cast("int") + 2 * mark.endswith(":").cast("int")
    align = F.get(F.array(*map(F.lit, ("left", "left", "right", "center"))), colons)
    flat = inside.select(
        "file_id", F.col("table.line_no").alias("table_line"), (F.col("line_no") - F.col("table.line_no")).alias("row"), row_cells(own).alias("cells"), marks.alias("marks"), F.posexplode(head).alias("col", "head")
    )
    return flat.select("file_id", "table_line", "row", "col", align.alias("align"), F.coalesce(F.get("cells", F.col("col")), F.lit("")).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, seq, url, safe) of anchors; relative links are not safe."""
    urls = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(urls).alias("seq", "url")).withColumn("safe", is_safe_href(F.col("url")))
