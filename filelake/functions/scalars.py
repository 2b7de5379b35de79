"""Scalar rules as Spark columns: names, sizes, cell references, number formats, links, counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Built-in number format ids of dates and of percents (fixed values).
DATE_IDS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 57]
PERCENT_IDS = [9, 10]


def file_extension(name: Column) -> Column:
    """Text after the last dot in lower case; empty without a dot, or with it first or last."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def describe_type(mime: Column, name: Column) -> Column:
    """MIME type, else the extension in capitals, else a dash."""
    return F.coalesce(F.nullif(mime, F.lit("")), F.nullif(F.upper(file_extension(name)), F.lit("")), F.lit("—"))


def format_bytes(size: Column) -> Column:
    """1023 B, 1.00 KiB and so on to TiB; two decimals, ties away from zero."""
    units = ["KiB", "MiB", "GiB", "TiB"]
    text = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        scaled = F.round(size.cast("decimal(20,0)") / F.lit(1024**k).cast("decimal(20,0)"), 2).cast("decimal(20,2)")
        shown = F.concat(scaled.cast("string"), F.lit(f" {unit}"))
        text = text.when(size < 1024 ** (k + 1), shown) if k < len(units) else text.otherwise(shown)
    return text


def col_letters(index: Column) -> Column:
    """0 is A, 25 Z, 26 AA, 702 AAA; up to seven letters, beyond the range of int."""
    first, out = 0, F.lit(None)
    for n in range(1, 8):
        at, first = index - first, first + 26**n
        letters = F.concat(*[F.char(F.floor(at / 26**k) % 26 + 65) for k in reversed(range(n))])
        out = F.when(index < first, letters) if n == 1 else out.when(index < first, letters)
    return out


def parse_cell_ref(ref: Column) -> Column:
    """Struct (row, col) from zero of a reference as B2; null if malformed or of row 0."""
    clean = F.upper(F.trim(ref))
    letters, digits = F.regexp_extract(clean, "^([A-Z]+)([0-9]+)$", 1), F.regexp_extract(clean, "^([A-Z]+)([0-9]+)$", 2)
    col = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    row = F.expr("1") * digits.try_cast("long")
    return F.when((letters != "") & (row > 0), F.struct((row - 1).alias("row"), (col - 1).alias("col")))


def num_fmt_kind(fmt_id: Column, code: Column) -> Column:
    """date, percent or general, by built-in id or else by the custom code without quoted and bracketed parts."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(code, F.lit(""))), r'"[^"]*"', ""), r"\[[^\]]*\]", "")
    return (
        F.when(fmt_id.isin(DATE_IDS), "date")
        .when(fmt_id.isin(PERCENT_IDS), "percent")
        .when(bare.rlike("[dmy]"), "date")
        .when(bare.contains("%"), "percent")
        .otherwise("general")
    )


def excel_serial_to_date(serial: Column) -> Column:
    """Timestamp of a serial day number from 0 to 100000, rounded to milliseconds; null outside."""
    return F.when(serial.between(0, 100000), F.timestamp_millis(F.round((serial - 25569) * 86400000).cast("long")))


def format_percent(raw: Column) -> Column:
    """A number times 100 with two decimals at most and a percent sign; other text as it is."""
    value = raw.try_cast("decimal(30,10)") * 100
    text = F.regexp_replace(F.regexp_replace(F.round(value, 2).cast("decimal(30,2)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(value.isNull(), raw).otherwise(F.concat(text, F.lit("%")))


def is_safe_href(url: Column) -> Column:
    """http, https, mailto and fragment links, after control characters and blanks are dropped."""
    return F.regexp_replace(url, r"[\x00-\x20\x7f]", "").rlike(r"(?i)^(https?:|mailto:|#)")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def resolve_part_path(owner: Column, target: Column) -> Column:
    """A relationship's target seen from the part that owns it: schemes pass, a leading slash is the root, .. pops."""
    folder = F.regexp_replace(F.regexp_replace(owner, r"[^/]*$", ""), r"(^|/)_rels/$", "$1")
    step = lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    walked = F.array_join(F.aggregate(F.split(F.concat(folder, target), "/"), F.array().cast("array<string>"), step), "/")
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(walked)


#: Six codes of symbol fonts as text (fixed values).
SYMBOLS = {"F0B7": "•", "F0A7": "❑", "F0FC": "✓", "F0FE": "■", "F02D": "–", "F020": " "}


def symbol_text(code: Column) -> Column:
    """A code of a symbol font as text, an unknown one as a bullet."""
    out = F.lit("•")
    for k, v in SYMBOLS.items():
        out = F.when(F.upper(code) == k, v).otherwise(out)
    return out


def roman(n: Column) -> Column:
    """Roman digits in lower case for 1 to 3999."""
    digits = [["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]]
    pick = lambda row, k: F.get(F.array(*map(F.lit, row)), (F.floor(n / 10**k) % 10).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), pick(digits[2], 2), pick(digits[1], 1), pick(digits[0], 0))


def format_counter(n: Column, fmt: Column) -> Column:
    """A list counter with a full stop: decimal, letters or Roman digits in either case."""
    letters = col_letters(n - 1)
    return F.concat(
        F.when(fmt == "lowerLetter", F.lower(letters)).when(fmt == "upperLetter", letters)
        .when(fmt == "lowerRoman", roman(n)).when(fmt == "upperRoman", F.upper(roman(n))).otherwise(n.cast("string")),
        F.lit("."),
    )


def strip_field_codes(text: Column) -> Column:
    """Drop what stands between the marks 0x13 and 0x14 (or 0x15); the depth falls at both and never below 0."""
    step = lambda a, c: (
        F.when(c == "\x13", F.struct((a["d"] + 1).alias("d"), a["t"].alias("t")))
        .when(c.isin("\x14", "\x15"), F.struct(F.greatest(a["d"] - 1, F.lit(0)).alias("d"), a["t"].alias("t")))
        .otherwise(F.struct(a["d"].alias("d"), F.when(a["d"] == 0, F.concat(a["t"], c)).otherwise(a["t"]).alias("t")))
    )
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("t"))
    return F.when(text.rlike("[\x13\x14\x15]"), F.aggregate(F.split(text, ""), start, step)["t"]).otherwise(text)
