"""Every query over the test tables with its SQL for DuckDB."""

from __future__ import annotations

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archives as A
from ..operators import markdown as M
from ..operators import records as R
from ..operators import triage as T
from ..operators import views as V
from ..sources.files import list_files, shared_path, write_files
from ..streaming import streams
from .fixtures import frame, with_fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *fixtures: str):
    """Register a query, and its SQL over the named fixtures (a leading ~ goes on with more CTEs)."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_fixtures(sql.strip(), *fixtures)
        return f

    return put


def files(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "fx_files").select("file_id", "name", F.unhex("h").alias("content"))


EXT = "case when regexp_matches(name, '^.+\\.[^.]+$') then lower(regexp_extract(name, '\\.([^.]+)$', 1)) else '' end"
B = lambda k: f"(('0x' || substr(h, {2 * k - 1}, 2))::int)"
MEDIA_SQL = f"""case when starts_with(h,'89504E470D0A1A0A') then 'image/png' when starts_with(h,'FFD8FF') then 'image/jpeg'
  when starts_with(h,'474946383761') or starts_with(h,'474946383961') then 'image/gif' when starts_with(h,'52494646') and substr(h,17,8)='57454250' then 'image/webp'
  when starts_with(h,'00000100') then 'image/ico' when starts_with(h,'52494646') and substr(h,17,8)='57415645' then 'audio/wav' when substr(h,9,8)='66747970' then 'video/mp4'
  when starts_with(h,'1A45DFA3') then 'video/webm' when starts_with(h,'4F676753') then 'audio/ogg' when starts_with(h,'494433') then 'audio/mp3'
  when length(h)>=4 and starts_with(h,'FF') and {B(2)}>=224 and ({B(2)}//8)%4<>1 and ({B(2)}//2)%4<>0 then 'audio/mp3' end"""
SNIFF = f"""~ t as (select file_id, {EXT} as extension, h, substr(h,1,8192) as hh from fx_files),
 u as (select *, regexp_replace(hh, '(..)', '\\1 ', 'g') as sp from t),
 w as (select *, (length(sp) - length(regexp_replace(sp, '(0[0-7]|0B|0E|0F|1[0-9]|1A|1C|1D|1E|1F|7F) ', '', 'g')))//3 as stray, regexp_matches(sp, '(^| )00 ') as has_nul from u),
 s as (select file_id, extension, h, stray, has_nul, starts_with(h,'504B0304') as z, starts_with(h,'D0CF11E0A1B11AE1') as o, starts_with(h,'25504446') as p, {MEDIA_SQL} as m,
   (h = '' or starts_with(h,'EFBBBF') or starts_with(h,'FFFE') or starts_with(h,'FEFF') or (not has_nul and stray*2.0/length(hh) <= 0.01)) as x from w)"""
LISTS = {v: "(" + ",".join(f"'{e}'" for e in x.split()) + ")" for v, x in T.VIEWERS}
SIG = {"doc": "x", "office": "(z or o)", "archive": "z", "pdf": "p", "media": "m is not null", "code": "x"}
OOXML = "('docx','xlsx','pptx','ods','odt','odp')"
MATCH = {
    "doc": f"extension in {LISTS['doc']} and x", "office": f"((extension in {OOXML} and (z or o)) or (extension in ('doc','xls','ppt') and o))",
    "archive": "extension='zip' and z", "pdf": "extension='pdf' and p", "media": "m is not null", "code": "x",
}
CANDIDATES = " union all ".join(
    [f"select file_id, extension, '{v}' as viewer_id, 0 as source, {k} as ord, ({MATCH[v]}) as ok from s where extension in {LISTS[v]}" for k, v in enumerate(LISTS)]
    + [f"select file_id, extension, '{v}', 1, {k}, ({MATCH[v]}) from s where {SIG[v]} and extension not in {LISTS[v]}" for k, v in enumerate(LISTS)]
)
ROUTED = f"""{SNIFF}, c as ({CANDIDATES}), q as (select file_id, first(viewer_id order by source, ord) as viewer_id, first(source order by source, ord) as source from c where ok group by file_id),
 r as (select s.file_id, s.extension, s.h, coalesce(q.viewer_id,'fallback') as viewer_id, coalesce(q.source,2) as source from s left join q using (file_id))"""


@query("file_heads", f"select file_id, {EXT} as extension, substr(h,1,8192) as head from fx_files", "fx_files")
def _(spark, d):
    return T.file_heads(files(spark, d)).withColumn("head", F.hex("head"))


@query("text_preview", "select file_id, substr(h,1,2000) as preview, length(h) > 2000 as truncated from fx_files", "fx_files")
def _(spark, d):
    return V.text_preview(files(spark, d), 1000).withColumn("preview", F.hex("preview"))


@query("file_extension", f"select file_id, {EXT} as extension from fx_files", "fx_files")
def _(spark, d):
    return frame(spark, d, "fx_files").select("file_id", S.file_extension(F.col("name")).alias("extension"))


@query("base_name", "select file_id, path, regexp_extract(path, '[^/]*$') as base from fx_entries", "fx_entries")
def _(spark, d):
    return frame(spark, d, "fx_entries").select("file_id", "path", S.base_name(F.col("path")).alias("base"))


@query("describe_type", f"select file_id, coalesce(nullif(upper({EXT}), ''), '—') as kind from fx_files", "fx_files")
def _(spark, d):
    return frame(spark, d, "fx_files").select("file_id", S.describe_type(F.lit(""), F.col("name")).alias("kind"))


@query("magic_flags", f"{SNIFF} select file_id, z as is_zip, o as is_ole, p as is_pdf from s", "fx_files")
def _(spark, d):
    return T.sniffed(files(spark, d)).select("file_id", "is_zip", "is_ole", "is_pdf")


@query("detect_media", f"{SNIFF} select file_id, split_part(m,'/',1) as kind, split_part(m,'/',2) as format from s where m is not null", "fx_files")
def _(spark, d):
    return T.sniffed(files(spark, d)).where("media is not null").select("file_id", "media.kind", "media.format")


@query("is_mpeg_audio", f"select file_id, coalesce(length(h)>=4 and starts_with(h,'FF') and {B(2)}>=224 and ({B(2)}//8)%4<>1 and ({B(2)}//2)%4<>0, false) as mpeg from fx_files", "fx_files")
def _(spark, d):
    return T.file_heads(files(spark, d)).select("file_id", T.is_mpeg_audio(F.col("head")).alias("mpeg"))


@query("has_text_bom", "select file_id, starts_with(h,'EFBBBF') or starts_with(h,'FFFE') or starts_with(h,'FEFF') as bom from fx_files", "fx_files")
def _(spark, d):
    return T.file_heads(files(spark, d)).select("file_id", T.has_text_bom(F.col("head")).alias("bom"))


@query("is_probably_text", f"{SNIFF} select file_id, has_nul, cast(stray as int) as stray, x as is_text from s", "fx_files")
def _(spark, d):
    h = F.col("head")
    return T.file_heads(files(spark, d)).select("file_id", T.has_nul(h).alias("has_nul"), T.stray_bytes(h).alias("stray"), T.is_probably_text(h).alias("is_text"))


@query("candidates_by_extension", f"{SNIFF}, c as ({CANDIDATES}) select file_id, viewer_id, source, ord from c where source = 0", "fx_files")
def _(spark, d):
    return T.candidates_by_extension(files(spark, d))


@query("candidates_by_signature", f"{SNIFF}, c as ({CANDIDATES}) select file_id, viewer_id, source, ord from c where source = 1", "fx_files")
def _(spark, d):
    return T.candidates_by_signature(files(spark, d))


@query("candidate_union", f"{SNIFF}, c as ({CANDIDATES}) select file_id, viewer_id, source, ord from c", "fx_files")
def _(spark, d):
    return T.candidate_union(files(spark, d))


@query("route_files", f"{ROUTED} select file_id, extension, viewer_id, source from r", "fx_files")
def route_files(spark, d):
    return T.route_files(files(spark, d))


@query("mislabelled_files", f"{ROUTED}, e as (select file_id, first(viewer_id order by ord) as expected_viewer from c where source=0 group by 1) select r.file_id, extension, expected_viewer, viewer_id from r join e using (file_id) where viewer_id <> expected_viewer", "fx_files")
def _(spark, d):
    return T.mislabelled_files(files(spark, d))


@query("route_report", f"{ROUTED} select viewer_id, extension, count(*) as files, cast(sum(length(h)//2) as bigint) as bytes from r group by rollup(viewer_id, extension)", "fx_files")
def _(spark, d):
    return T.route_report(files(spark, d))


@query("triage_stream", f"{ROUTED} select file_id, viewer_id from r", "fx_files")
def _(spark, d):
    return streams.run_once(files(spark, d), lambda s: streams.triage_stream(s).select("file_id", "viewer_id"))


@query("encrypted_packages", "select file_id from fx_ole where starts_with(h,'D0CF11E0A1B11AE1') and regexp_matches(h,'^(..)*45006E0063007200790070007400650064005000610063006B00610067006500') and regexp_matches(h,'^(..)*45006E006300720079007000740069006F006E0049006E0066006F00')", "fx_ole")
def _(spark, d):
    return T.encrypted_packages(frame(spark, d, "fx_ole").select("file_id", F.unhex("h").alias("content")))


@query("split_lines", "select file_id, cast(line_no as int) as line_no, text from fx_lines", "fx_lines")
def _(spark, d):
    return V.split_lines(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), "text"))


@query("clip_lines", "select file_id, cast(line_no as int) as line_no, case when length(text) > 100 then text[:100] || '…' else text end as text from fx_lines", "fx_lines")
def _(spark, d):
    return V.clip_lines(frame(spark, d, "fx_lines"), 100)


@query("line_page", "select file_id, cast(line_no as int) as line_no, text from fx_lines where line_no between 3 and 7", "fx_lines")
def _(spark, d):
    return V.line_page(frame(spark, d, "fx_lines"), 3, 7)


@query("hex_dump", """~ a as (select file_id, h, length(h)//2 as n from fx_files), b as (select file_id, n, unnest(range(0, (n-1)//16+1)) as row_no, h from a where n > 0),
 c as (select file_id, row_no, n, substr(h, row_no*32+1, 32) as p from b),
 e as (select *, trim(regexp_replace(lower(p), '(..)', '\\1 ', 'g')) as sp from c)
 select file_id, row_no, lpad(lower(to_hex(row_no*16)), greatest(8, length(to_hex(n-1)))::int, '0') as "offset",
  rpad(case when length(sp) > 24 then sp[:23] || '  ' || substr(sp, 25) else sp end, 48, ' ') as hex,
  array_to_string(list_transform(range(0, length(p)//2), lambda i: case when ('0x'||substr(p,2*i+1,2))::int between 32 and 126 then chr(('0x'||substr(p,2*i+1,2))::int) else '.' end), '') as ascii from e""", "fx_files")
def _(spark, d):
    return V.hex_dump(files(spark, d))


def coded(spark: SparkSession, d: str) -> DataFrame:
    """Texts in many code pages as files; only the encoding needs Python."""

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series, labels: pd.Series) -> pd.Series:
        marks = {"utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}
        return pd.Series([marks.get(page, b"") + t.encode(V.CODECS.get(page, "utf-8")) for t, page in zip(texts, labels, strict=True)])

    return frame(spark, d, "fx_coded").select("file_id", F.lit("c.txt").alias("name"), encoded("text", "coded").alias("content"))


@query("detect_encoding", """~ b as (select *, starts_with(h,'FFFE') or starts_with(h,'FEFF') or starts_with(h,'EFBBBF') as bom from fx_files)
 select file_id, case when starts_with(h,'FFFE') then 'utf-16le' when starts_with(h,'FEFF') then 'utf-16be' else 'utf-8' end as encoding, bom, not bom and file_id % 19 not in (1, 3, 4) as guessed from b
 union all select file_id, coded, starts_with(coded, 'utf-16'), not starts_with(coded, 'utf-16') from fx_coded""", "fx_files", "fx_coded")
def _(spark, d):
    return V.detect_encoding(files(spark, d).unionByName(coded(spark, d))).drop("confidence")


@query("extract_strings")
def _(spark, d):
    return V.extract_strings(files(spark, d))


@query("cap_strings", "~ a as (select file_id, line_no, text, sum(length(text)) over w as c, row_number() over w as n from fx_lines window w as (partition by file_id order by line_no)) select file_id, cast(line_no as bigint) as \"offset\", text from a where n <= 5 and c <= 1000", "fx_lines")
def _(spark, d):
    return V.cap_strings(frame(spark, d, "fx_lines").select("file_id", F.col("line_no").cast("long").alias("offset"), "text"), 5, 1000)


@query("strings_summary", "select file_id, count(*) as found, count(*) > 5 or sum(length(text)) > 1000 as truncated from fx_lines group by 1", "fx_lines")
def _(spark, d):
    return V.strings_summary(frame(spark, d, "fx_lines"), 5, 1000)


@query("format_bytes", """select o_orderkey, case when b < 1024 then b || ' B' when b < 1048576 then cast(round(b/1024.0,2) as decimal(20,2)) || ' KiB'
 else cast(round(b/1048576.0,2) as decimal(20,2)) || ' MiB' end as size_text from (select o_orderkey, cast(floor(o_totalprice * (o_orderkey % 50)) as bigint) as b from orders)""", "fx_opens")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", S.format_bytes(F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 50)).cast("long")).alias("size_text"))


@query("col_letters", "select p_partkey, case when i < 26 then chr(65+i) when i < 702 then chr(65+(i-26)//26) || chr(65+(i-26)%26) else chr(65+(i-702)//676) || chr(65+((i-702)//26)%26) || chr(65+(i-702)%26) end as letters from (select p_partkey, cast(p_partkey % 16384 as int) as i from part)", "fx_opens")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", S.col_letters(F.col("p_partkey") % 16384).alias("letters"))


@query("parse_cell_ref", "select p_partkey, p_partkey % 99 as \"row\", p_partkey % 26 as col from part", "fx_opens")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    ref = S.parse_cell_ref(F.concat(F.lit(" "), S.col_letters(F.col("p_partkey") % 26), (F.col("p_partkey") % 99 + 1).cast("string")))
    return p.select("p_partkey", ref["row"].alias("row"), ref["col"].alias("col"))


@query("is_safe_href", "select page_id, url, regexp_matches(regexp_replace(url, '[\\x00-\\x20\\x7f]', '', 'g'), '^(?i:https?:|mailto:|#)') as safe from fx_hrefs", "fx_hrefs")
def _(spark, d):
    return frame(spark, d, "fx_hrefs").select("page_id", "url", S.is_safe_href(F.col("url")).alias("safe"))


@query("escape_html", "select page_id, replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;') as html from pages", "fx_opens")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.escape_html(F.col("html")).alias("html"))


@query("resolve_rels", "select r.file_id, r.part, seq, r.rel_id, target from fx_refs r join fx_rels l on r.file_id=l.file_id and r.part=l.part and r.rel_id=l.rel_id where not l.external", "fx_rels", "fx_refs")
def _(spark, d):
    return R.resolve_rels(frame(spark, d, "fx_refs"), frame(spark, d, "fx_rels"))


@query("slide_order", "select r.file_id, cast(row_number() over (partition by r.file_id order by seq) as int) as slide_no, target from fx_refs r join fx_rels l on r.file_id=l.file_id and r.part=l.part and r.rel_id=l.rel_id where not l.external and r.part='part0.xml'", "fx_rels", "fx_refs")
def _(spark, d):
    return R.slide_order(frame(spark, d, "fx_refs").where("part = 'part0.xml'"), frame(spark, d, "fx_rels"))


@query("shared_string_lookup", "select c.file_id, sheet_no, pos, case when type='s' then coalesce(s.text, raw) else raw end as value from fx_cells c left join fx_shared s on c.file_id=s.file_id and c.type='s' and s.idx = try_cast(raw as bigint)", "fx_cells", "fx_shared")
def _(spark, d):
    return R.shared_string_lookup(frame(spark, d, "fx_cells"), frame(spark, d, "fx_shared")).select("file_id", "sheet_no", "pos", "value")


@query("style_lookup", "select c.file_id, sheet_no, pos, coalesce(x.num_fmt_id, 0) as num_fmt_id, f.code from fx_cells c left join fx_xf x on c.file_id=x.file_id and c.style=x.xf_idx left join fx_fmts f on f.file_id=c.file_id and f.num_fmt_id=x.num_fmt_id", "fx_cells", "fx_xf", "fx_fmts")
def _(spark, d):
    return R.style_lookup(frame(spark, d, "fx_cells"), frame(spark, d, "fx_xf"), frame(spark, d, "fx_fmts")).select("file_id", "sheet_no", "pos", "num_fmt_id", "code")


def _cells(spark, d):
    return frame(spark, d, "fx_cells").select("file_id", "sheet_no", "pos", F.col("ref_row").alias("row"), F.col("ref_col").alias("col"), F.col("raw").alias("value"))


@query("last_cell_wins", "select file_id, sheet_no, ref_row as \"row\", ref_col as col, arg_max(raw, pos) as value from fx_cells group by all", "fx_cells")
def _(spark, d):
    return R.last_cell_wins(_cells(spark, d))


@query("sheet_extent", "select file_id, sheet_no, max(ref_row)+1 as total_rows, max(ref_col)+1 as total_cols from fx_cells group by all", "fx_cells")
def _(spark, d):
    return R.sheet_extent(_cells(spark, d))


@query("sheet_grid", """~ v as (select file_id, sheet_no, ref_row as r, ref_col as c, arg_max(raw, pos) as value from fx_cells group by all),
 e as (select file_id, sheet_no, max(r)+1 as tr, max(c)+1 as tc from v group by all), g as (select file_id, sheet_no, tr, tc, unnest(range(0, least(tr, 40))) as r from e),
 h as (select *, unnest(range(0, least(tc, 50))) as c from g)
 select file_id, sheet_no, r as "row", string_agg(coalesce(value,''), '|' order by c) as cells, tr > 40 or tc > 50 as truncated from h left join v using (file_id, sheet_no, r, c) group by file_id, sheet_no, r, tr, tc""", "fx_cells")
def _(spark, d):
    return R.sheet_grid(R.last_cell_wins(_cells(spark, d)), 40, 50).withColumn("cells", F.array_join("cells", "|"))


@query("implied_positions", """~ a as (select *, case when pos % 5 = 0 then null else ref_col end as rc, row_number() over w as n, (pos - 1) // 4 as rp, case when (pos - 1) // 4 % 3 <> 1 then (pos - 1) // 4 + (pos - 1) // 4 % 7 end as rn, case when pos % 11 = 0 then pos // 3 end as rr from fx_cells window w as (partition by file_id, sheet_no order by pos)),
 b as (select *, last_value(rc ignore nulls) over w as lc, last_value(case when rc is not null then n end ignore nulls) over w as ln from a window w as (partition by file_id, sheet_no order by pos rows unbounded preceding)),
 q as (select file_id, sheet_no, rp, max(rn) as rn, coalesce(max(rr), -1) as given, bool_or(rr is null) as own, row_number() over (partition by file_id, sheet_no order by rp) as k from a group by file_id, sheet_no, rp),
 z as (with recursive w as (select file_id, sheet_no, rp, k, coalesce(rn, 0) as r, greatest(given, case when own then coalesce(rn, 0) else -1 end) as top from q where k = 1
  union all select q.file_id, q.sheet_no, q.rp, q.k, coalesce(q.rn, w.top + 1), greatest(w.top, q.given, case when q.own then coalesce(q.rn, w.top + 1) else -1 end) from w join q on q.file_id = w.file_id and q.sheet_no = w.sheet_no and q.k = w.k + 1) select * from w)
 select b.file_id, b.sheet_no, pos, coalesce(b.rr, z.r) as "row", coalesce(lc + n - ln, n - 1) as col from b join z on b.file_id = z.file_id and b.sheet_no = z.sheet_no and b.rp = z.rp""", "fx_cells")
def _(spark, d):
    # rows of four cells, every third row element without a number, some cells with a row of their own
    pos, row_pos = F.col("pos"), F.floor((F.col("pos") - 1) / 4)
    cells = frame(spark, d, "fx_cells").withColumns({"ref_col": F.when(pos % 5 != 0, F.col("ref_col")), "row_pos": row_pos, "row_no": F.when(row_pos % 3 != 1, row_pos + row_pos % 7)})
    return R.implied_positions(cells.withColumn("ref_row", F.when(pos % 11 == 0, F.floor(pos / 3))))


@query("resolve_cells", """~ a as (select c.*, coalesce(s.text, raw) as shown, coalesce(x.num_fmt_id, 0) as f from fx_cells c left join fx_shared s on c.file_id = s.file_id and c.type = 's' and s.idx = try_cast(raw as bigint) left join fx_xf x on c.file_id = x.file_id and c.style = x.xf_idx)
 select file_id, sheet_no, pos, ref_row as "row", ref_col as col, case type when 's' then shown when 'b' then case raw when '1' then 'TRUE' else 'FALSE' end when 'e' then raw when 'str' then raw
  else case when f in (14, 22, 164) then strftime(date '1899-12-30' + cast(raw as int), '%Y-%m-%d') when f in (9, 165) then cast(cast(raw as bigint) * 100 as varchar) || '%' else raw end end as value from a""", "fx_cells", "fx_shared", "fx_xf")
def _(spark, d):
    return R.resolve_cells(*(frame(spark, d, x) for x in ("fx_cells", "fx_shared", "fx_xf", "fx_fmts")))


@query("ods_cells", """~ a as (select file_id, row_no, seq, covered, text, case when row_repeat between 1 and 9999 then row_repeat else 1 end as rr, case when span between 1 and 999 then span else 1 end as sp from fx_ods),
 r as (select file_id, row_no, rr, coalesce(sum(rr) over (partition by file_id order by row_no rows between unbounded preceding and 1 preceding), 0) as f from (select distinct file_id, row_no, rr from a)),
 c as (select *, coalesce(sum(case when covered then 0 else sp end) over (partition by file_id, row_no order by seq rows between unbounded preceding and 1 preceding), 0) as col from a)
 select file_id, cast(unnest(range(cast(f as bigint), cast(f + r.rr as bigint))) as bigint) as "row", cast(col as bigint) as col, text as value from c join r using (file_id, row_no) where not covered""", "fx_ods")
def _(spark, d):
    return R.ods_cells(frame(spark, d, "fx_ods"))


@query("assign_sections", "select r.file_id, r.\"offset\", s.name as section from fx_records r asof join fx_sections s on r.file_id = s.file_id and r.\"offset\" >= s.start", "fx_records", "fx_sections")
def _(spark, d):
    return R.assign_sections(frame(spark, d, "fx_records"), frame(spark, d, "fx_sections"))


@query("merge_continued", """~ a as (select *, count(*) filter (where rec_id <> 60) over (partition by file_id order by "offset" rows unbounded preceding) as g from fx_records)
 select file_id, min("offset") as "offset", case when g > 0 then arg_min(rec_id, "offset") end as rec_id, string_agg(h, '' order by "offset") as h from a group by file_id, g""", "fx_records")
def _(spark, d):
    return R.merge_continued(frame(spark, d, "fx_records"))


@query("assemble_pieces", """~ t as (select file_id, cast(floor(sum(length(text)) * 0.8) as bigint) as total from fx_pieces group by 1)
 select file_id, substr(string_agg(text, '' order by piece_no), 1, total) as text from fx_pieces join t using (file_id) group by file_id, total""", "fx_pieces")
def _(spark, d):
    p = frame(spark, d, "fx_pieces")
    return R.assemble_pieces(p, p.groupBy("file_id").agg(F.floor(F.sum(F.length("text")) * 0.8).alias("total")))


@query("archive_summary", """select file_id, entries, bytes, case when bytes < 1024 then bytes || ' B' when bytes < 1048576 then cast(round(bytes/1024.0,2) as decimal(20,2)) || ' KiB' else cast(round(bytes/1048576.0,2) as decimal(20,2)) || ' MiB' end as size_text
 from (select file_id, count(*) as entries, cast(sum(size) as bigint) as bytes from fx_entries where not ends_with(path,'/') group by 1)""", "fx_entries")
def _(spark, d):
    return R.archive_summary(frame(spark, d, "fx_entries"))


@query("archive_listing", "~ a as (select file_id, path, size, row_number() over (partition by file_id order by path) as rank, count(*) over (partition by file_id) as n from fx_entries where not ends_with(path,'/')) select file_id, cast(rank as int) as rank, path, size, n > 50 as truncated from a where rank <= 50", "fx_entries")
def _(spark, d):
    return R.archive_listing(frame(spark, d, "fx_entries"), 50)


ROMAN = "repeat('m', (n//1000)::int) || (['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'])[n//100%10+1] || (['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'])[n//10%10+1] || (['','i','ii','iii','iv','v','vi','vii','viii','ix'])[n%10+1]"
LETTERS = "case when n <= 26 then chr((96+n)::int) else chr((97+(n-27)//26)::int) || chr((97+(n-27)%26)::int) end"


NUMBERED = f"""case when fmt = 'bullet' or fmt is null then '•' else case fmt when 'decimal' then n::varchar when 'lowerLetter' then {LETTERS} when 'upperLetter' then upper({LETTERS}) when 'lowerRoman' then {ROMAN} else upper({ROMAN}) end || '.' end"""
DEPTHS = (0, 1, 2, 3, 9)


@query("list_numbering", f"""~ k as (select p.*, l.fmt, coalesce(l.fmt <> 'bullet', false) as o from fx_paras p left join fx_levels l using (file_id, num_id, ilvl)),
 c as (select *, case ilvl {" ".join(f"when {d} then count(*) filter (where o and ilvl = {d}) over w" for d in DEPTHS)} end as c, {", ".join(f"count(*) filter (where o and ilvl < {d}) over w as g{d}" for d in DEPTHS)} from k window w as (partition by file_id, num_id order by seq)),
 m as (select *, case ilvl {" ".join(f"when {d} then g{d}" for d in DEPTHS)} end as g from c), n as (select *, c - min(c) over (partition by file_id, num_id, ilvl, o, g) + 1 as n from m)
 select file_id, seq, {NUMBERED} as prefix from n""", "fx_paras", "fx_levels")
def _(spark, d):
    return R.list_numbering(frame(spark, d, "fx_paras"), frame(spark, d, "fx_levels"))


def packed_documents(spark, d) -> DataFrame:
    """(file_id, name, content): fifty documents to an archive; in every third one the first entry's checksum is wrong in the directory."""
    import io
    import zipfile

    def pack(t):
        import pyarrow as pa

        t, buffer = t.sort_by("doc_id"), io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("d/", "")
            for k, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
                z.writestr(f"d/{k}.txt", text)
        data, file_id = bytearray(buffer.getvalue()), t.column("file_id")[0].as_py()
        if file_id % 3 == 1:
            at = data.index(b"PK\x01\x02", data.index(b"PK\x01\x02") + 4) + 16
            data[at] ^= 0xFF
        return pa.table({"file_id": pa.array([file_id], pa.int64()), "name": pa.array([f"{file_id}.zip"]), "content": pa.array([bytes(data)], pa.binary())})

    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.floor(F.col("doc_id") / 50).alias("file_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.groupBy("file_id").applyInArrow(pack, "file_id long, name string, content binary")


def archives_on_disk(spark, d) -> DataFrame:
    """The same archives as files: (file_id, path, size)."""
    path = shared_path(spark)
    write_files(packed_documents(spark, d), path)
    return list_files(spark, path, "*.zip").withColumn("file_id", F.regexp_extract("path", "([0-9]+)[.]zip$", 1).cast("long"))


PACKED = """~ e as (select cast(floor(doc_id / 50) as bigint) as file_id, 'd/' || doc_id || '.txt' as path, coalesce(text, '') as text, row_number() over (partition by floor(doc_id / 50) order by doc_id) as no from documents),
 a as (select *, octet_length(encode(text)) as size, file_id % 3 = 1 and no = 1 as damaged from e)"""


@query("explode_archives", f"{PACKED} select file_id, path, size, case when not damaged then upper(md5(text)) end as md5, damaged from a", "fx_opens")
def _(spark, d):
    return A.explode_archives(packed_documents(spark, d)).select("file_id", "path", "size", F.upper(F.md5("content")).alias("md5"), F.col("error").isNotNull().alias("damaged"))


@query("list_archives", f"{PACKED} select file_id, path, no as entry_no, size, 8 as method from a", "fx_opens")
def _(spark, d):
    return A.list_archives(archives_on_disk(spark, d)).select("file_id", "path", "entry_no", "size", "method")


@query("entry_pieces", f"{PACKED}, p as (select *, unnest(range(0, greatest((size - 1) // 2000, 0) + 1)) as k, hex(encode(text)) as h from a), q as (select file_id, path, k as piece_no, substr(h, k * 4000 + 1, 4000) as h, damaged, size from p) select file_id, path, piece_no, md5(h) as md5, false as failed from q where not damaged or (piece_no + 1) * 2000 <= size union all select file_id, path, size // 2000, null, true from a where damaged", "fx_opens")
def _(spark, d):
    # an entry with a wrong checksum gives its whole pieces before that is known
    pieces = A.entry_pieces(A.list_archives(archives_on_disk(spark, d)), 2000)
    return pieces.select("file_id", "path", "piece_no", F.md5(F.hex("data")).alias("md5"), F.col("error").isNotNull().alias("failed"))


@query("asset_refs", "select distinct page_id, unnest(['a' || (page_id % 5) || '.js', 's.css']) as path from pages", "fx_opens")
def _(spark, d):
    return R.asset_refs(frame(spark, d, "fx_pages"))


@query("bundle_weight", "select page_id, cast(sum(bytes) as bigint) as bytes, sum(bytes) > 102400 as over from (select distinct page_id, unnest(['a' || (page_id % 5) || '.js', 's.css']) as path from pages) join fx_assets using (path) group by 1", "fx_assets")
def _(spark, d):
    return R.bundle_weight(R.asset_refs(frame(spark, d, "fx_pages")), frame(spark, d, "fx_assets"))


@query("latest_open", "select user_id, max(generation) as generation, arg_max(ts, generation) as ts from fx_opens group by 1", "fx_opens")
def _(spark, d):
    return streams.newest(streams.run_once(frame(spark, d, "fx_opens"), streams.latest_open, ["user_id", "day"]))


@query("scan_progress", "~ t as (select file_id, length(h)//2 as total from fx_files), c as (select file_id, sum(length(h)//2) as b from fx_chunks group by 1) select file_id, cast(b as bigint) as bytes_read, total, cast(floor(b*100/greatest(total,1)) as bigint) as percent from c join t using (file_id)", "fx_files", "fx_chunks")
def _(spark, d):
    total = frame(spark, d, "fx_files").select("file_id", (F.length("h") / 2).cast("long").alias("total"))
    chunks = frame(spark, d, "fx_chunks").select("file_id", (F.length("h") / 2).cast("long").alias("bytes"))
    return streams.run_once(chunks.join(total, "file_id"), streams.scan_progress, ["file_id"])


MD = r"""~ l as (select *, line_no % 12 as k, regexp_replace(text, '^[ \t\f\r]+', '') as t from fx_md),
 o as (select *, case k when 1 then 'atx' when 2 then 'fence_open' when 3 then 'code' when 4 then 'fence_close' when 5 then 'quote' when 6 then 'list' when 7 then 'text' when 8 then 'rule' when 10 then
   case when t = '' then 'blank' when regexp_matches(text, '^#{1,6}[ \t].') then 'atx' when t[1] = '>' then 'quote' when t like '%|%' and regexp_matches(t, '^[|:\- ]+$') then 'table_sep'
    when regexp_matches(replace(t, ' ', ''), '^(-{3,}|[*_]{3,})$') then 'rule' when regexp_matches(t, '^([-+*]|[0-9]{1,9}[.)])[ \t]') then 'list' else 'text' end when 11 then 'rule' else 'blank' end as own from l),
 b as (select file_id, line_no, k, text, lag(text) over w as above, case when k = 11 and lag(own) over w = 'text' then 'setext' else own end as class from o window w as (partition by file_id order by line_no)),
 m as (select *, case class when 'atx' then length(text) - length(ltrim(text, '#')) when 'setext' then 2 end as level from b)
"""


@query("md_blocks", MD + "select file_id, line_no, class, level, text from m", "fx_md")
def _blocks(spark, d):
    return M.md_blocks(frame(spark, d, "fx_md"))


@query("md_outline", MD + "select file_id, line_no, level, case class when 'setext' then trim(above) else rtrim(rtrim(rtrim(ltrim(ltrim(text, '#'))), '#')) end as text from m where class in ('atx', 'setext')", "fx_md")
def _(spark, d):
    return M.md_outline(_blocks(spark, d))


CLASSES = "atx blank code fence_close fence_open list quote rule setext table_sep text".split()


@query("md_block_profile", MD + "select file_id, " + ", ".join(f"count(*) filter (where class = '{c}') as {c}" for c in CLASSES) + " from m group by file_id", "fx_md")
def _(spark, d):
    return M.md_block_profile(_blocks(spark, d))


@query("md_tasks", MD + "select file_id, count(*) filter (where file_id % 2 = 0) as done, count(*) filter (where file_id % 2 = 1) as open from m where k = 6 group by file_id", "fx_md")
def _(spark, d):
    return M.md_tasks(_blocks(spark, d))


@query("md_code_blocks", MD + "select file_id, row_number() over w as block, 'py' as language, coalesce(content, '') as content from (select file_id, line_no, k, case when lead(k) over v = 3 then lead(text) over v end as content from m window v as (partition by file_id order by line_no)) where k = 2 window w as (partition by file_id order by line_no)", "fx_md")
def _(spark, d):
    return M.md_code_blocks(_blocks(spark, d))


from . import documents as _documents  # noqa: E402, F401  registers its queries here
