"""Input frames of the queries, made from the test tables; the same SQL for Spark and DuckDB where both accept it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name to (Spark SQL, DuckDB SQL).
FIXTURES: dict[str, tuple[str, str]] = {
    "fx_files": (r"""
select doc_id as file_id,
  concat('f', doc_id, case doc_id % 16 when 0 then '.txt' when 1 then '.md' when 2 then '.json' when 3 then '.csv' when 4 then '.html' when 5 then '.svg' when 6 then '.docx' when 7 then '.xlsx' when 8 then '.zip' when 9 then '.pdf' when 10 then '.PNG' when 11 then '.mp3' when 12 then '.doc' when 13 then '.ods' when 14 then '.' else '' end) as name,
  concat(case doc_id % 19 when 0 then '504B0304' when 1 then 'D0CF11E0A1B11AE1' when 2 then '25504446' when 3 then '89504E470D0A1A0A' when 4 then 'FFD8FF' when 5 then '474946383961' when 6 then '524946460000000057454250' when 7 then '00000100' when 8 then '524946460000000057415645' when 9 then '00000018667479706D703432' when 10 then '1A45DFA3' when 11 then '4F676753' when 12 then '494433' when 13 then 'EFBBBF' when 14 then 'FFFE' when 15 then '0102030405060708' else '' end, hex(encode(text, 'UTF-8'))) as h
from documents
""", r"""
select doc_id as file_id,
  concat('f', doc_id, case doc_id % 16 when 0 then '.txt' when 1 then '.md' when 2 then '.json' when 3 then '.csv' when 4 then '.html' when 5 then '.svg' when 6 then '.docx' when 7 then '.xlsx' when 8 then '.zip' when 9 then '.pdf' when 10 then '.PNG' when 11 then '.mp3' when 12 then '.doc' when 13 then '.ods' when 14 then '.' else '' end) as name,
  concat(case doc_id % 19 when 0 then '504B0304' when 1 then 'D0CF11E0A1B11AE1' when 2 then '25504446' when 3 then '89504E470D0A1A0A' when 4 then 'FFD8FF' when 5 then '474946383961' when 6 then '524946460000000057454250' when 7 then '00000100' when 8 then '524946460000000057415645' when 9 then '00000018667479706D703432' when 10 then '1A45DFA3' when 11 then '4F676753' when 12 then '494433' when 13 then 'EFBBBF' when 14 then 'FFFE' when 15 then '0102030405060708' else '' end, hex(encode(text))) as h
from documents
"""),
    # texts by code page, letters of English written as Cyrillic and kana ones; too few of them stay UTF-8
    "fx_coded": (r"""
select file_id, label, text, case when label in ('utf-16le', 'utf-16be') then label when label = 'windows-1252' then case when length(regexp_replace(text, r'[\x00-\x7F]', '')) >= 20 then label else 'utf-8' end when letters >= 100 then label else 'utf-8' end as coded from (
 select -1 - doc_id as file_id, label, length(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '')) as letters,
  case label when 'windows-1252' then regexp_replace(coalesce(text, ''), r'[^\x00-\x7F\x{A0}-\x{FF}]', '') when 'shift_jis' then translate(regexp_replace(coalesce(text, ''), r'[^\x00-\x7F]', ''), 'etaoinshrdlucmfwypvbgkqjxzETAOINSHRDLUCMFWYPVBGKQJXZ', 'いんのとしかうたをてにはるなこでりすきもがまさられくアンイスルトラリコタテシクロキニハマナカサレエオミツ') when 'windows-1251' then translate(regexp_replace(coalesce(text, ''), r'[^\x00-\x7F]', ''), 'etaoinshrdlucmfwypvbgkqjxzETAOINSHRDLUCMFWYPVBGKQJXZ', 'оеаинтсрвлкмдпуяыгзбчйхжшьОЕАИНТСРВЛКМДПУЯЫГЗБЧЙХЖШЬ')
   when 'ibm866' then translate(regexp_replace(coalesce(text, ''), r'[^\x00-\x7F]', ''), 'etaoinshrdlucmfwypvbgkqjxzETAOINSHRDLUCMFWYPVBGKQJXZ', 'оеаинтсрвлкмдпуяыгзбчйхжшьОЕАИНТСРВЛКМДПУЯЫГЗБЧЙХЖШЬ') when 'koi8-r' then translate(regexp_replace(coalesce(text, ''), r'[^\x00-\x7F]', ''), 'etaoinshrdlucmfwypvbgkqjxzETAOINSHRDLUCMFWYPVBGKQJXZ', 'оеаинтсрвлкмдпуяыгзбчйхжшьОЕАИНТСРВЛКМДПУЯЫГЗБЧЙХЖШЬ') else coalesce(text, '') end as text
 from (select doc_id, text, case doc_id % 7 when 0 then 'windows-1251' when 1 then 'ibm866' when 2 then 'koi8-r' when 3 then 'shift_jis' when 4 then 'windows-1252' when 5 then 'utf-16le' else 'utf-16be' end as label from documents))
""", r"""
select file_id, label, text, case when label in ('utf-16le', 'utf-16be') then label when label = 'windows-1252' then case when length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) >= 20 then label else 'utf-8' end when letters >= 100 then label else 'utf-8' end as coded from (
 select -1 - doc_id as file_id, label, length(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g')) as letters,
  case label when 'windows-1252' then regexp_replace(coalesce(text, ''), '[^\x00-\x7F\x{A0}-\x{FF}]', '', 'g') when 'shift_jis' then translate(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g'), 'etaoinshrdlucmfwypvbgkqjxzETAOINSHRDLUCMFWYPVBGKQJXZ', 'いんのとしかうたをてにはるなこでりすきもがまさられくアンイスルトラリコタテシクロキニハマナカサレエオミツ') when 'windows-1251' then translate(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g'), 'etaoinshrdlucmfwypvbgkqjxzETAOINSHRDLUCMFWYPVBGKQJXZ', 'оеаинтсрвлкмдпуяыгзбчйхжшьОЕАИНТСРВЛКМДПУЯЫГЗБЧЙХЖШЬ')
   when 'ibm866' then translate(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g'), 'etaoinshrdlucmfwypvbgkqjxzETAOINSHRDLUCMFWYPVBGKQJXZ', 'оеаинтсрвлкмдпуяыгзбчйхжшьОЕАИНТСРВЛКМДПУЯЫГЗБЧЙХЖШЬ') when 'koi8-r' then translate(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g'), 'etaoinshrdlucmfwypvbgkqjxzETAOINSHRDLUCMFWYPVBGKQJXZ', 'оеаинтсрвлкмдпуяыгзбчйхжшьОЕАИНТСРВЛКМДПУЯЫГЗБЧЙХЖШЬ') else coalesce(text, '') end as text
 from (select doc_id, text, case doc_id % 7 when 0 then 'windows-1251' when 1 then 'ibm866' when 2 then 'koi8-r' when 3 then 'shift_jis' when 4 then 'windows-1252' when 5 then 'utf-16le' else 'utf-16be' end as label from documents))
"""),
    "fx_lines": (r"""
select doc_id as file_id, pos + 1 as line_no, col as text from (select doc_id, posexplode(split(text, '\r\n|\r|\n', -1)) from documents)
""", r"""
select doc_id as file_id, unnest(range(1, len(a) + 1)) as line_no, unnest(a) as text from (select doc_id, regexp_split_to_array(text, '\r\n|\r|\n') as a from documents)
"""),
    "fx_chunks": (r"""
select file_id, k * 1024 as offset, substr(h, cast(k * 2048 + 1 as int), 2048) as h from (select file_id, h, explode(sequence(0L, cast(floor((length(h) - 1) / 2048) as bigint))) as k from fx_files)
""", r"""
select file_id, o as offset, substr(h, o * 2 + 1, 2048) as h from (select file_id, h, unnest(range(0, cast(floor((length(h) - 1) / 2048) as bigint) + 1)) * 1024 as o from fx_files)
"""),
    "fx_entries": (r"""
select file_id, path, max(size) as size from (
  select cast(floor(l_orderkey / 50) as bigint) as file_id, concat('d', l_suppkey % 7, '/p', l_partkey, case l_linenumber when 1 then '.png' when 2 then '.JPG' when 3 then '.svg' when 4 then '.pdf' when 5 then '.txt' when 6 then '' else '/' end) as path, cast(l_quantity * 100 as bigint) as size from lineitem) t
group by file_id, path
""",) * 2,
    "fx_ole": (r"""
select o_orderkey as file_id, concat(case o_orderkey % 4 when 0 then '504B0304' else 'D0CF11E0A1B11AE1' end, '00FE',
  case when o_custkey % 2 = 0 then '45006E0063007200790070007400650064005000610063006B00610067006500' when o_custkey % 5 = 1 then '045006E0063007200790070007400650064005000610063006B006100670065000' else '' end, '0000FF',
  case when o_custkey % 3 = 0 then '45006E006300720079007000740069006F006E0049006E0066006F00' else '' end, '0000') as h
from orders
""",) * 2,
    "fx_rels": (r"""
select cast(floor(o_orderkey / 100) as bigint) as file_id, concat('part', o_custkey % 2, '.xml') as part, concat('rId', o_orderkey % 10) as rel_id, min(case o_custkey % 5 when 0 then '../media/i.png' when 1 then 'slides/s.xml' when 2 then '/ppt/x.xml' when 3 then 'https://a.example/x' else './a//b.xml' end) as target, min(o_custkey % 4) = 0 as external from orders where o_custkey % 3 <> 0 group by 1, 2, 3
""",) * 2,
    "fx_refs": (r"""
select cast(floor(o_orderkey / 100) as bigint) as file_id, concat('part', o_custkey % 2, '.xml') as part, o_orderkey as seq, concat('rId', o_orderkey % 10) as rel_id from orders
""",) * 2,
    "fx_cells": (r"""
select cast(floor(l_orderkey / 2000) as bigint) as file_id, l_linenumber as sheet_no,
  row_number() over (partition by cast(floor(l_orderkey / 2000) as bigint), l_linenumber order by l_orderkey % 60, l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) as pos,
  l_orderkey % 60 as ref_row, l_partkey % 55 as ref_col,
  case l_partkey % 7 when 0 then 's' when 1 then 'b' when 2 then 'e' when 3 then 'str' else '' end as type,
  case l_partkey % 7 when 0 then cast(l_orderkey % 130 as varchar(20)) when 1 then cast(l_orderkey % 3 as varchar(20)) when 2 then '#N/A' when 3 then concat('v', l_orderkey) else cast(cast(40000 + l_quantity as bigint) as varchar(20)) end as raw,
  l_orderkey % 10 as style
from lineitem
""",) * 2,
    "fx_shared": (r"""
select cast(floor(l_orderkey / 2000) as bigint) as file_id, l_partkey % 120 as idx, min(concat('text ', l_partkey)) as text from lineitem group by 1, 2
""",) * 2,
    "fx_xf": (r"""
select f.file_id, n_nationkey as xf_idx, case n_nationkey when 0 then 0 when 1 then 14 when 2 then 9 when 3 then 164 when 4 then 165 when 5 then 166 when 6 then 167 else 22 end as num_fmt_id from (select distinct cast(floor(l_orderkey / 2000) as bigint) as file_id from lineitem) f cross join nation where n_nationkey < 8
""",) * 2,
    "fx_fmts": (r"""
select f.file_id, 164 + r_regionkey as num_fmt_id, case r_regionkey when 0 then 'yyyy-mm-dd' when 1 then '0.0%' when 2 then '"day" 0' else '[Red]0.00' end as code from (select distinct cast(floor(l_orderkey / 2000) as bigint) as file_id from lineitem) f cross join region where r_regionkey < 4
""",) * 2,
    "fx_ods": (r"""
select cast(floor(l_orderkey / 2000) as bigint) as file_id, l_orderkey % 40 as row_no, case l_orderkey % 5 when 0 then 0 when 1 then 3 when 2 then 10000 else 1 end as row_repeat,
  row_number() over (partition by cast(floor(l_orderkey / 2000) as bigint), l_orderkey % 40 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) as seq,
  l_partkey % 11 = 0 as covered, case l_partkey % 4 when 0 then 1000 when 1 then 2 else 1 end as span, concat('t', l_partkey) as text
from lineitem
""",) * 2,
    "fx_paras": (r"""
select cast(floor(l_orderkey / 50) as bigint) as file_id, row_number() over (partition by cast(floor(l_orderkey / 50) as bigint) order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) as seq, l_suppkey % 3 as num_id, case when l_partkey % 23 = 0 then 9 else l_partkey % 4 end as ilvl from lineitem
""",) * 2,
    "fx_levels": (r"""
select f.file_id, cast(floor(n_nationkey / 5) as bigint) as num_id, case n_nationkey % 5 when 4 then 9 else n_nationkey % 5 end as ilvl, case (n_nationkey + f.file_id) % 7 when 0 then 'decimal' when 1 then 'lowerLetter' when 2 then 'lowerRoman' when 3 then 'bullet' when 4 then 'upperRoman' when 5 then 'decimal' else 'upperLetter' end as fmt from (select distinct cast(floor(l_orderkey / 50) as bigint) as file_id from lineitem) f cross join nation where n_nationkey < 10
""",) * 2,
    "fx_records": (r"""
select case when event_id % 3 = 0 then 0 else 1 + user_id % greatest(50, cast(floor((select count(*) from events) / 1000) as bigint)) end as file_id, event_id * 10 as offset, case event_id % 7 when 0 then 6 when 1 then 519 when 2 then 60 when 3 then 515 when 4 then 6 when 5 then 513 else 519 end as rec_id, concat('A', event_id % 10) as h from events
""",) * 2,
    "fx_sections": (r"""
select file_id, min(offset) as start, concat('S', cast(floor(offset / 5000) as bigint)) as name from fx_records where rec_id <> 60 group by file_id, cast(floor(offset / 5000) as bigint)
""", r"""
select file_id, min("offset") as start, concat('S', cast(floor("offset" / 5000) as bigint)) as name from fx_records where rec_id <> 60 group by file_id, cast(floor("offset" / 5000) as bigint)
"""),
    "fx_pieces": (r"""
select conv_id as file_id, turn as piece_no, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as cp_start, text from conversations
""",) * 2,
    "fx_md": (r"""
select file_id, line_no, case line_no % 12 when 1 then concat('## ', text, ' ##') when 2 then '```py' when 3 then concat('code ', text) when 4 then '```' when 5 then concat('> ', text) when 6 then concat('- [', case when file_id % 2 = 0 then 'x' else ' ' end, '] ', text) when 7 then concat('see [a](https://x.example/', line_no, ') and ![b](img.png) `[no](https://n.example)`') when 8 then '***' when 9 then '' when 10 then text when 11 then '---' else '' end as text from fx_lines
""",) * 2,
    "fx_pages": (r"""
select page_id, concat(html, '<script type="module" src="./a', page_id % 5, '.js"></script><link rel="x" href="s.css"><script src="//cdn.example/z.js"></script><link href="i', page_id % 3, '.ico">') as html from pages
""",) * 2,
    "fx_assets": (r"""
select case when r_regionkey = 4 then 's.css' else concat('a', r_regionkey, '.js') end as path, 20000 + 15000 * r_regionkey as bytes from region
""",) * 2,
    "fx_hrefs": (r"""
select page_id, concat(case page_id % 6 when 0 then '' when 1 then 'HTTPS:' when 2 then ' mailto:' when 3 then 'javascript:' when 4 then '#' else 'ftp:' end, url) as url from pages
""",) * 2,
    "fx_opens": (r"""
select user_id, event_id as generation, ts from events
""",) * 2,
}

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a Spark frame; ``h`` columns of whole files become ``content``."""
    wanted, seen = [name], []
    while wanted:
        one = wanted.pop()
        if one in FIXTURES and one not in seen:
            seen.insert(0, one)
            wanted += [x for x in FIXTURES if x != one and x in FIXTURES[one][0].replace(",", " ").replace(")", " ").split()]
    text = " ".join(FIXTURES[x][0] for x in seen)
    for t in TABLES:
        if t in text.replace(",", " ").replace(")", " ").split():
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    ctes = ", ".join(f"{x} as ({FIXTURES[x][0]})" for x in seen)
    return spark.sql(f"with {ctes} select * from {name}")


def with_fixtures(sql: str, *names: str) -> str:
    """DuckDB SQL with the fixtures as common table expressions before it."""
    order = []
    for n in names:
        if n in ("fx_md",) and "fx_lines" not in order:
            order.append("fx_lines")
        if n in ("fx_sections",) and "fx_records" not in order:
            order.append("fx_records")
        if n in ("fx_chunks",) and "fx_files" not in order:
            order.append("fx_files")
        if n not in order:
            order.append(n)
    ctes = ", ".join(f"{x} as ({FIXTURES[x][1]})" for x in order)
    return f"with {ctes}{',' if sql.startswith('~') else ''} {sql.lstrip('~')}"
