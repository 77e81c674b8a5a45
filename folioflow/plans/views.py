"""Inputs of the catalogue: views of the driver tables as documents and pages.

Each is one SQL text that Spark and ANSI databases read alike, so that a query and its
oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def iso(d: str, dash: str = "-") -> str:
    return f"cast(year({d}) as string) || '{dash}' || lpad(cast(month({d}) as string), 2, '0') || '{dash}' || lpad(cast(day({d}) as string), 2, '0')"


def day_first(d: str, sep: str = "/") -> str:
    return f"cast(day({d}) as string) || '{sep}' || cast(month({d}) as string) || '{sep}' || cast(year({d}) as string)"


_Q = "date_trunc('quarter', l_shipdate)"

#: Line items as pages of their order; dates in both forms, coarse enough to repeat, and some that are none.
LINE_PAGES = f"""
select l_orderkey as doc_stem,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as int) as page_number,
       case l_partkey % 5 when 0 then 'no date on this page' when 1 then 'exam of ' || {iso(_Q)} || ', printed ' || {iso("l_shipdate")}
            when 2 then 'exame de ' || {day_first(_Q)} || ' e ' || {day_first("l_shipdate", "-")} when 3 then {iso(_Q)} || ' not 2024-13-01 nor 12/31/2024 nor 1/1/1899'
            else 'x' || {iso("l_shipdate")} || ' glued, ' || {day_first(_Q)} end as transcription,
       case when l_orderkey % 3 = 0 then {iso("l_shipdate")} when l_orderkey % 3 = 1 then '' end as exam_date
from lineitem
"""
#: The same pages with no date in the text of every second order.
DATELESS_PAGES = f"select doc_stem, page_number, case when doc_stem % 2 = 0 then 'nothing' else transcription end as transcription, exam_date from ({LINE_PAGES}) p"
#: A date for every second order, to be left out of its vote or preferred.
ORDER_DATES = f"select l_orderkey as doc_stem, {iso('date_trunc(' + chr(39) + 'quarter' + chr(39) + ', min(l_shipdate))')} as known_date from lineitem where l_orderkey % 2 = 0 group by l_orderkey"
ORDER_FILES = f"""
select o_orderkey, case o_orderkey % 5 when 0 then 'exam_' || {iso("o_orderdate")} || '.pdf' when 1 then {iso("o_orderdate", "_")} || '_scan.pdf' when 2 then 'x' || {iso("o_orderdate", "")} || '.pdf'
       when 3 then {iso("o_orderdate", "")} || '_' || {iso("o_orderdate + interval '40' day")} || '.pdf' else 'scan_' || cast(o_orderkey as string) || '.pdf' end as file_name
from orders
"""
DATE_FIELDS = f"select o_orderkey, case o_orderkey % 5 when 0 then '0000-00-00' when 1 then '' when 2 then {day_first('o_orderdate')} when 3 then 'on ' || {iso('o_orderdate')} else cast(null as string) end as field from orders"
#: Conversations as documents with metadata, and their turns as pages.
CHATS = """
select conv_id as doc_stem, cast(turn as int) as page_number, text as transcription, case when conv_id % 3 = 0 then '' else 'Exam ' || cast(conv_id as string) end as exam_name_raw,
       case when conv_id % 4 = 0 then 'Standard ' || cast(conv_id as string) when conv_id % 4 = 1 then '' end as exam_name_standardized,
       case when conv_id % 5 > 0 then '2024-0' || cast(1 + conv_id % 9 as string) || '-11' when conv_id % 2 = 0 then '' end as exam_date,
       case when conv_id % 2 = 0 then 'imaging' when conv_id % 3 = 0 then 'other' end as exam_type, case when turn % 3 = 0 then 'Dr ' || role else '' end as physician_name,
       'Facility ' || cast(conv_id % 7 as string) as facility_name, cast(null as string) as department, 'chat' || cast(conv_id as string) || '.pdf' as source_file,
       case when turn % 2 = 0 then 'transcription_system' end as prompt_variant, cast(case when turn % 4 = 1 then 0.0 when turn % 4 = 2 then 0.5 end as double) as transcription_confidence,
       cast(turn % 4 as int) as retry_attempts
from conversations
"""
CHAT_DOCUMENTS = """
select conv_id, 'chat' || cast(conv_id as string) || case when conv_id % 2 = 0 then '_2023-05-0' || cast(1 + conv_id % 9 as string) else '' end as doc_stem, case when conv_id % 3 = 0 then '' when conv_id % 3 = 1 then 'Exam ' || cast(conv_id as string) end as exam_name_raw,
       case when conv_id % 5 = 0 then '2022-01-01' when conv_id % 5 = 1 then '' end as exam_date, 'F' as facility_name, cast(null as string) as physician_name, 'D' as department
from (select distinct conv_id from conversations) c
"""
#: Names to standardize, in several spellings, and a cache that knows some of them.
NAMES = "select p_partkey, case p_partkey % 3 when 0 then p_type when 1 then '  ' || lower(p_type) else p_type || ' ' || cast(p_size % 4 as string) end as exam_name_raw from part"
NAME_CACHE = "select distinct lower(p_type) || case when p_size % 4 < 2 and p_partkey % 3 = 2 then ' ' || cast(p_size % 4 as string) else '' end as cache_key, 'imaging' as exam_type, 'Std ' || lower(p_type) as standardized_name from part where p_type like '%A%'"
FENCED = """
select conv_id, turn, case turn % 5 when 0 then '```json\n' || text || '\n```' when 1 then '```' || role || '```' when 2 then text when 3 then '```\n ' || text || '\n  ``` ' else '```\n' || text || '\n``` end' end as reply from conversations
"""
JSON_REPLIES = """
select event_id, case event_id % 5 when 0 then props when 1 then '```json\n' || props || '\n```' when 2 then substring(props, 1, 5) when 3 then '' else 'k = ' || props end as reply from events
"""
WRAPPED = """
select conv_id, turn, case turn % 4 when 0 then '{"transcription": "' || role || ' said"}' when 1 then '{"other": 1}' when 2 then '{broken ' || role else ' plain ' || role || ' ' end as reply from conversations
"""
HEADED = """
select conv_id, turn, case turn % 5 when 0 then '---\ntitle: T' || cast(conv_id as string) || '\ncategory: other\n---\n\n' || role || ' body' when 1 then ' --- \nexam_date: x\n--- rest ' || role when 2 then '---\nunclosed ' || role
       when 3 then 'no header --- ' || role else '---\ntitle: X--- y\n---\n' || role end as content from conversations
"""
FILES = """
select conv_id as doc_stem, turn, role, 'c' || cast(conv_id as string) || '.' || case when turn = 6 then 'summary' when turn = 5 then 'x1' else lpad(cast(turn as string), 3, '0') end || '.md' as file_name from conversations
"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = [t for t in TABLES if re.search(rf"\bfrom {t}\b", text)]
    marked = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        marked = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", marked)
    # The session reads backslashes in strings as ANSI databases do not; the texts hold real line ends only.
    return spark.sql(marked, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return _sql(spark, sf_dir, text)
