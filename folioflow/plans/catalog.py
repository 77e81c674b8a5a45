"""The engine's queries over the driver tables, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dates, text
from folioflow.operators import alignment, checks, chunking, frontmatter, naming, providers, records, voting
from folioflow.plans import views as V
from folioflow.plans.views import view
from folioflow.prompts import PROMPTS, VARIANTS
from folioflow.sinks import files as sinks
from folioflow.sinks import pdf
from folioflow.sources import files as sources
from folioflow.sources.listing import qualified
from folioflow.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
BUDGET = 300


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def dates_sql(t: str) -> str:
    iso = rf"regexp_extract_all({t}, '\b\d{{4}}-\d{{2}}-\d{{2}}\b')"
    turn = "list_transform({}, lambda h: split_part(replace(h, '/', '-'), '-', 3) || '-' || lpad(split_part(replace(h, '/', '-'), '-', 2), 2, '0') || '-' || lpad(split_part(replace(h, '/', '-'), '-', 1), 2, '0'))"
    dmy = turn.format(rf"regexp_extract_all({t}, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}\b')")
    return f"list_filter(list_concat({iso}, {dmy}), lambda d: cast(d[1:4] as int) between 1900 and 2100 and cast(d[6:7] as int) between 1 and 12 and cast(d[9:10] as int) between 1 and 31)"


# dates


@query(f"select doc_stem, page_number, array_to_string({dates_sql('transcription')}, ',') as found, len({dates_sql('transcription')}) as n from ({V.LINE_PAGES}) p")
def dates_in_text(spark, sf_dir):
    found = dates.dates_in_text(F.col("transcription"))
    return view(spark, sf_dir, V.LINE_PAGES).select("doc_stem", "page_number", F.array_join(found, ",").alias("found"), F.size(found).cast("long").alias("n"))


_NAME_DATE = r"coalesce(nullif(regexp_extract({0}, '\d{{4}}-\d{{2}}-\d{{2}}'), ''), replace(nullif(regexp_extract({0}, '\d{{4}}_\d{{2}}_\d{{2}}'), ''), '_', '-'), regexp_replace(nullif(regexp_extract({0}, '\d{{8}}'), ''), '(\d{{4}})(\d{{2}})(\d{{2}})', '\1-\2-\3'))"


@query(f"select o_orderkey, {_NAME_DATE.format('file_name')} as filename_date from ({V.ORDER_FILES}) f")
def filename_date(spark, sf_dir):
    return view(spark, sf_dir, V.ORDER_FILES).select("o_orderkey", dates.filename_date(F.col("file_name")).alias("filename_date"))


@query(f"select o_orderkey, case when field <> '' and field <> '0000-00-00' then ({dates_sql('field')})[1] end as normalized from ({V.DATE_FIELDS}) f")
def normalize_date(spark, sf_dir):
    return view(spark, sf_dir, V.DATE_FIELDS).select("o_orderkey", dates.normalize_date(F.col("field")).alias("normalized"))


@query(f"select doc_stem, page_number, list_min({dates_sql('transcription')}) as page_date from ({V.LINE_PAGES}) p")
def page_min_date(spark, sf_dir):
    return view(spark, sf_dir, V.LINE_PAGES).select("doc_stem", "page_number", voting.page_date(F.col("transcription")).alias("page_date"))


_PAGE_DATES = f"select doc_stem, page_number, list_min({dates_sql('transcription')}) as d from ({V.LINE_PAGES}) p"


@query(f"select doc_stem, d as date, count(*) as n, min(page_number) as first_page from ({_PAGE_DATES}) x where d is not null group by all")
def date_histogram(spark, sf_dir):
    pages = view(spark, sf_dir, V.LINE_PAGES)
    return voting.date_histogram(pages.withColumn("page_date", voting.page_date(F.col("transcription"))))


def vote_sql(pages: str, exclude: bool = False, override: bool = False) -> str:
    kept = f"list_filter({dates_sql('transcription')}, lambda d: e.known_date is null or d <> e.known_date)" if exclude else dates_sql("transcription")
    other = f"left join ({V.ORDER_DATES}) e using (doc_stem)" if exclude else ""
    names = f"left join ({V.ORDER_DATES}) f using (doc_stem)" if override else ""
    chosen = "case when f.known_date in (select date from v2 where v2.doc_stem = docs.doc_stem) then f.known_date else w.date end" if override else "w.date"
    return f"""
    with p as ({pages}),
    d as (select doc_stem, page_number, list_min({kept}) as seen, nullif(exam_date, '') as stated from p {other}),
    has as (select doc_stem, count(seen) > 0 as any_seen from d group by all),
    v as (select doc_stem, page_number, case when any_seen then seen else stated end as date from d join has using (doc_stem)),
    v2 as (select doc_stem, date, count(*) as n, min(page_number) as first_page from v where date is not null group by all),
    w as (select doc_stem, date from v2 qualify row_number() over (partition by doc_stem order by n desc, first_page) = 1),
    docs as (select distinct doc_stem from p)
    select doc_stem, {chosen} as document_date from docs left join w using (doc_stem) {names}
    """


@query(vote_sql(V.LINE_PAGES))
def doc_date_vote(spark, sf_dir):
    return voting.elect_date(view(spark, sf_dir, V.LINE_PAGES))


@query(vote_sql(V.LINE_PAGES, exclude=True))
def doc_date_vote_excluding(spark, sf_dir):
    return voting.elect_date(view(spark, sf_dir, V.LINE_PAGES), view(spark, sf_dir, V.ORDER_DATES).withColumnRenamed("known_date", "birth_date"))


@query(vote_sql(V.LINE_PAGES, override=True))
def doc_date_vote_override(spark, sf_dir):
    return voting.elect_date(view(spark, sf_dir, V.LINE_PAGES), None, view(spark, sf_dir, V.ORDER_DATES).withColumnRenamed("known_date", "filename_date"))


@query(vote_sql(V.DATELESS_PAGES, exclude=True, override=True))
def doc_date_fallback(spark, sf_dir):
    known = view(spark, sf_dir, V.ORDER_DATES)
    return voting.elect_date(view(spark, sf_dir, V.DATELESS_PAGES), known.withColumnRenamed("known_date", "birth_date"), known.withColumnRenamed("known_date", "filename_date"))


@query(f"select p.doc_stem, page_number, coalesce(document_date, exam_date) as exam_date from ({V.DATELESS_PAGES}) p left join ({vote_sql(V.DATELESS_PAGES)}) w on p.doc_stem = w.doc_stem")
def date_write_back(spark, sf_dir):
    pages = view(spark, sf_dir, V.DATELESS_PAGES)
    return voting.write_back(pages, voting.elect_date(pages)).select("doc_stem", "page_number", "exam_date")


# documents


@query("select page_id, url from pages where regexp_matches(url, '^(?:https?://(www|m)\\.)')")
def manifest_regex_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^(?:https?://(www|m)\.)")).select("page_id", "url")


@query("select p_partkey, p_name from part where lower(p_name) || '.pdf' = 'red widget.pdf' or lower(p_name) = 'red widget'")
def document_selector(spark, sf_dir):
    named = table(spark, sf_dir, "part").withColumn("file_name", F.concat(F.initcap("p_name"), F.lit(".PDF")))
    return records.matching(named, "Red Widget.pdf").select("p_partkey", "p_name")


@query("select doc_id as doc_stem, lang, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def unprocessed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc_stem")
    return records.unprocessed(docs, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc_stem")).select("doc_stem", "lang", "source")


_GATED = "select d.doc_id as doc_stem, lang, n_chars, coalesce(quality, 1) = 1 as is_exam, quality is null as failed from documents d left join labels l on d.doc_id = l.doc_id"


def _gated(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("doc_stem"), "lang", "n_chars", (F.coalesce("quality", F.lit(1)) == 1).alias("is_exam"), F.col("quality").isNull().alias("failed"))


@query(f"select doc_stem, lang from ({_GATED}) g where is_exam")
def exam_gate(spark, sf_dir):
    return records.gate(_gated(spark, sf_dir))[0].select("doc_stem", "lang")


@query(f"select status, count(*) as documents, sum(pages) as pages from (select case when failed then 'failed' when is_exam then 'processed' else 'skipped' end as status, case when is_exam and not failed then n_chars // 1000 else 0 end as pages from ({_GATED}) g) s group by all")
def status_rollup(spark, sf_dir):
    status = F.when(F.col("failed"), "failed").when(F.col("is_exam"), "processed").otherwise("skipped")
    pages = F.when(F.col("is_exam") & ~F.col("failed"), F.floor(F.col("n_chars") / 1000)).otherwise(0)
    return checks.roll_up(_gated(spark, sf_dir).select("doc_stem", status.alias("status"), pages.alias("pages")))


_FALLBACK = f"select conv_id, doc_stem, coalesce(nullif(exam_name_raw, ''), doc_stem) as exam_name_raw, coalesce(nullif(exam_date, ''), {_NAME_DATE.format('doc_stem')}) as exam_date, facility_name, physician_name, department from ({V.CHAT_DOCUMENTS}) c"


@query(_FALLBACK)
def document_fallbacks(spark, sf_dir):
    return records.with_fallbacks(view(spark, sf_dir, V.CHAT_DOCUMENTS))


@query(f"select c.conv_id, turn, d.doc_stem, d.exam_name_raw, d.exam_date, d.facility_name, d.physician_name, d.department from conversations c join ({_FALLBACK}) d on c.conv_id = d.conv_id")
def broadcast_doc_metadata(spark, sf_dir):
    docs = records.with_fallbacks(view(spark, sf_dir, V.CHAT_DOCUMENTS))
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn").join(docs.select("conv_id", "doc_stem"), "conv_id")
    return records.attach_metadata(pages, docs)


@query(f"select doc_stem, page_number, transcription, exam_name_raw, exam_date from ({V.CHATS}) c qualify row_number() over (partition by doc_stem order by page_number) = 1")
def first_page_record(spark, sf_dir):
    return records.first_pages(view(spark, sf_dir, V.CHATS).select("doc_stem", "page_number", "transcription", "exam_name_raw", "exam_date"))


# names

_KEYED = f"select distinct exam_name_raw, {strip_sql('lower(exam_name_raw)')} as cache_key from ({V.NAMES}) n"


def _names(spark, sf_dir):
    return view(spark, sf_dir, V.NAMES), view(spark, sf_dir, V.NAME_CACHE)


@query(f"select exam_name_raw from ({_KEYED}) k where cache_key not in (select cache_key from ({V.NAME_CACHE}) c)")
def uncached_names(spark, sf_dir):
    return naming.uncached(*_names(spark, sf_dir))


@query(f"select exam_name_raw from ({_KEYED}) k where cache_key in (select cache_key from ({V.NAME_CACHE}) c)")
def cached_names(spark, sf_dir):
    return naming.cached(*_names(spark, sf_dir))


_LOOKED_UP = f"select exam_name_raw, coalesce(c.exam_type, 'other') as exam_type, coalesce(c.standardized_name, exam_name_raw) as standardized_name from ({_KEYED}) k left join ({V.NAME_CACHE}) c using (cache_key)"


@query(_LOOKED_UP)
def name_lookup_default(spark, sf_dir):
    return naming.look_up(*_names(spark, sf_dir))


@query(f"select p_partkey, exam_name_raw, exam_type, standardized_name as exam_name_standardized from ({V.NAMES}) n join ({_LOOKED_UP}) m using (exam_name_raw)")
def attach_standard_names(spark, sf_dir):
    names, cache = _names(spark, sf_dir)
    return naming.attach(names, naming.look_up(names, cache)).select("p_partkey", "exam_name_raw", "exam_type", "exam_name_standardized")


#: Names with an error each: a letter left out, one doubled, two exchanged, or too many to be near anything.
_MISSPELLED = "case p_partkey % 4 when 0 then left(n, 4) || substring(n, 6, 200) when 1 then left(n, 6) || substring(n, 6, 200) when 2 then left(n, 2) || substring(n, 4, 1) || substring(n, 3, 1) || substring(n, 5, 200) else substring(n, 9, 200) || 'zzzz' end"
_ERRING = f"select p_partkey, {_MISSPELLED} as exam_name_raw from (select p_partkey, p_type as n from part) p"
_SPELLED = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""
with a as (select exam_name_raw, {_SPELLED.format("exam_name_raw")} as a from (select distinct exam_name_raw from ({_ERRING}) e) x), b as (select *, {_SPELLED.format("cache_key")} as b from ({V.NAME_CACHE}) c)
select exam_name_raw, cache_key, cast(levenshtein(a, b) as int) as distance, exam_type, standardized_name from a, b
where levenshtein(a, b) <= cast(floor(greatest(length(a), length(b)) * 0.2::double) as int) qualify row_number() over (partition by exam_name_raw order by levenshtein(a, b), cache_key) = 1
""")
def nearest_names(spark, sf_dir):
    """Misspelled names and the known names that they are nearest to; those too far from all stay out."""
    return naming.nearest(view(spark, sf_dir, _ERRING), view(spark, sf_dir, V.NAME_CACHE))


@query(f"select (k - 1) // 50 as batch, to_json(list(exam_name_raw order by exam_name_raw)) as names from (select exam_name_raw, row_number() over (order by exam_name_raw) as k from (select distinct exam_name_raw from ({_KEYED}) x) d) n group by all")
def names_json(spark, sf_dir):
    return chunking.names_json(_names(spark, sf_dir)[0])


# text


@query(f"select doc_id, length(text) // 4 as tokens from documents where {strip_sql('text')} <> ''")
def token_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(~text.is_blank(F.col("text"))).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(f"select doc_id, n_chars from documents where {strip_sql('text')} <> ''")
def nonblank_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "transcription")
    return chunking.with_content(docs).select("doc_id", "n_chars")


@query(f"select doc_id, n_chars from documents where length({strip_sql('text')}) < 20")
def short_text_reject(spark, sf_dir):
    return providers.rejected(table(spark, sf_dir, "documents").withColumnRenamed("text", "transcription")).select("doc_id", "n_chars")


def fences_sql(c: str) -> str:
    rest = f"string_split({c}, chr(10))[2:]"
    return f"case when starts_with({c}, '```') then {strip_sql(f'''array_to_string(case when {strip_sql(f'({rest})[-1]')} = '```' then ({rest})[:-2] else {rest} end, chr(10))''')} else {c} end"


@query(f"select conv_id, turn, {fences_sql('reply')} as plain from ({V.FENCED}) f")
def strip_fences(spark, sf_dir):
    return view(spark, sf_dir, V.FENCED).select("conv_id", "turn", text.strip_fences(F.col("reply")).alias("plain"))


@query(f"select event_id, case when json_valid({fences_sql('reply')}) then cast(json_extract({fences_sql('reply')}, '$.k') as bigint) end as k from ({V.JSON_REPLIES}) r")
def lenient_json(spark, sf_dir):
    return view(spark, sf_dir, V.JSON_REPLIES).select("event_id", text.lenient_json(F.col("reply"), "k long").getField("k").alias("k"))


@query(f"select conv_id, turn, case when starts_with(s, '{{') and json_valid(s) then coalesce(json_extract_string(s, '$.transcription'), s) else s end as plain from (select conv_id, turn, {strip_sql('reply')} as s from ({V.WRAPPED}) w) x")
def unwrap_json_text(spark, sf_dir):
    return view(spark, sf_dir, V.WRAPPED).select("conv_id", "turn", text.unwrap_json(F.col("reply")).alias("plain"))


@query("select page_id, 'data:image/jpeg;base64,' || base64(encode(html)) as url from pages")
def image_data_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.data_url(F.encode("html", "utf-8")).alias("url"))


@query("select p_partkey, case when greatest(w, h) <= 1000 then w else cast(floor(w * (1000.0::double / greatest(w, h))) as int) end as width, case when greatest(w, h) <= 1000 then h else cast(floor(h * (1000.0::double / greatest(w, h))) as int) end as height from (select p_partkey, cast(p_size * 50 + 1 as int) as w, cast(p_partkey * 3 + 7 as int) as h from part) s")
def image_preprocess_dims(spark, sf_dir):
    size = text.image_size((F.col("p_size") * 50 + 1).cast("int"), (F.col("p_partkey") * 3 + 7).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("select conv_id, turn, 'c' || cast(conv_id as string) || '.' || case when turn * 300 < 100 then lpad(cast(turn * 300 as string), 3, '0') else cast(turn * 300 as string) end || '.md' as file_name, turn * 300 as page_number from conversations")
def page_filename(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("stem"))
    named = rows.withColumn("file_name", text.page_file(F.col("stem"), (F.col("turn") * 300).cast("int")))
    return named.select("conv_id", "turn", "file_name", text.page_number(F.col("file_name")).cast("long").alias("page_number"))


@query(f"select doc_stem, turn, file_name, try_cast(split_part(file_name, '.', 2) as int) as page_number from ({V.FILES}) f where not ends_with(file_name, '.summary.md') and try_cast(split_part(file_name, '.', 2) as int) is not null")
def valid_page_files(spark, sf_dir):
    found = view(spark, sf_dir, V.FILES).withColumn("page_number", text.page_number(F.col("file_name")))
    return found.where(~F.col("file_name").endswith(".summary.md") & F.col("page_number").isNotNull()).select("doc_stem", "turn", "file_name", "page_number")


@query("select conv_id, turn, 'Turn ' || cast(turn as string) || ' of ' || role || ': ' || text as prompt from conversations")
def prompt_template(spark, sf_dir):
    filled = text.template("Turn {turn} of {role}: {text}", turn=F.col("turn").cast("string"), role=F.col("role"), text=F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", filled.alias("prompt"))


# prompts and chunks

_NAME = "coalesce(nullif(exam_name_standardized, ''), exam_name_raw)"


def list_row_sql(i: str) -> str:
    return f"{i} || '. ' || {_NAME} || ' [' || coalesce(exam_type, 'None') || ']' || case when coalesce(exam_date, '') <> '' then ' (' || exam_date || ')' else '' end"


def text_row_sql(i: str) -> str:
    return f"'--- EXAM ' || {i} || ': ' || {_NAME} || ' (Page ' || cast(page_number as string) || ') ---' || chr(10) || {strip_sql('transcription')}"


_COST = f"length({list_row_sql(chr(39) + '1' + chr(39))} || {text_row_sql(chr(39) + '1' + chr(39))}) // 4"


def chunks_sql(pages: str, budget: int) -> str:
    return f"""
with recursive p as (select doc_stem, page_number, {_COST} as cost, row_number() over (partition by doc_stem order by page_number) as k from ({pages}) c),
w as (
  select doc_stem, page_number, cost, k, 0 as chunk_idx, not (cost > {budget}) as open, case when cost > {budget} then 0 else cost end as used from p where k = 1
  union all
  select p.doc_stem, p.page_number, p.cost, p.k,
         case when w.open and w.used + p.cost > {budget} then w.chunk_idx + 1 when not w.open then w.chunk_idx + 1 else w.chunk_idx end,
         not (not w.open and p.cost > {budget}),
         case when not w.open and p.cost > {budget} then 0 when w.open and w.used + p.cost > {budget} then p.cost when not w.open then p.cost else w.used + p.cost end
  from w join p on p.doc_stem = w.doc_stem and p.k = w.k + 1)
select doc_stem, cast(page_number as bigint) as page_number, cost, cast(chunk_idx as int) as chunk_idx from w
"""


_CHUNKS = chunks_sql(V.CHATS, BUDGET)


@query(_CHUNKS)
def chunk_assignment(spark, sf_dir):
    return chunking.assign_chunks(view(spark, sf_dir, V.CHATS), BUDGET)


@query(f"select doc_stem, string_agg({list_row_sql('cast(i as string)')}, chr(10) order by i) as exam_list from (select *, row_number() over (partition by doc_stem order by page_number) as i from ({V.CHATS}) c) n group by all")
def exam_list_render(spark, sf_dir):
    return chunking.exam_lists(view(spark, sf_dir, V.CHATS), ["doc_stem"])


@query(f"select doc_stem, string_agg({text_row_sql('cast(i as string)')}, chr(10) || chr(10) order by i) as transcriptions from (select *, row_number() over (partition by doc_stem order by page_number) as i from ({V.CHATS}) c) n group by all")
def transcription_render(spark, sf_dir):
    return chunking.transcriptions(view(spark, sf_dir, V.CHATS), ["doc_stem"])


# samples

_SAMPLES = "select user_id % 50 as doc_stem, cast(event_id % 40 as int) as page_number, cast(event_id as int) as sample_idx, case when event_id % 40 < 10 then 'same' else event_type end as text from events"


@query(f"select doc_stem, page_number, count(distinct text) = 1 as agreed from ({_SAMPLES}) s group by all")
def unanimity(spark, sf_dir):
    grouped = view(spark, sf_dir, _SAMPLES).groupBy("doc_stem", "page_number").agg(F.collect_list("text").alias("s"))
    return grouped.select("doc_stem", "page_number", voting.unanimous(F.col("s")).alias("agreed"))


@query(f"""
select doc_stem, page_number, text, sum(n) over w as n_samples, count(*) over w = 1 as agreed
from (select doc_stem, page_number, text, cast(count(*) as bigint) as n, min(sample_idx) as f from ({_SAMPLES}) s group by all) c
window w as (partition by doc_stem, page_number) qualify row_number() over (partition by doc_stem, page_number order by n desc, f) = 1
""")
def sample_vote(spark, sf_dir):
    return providers.native_vote(view(spark, sf_dir, _SAMPLES))


def _erring(spark, sf_dir):
    """Turns of six words or more in four samples: the text, one with another word, one without a word, one with another word, each elsewhere."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_stem"), F.col("turn").cast("int").alias("page_number"), "conv_id", words.alias("words")).where(F.size("words") >= 6)
    place = lambda k: F.col("conv_id").cast("int") % F.size("words") if not k else (F.col("conv_id").cast("int") + k) % F.size("words")
    other = lambda at, word: F.transform("words", lambda w, i: F.when(i == at, F.lit(word)).otherwise(w))
    texts = [F.col("words"), other(place(0), "qqa"), F.filter("words", lambda w, i: i != place(2)), other(place(4), "qqb")]
    samples = F.array(*(F.struct(F.lit(k).alias("sample_idx"), F.array_join(t, " ").alias("text")) for k, t in enumerate(texts)))
    return turns.select("doc_stem", "page_number", F.inline(samples))


_WEIGHT = f"case when regexp_matches({{0}}, '[0-9]') or list_contains({list(alignment.UNITS)}, regexp_replace(lower({{0}}), '^[^\\w%]+|[^\\w%]+$', '', 'g')) then {alignment.CRITICAL} else {alignment.OTHER} end"
_CERTAINTY = """
with w as (select cast(conv_id as string) as doc_stem, cast(turn as int) as page_number, conv_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as words from conversations),
k as (select *, len(words) as n, list_transform(words, lambda x: {weight}) as weights from w where len(words) >= 6),
e as (select *, [weights[1 + conv_id % n], weights[1 + (conv_id + 2) % n], weights[1 + (conv_id + 4) % n]] as errors from k),
s as (select *, (list_sum(errors) / 4.0::double) / list_sum(weights) as share, list_max(errors) > {other} as touched from e),
c as (select *, case when share <= 0.1 then 0.9 - 2 * share when share <= 0.3 then 0.7 - 1.5 * (share - 0.1) when share <= 0.6 then 0.4 - (share - 0.3) else 0.1 - 0.25 * (share - 0.6) end as value from s)
select doc_stem, page_number, array_to_string(words, ' ') as transcription, round(case when touched then least(value, 0.6) else value end, 6) as transcription_confidence from c
""".format(weight=_WEIGHT.format("x"), other=alignment.OTHER)


@query(_CERTAINTY)
def aligned_vote(spark, sf_dir):
    """Samples that differ, merged place by place, and the confidence of the result."""
    found = alignment.merged(_erring(spark, sf_dir))
    return found.withColumn("transcription_confidence", F.round("transcription_confidence", 6))


@query(f"select *, '{VARIANTS[0]}' as prompt_variant, 1 as retry_attempts from ({_CERTAINTY}) c")
def stub_votes_and_scores(spark, sf_dir):
    """The same through a provider, which is asked for the vote and for the score of pages whose samples differ."""
    found = providers.self_consistent(_erring(spark, sf_dir), providers.StubProvider)
    return found.withColumn("transcription_confidence", F.round("transcription_confidence", 6))


@query("select event_id, case when try_cast(reply as double) is null then 0.5::double else greatest(0.0::double, least(1.0::double, try_cast(reply as double))) end as confidence from (select event_id, case event_id % 4 when 0 then 'n/a' when 1 then cast(-1 as string) when 2 then '0.25' else '7' end as reply from events) e")
def confidence_clamp(spark, sf_dir):
    k = F.col("event_id") % 4
    reply = F.when(k == 0, "n/a").when(k == 1, "-1").when(k == 2, "0.25").otherwise("7")
    return table(spark, sf_dir, "events").select("event_id", text.confidence(reply).alias("confidence"))


# frontmatter

_FRONT = ", ".join(f"nullif({f}, '') as {k}" for f, k in frontmatter.FRONTMATTER_KEYS)


@query(f"select doc_stem, {_FRONT}, nullif(page_number, 0) as page, nullif(source_file, '') as source, nullif(prompt_variant, '') as prompt_variant, transcription_confidence as confidence, case when retry_attempts > 1 then retry_attempts end as retry_attempts from ({V.CHATS}) c")
def frontmatter_project(spark, sf_dir):
    return view(spark, sf_dir, V.CHATS).select("doc_stem", frontmatter.to_frontmatter().alias("h")).select("doc_stem", "h.*")


@query(f"select doc_stem, {', '.join(f'nullif({f}, chr(32)) as {f}' for f, _ in frontmatter.FRONTMATTER_KEYS).replace('chr(32)', chr(39) * 2)}, transcription_confidence, transcription, coalesce(nullif(page_number, 0), -1) as page_number, source_file from ({V.CHATS}) c")
def frontmatter_invert(spark, sf_dir):
    headed = view(spark, sf_dir, V.CHATS).select("doc_stem", frontmatter.to_frontmatter().alias("h"), "transcription")
    return headed.select("doc_stem", *frontmatter.from_frontmatter(F.col("h"), F.col("transcription"), F.lit(-1), F.lit("none.pdf")))


_SPLIT = f"""
select conv_id, turn, case when has then {strip_sql('t[4:e - 1]')} else '' end as header, case when has then {strip_sql('t[e + 3:]')} else t end as body
from (select *, starts_with(t, '---') and rel > 0 as has, rel + 3 as e from (select conv_id, turn, t, strpos(t[4:], '---') as rel from (select conv_id, turn, {strip_sql('content')} as t from ({V.HEADED}) h) a) b) c
"""


@query(_SPLIT)
def frontmatter_split(spark, sf_dir):
    return view(spark, sf_dir, V.HEADED).select("conv_id", "turn", text.frontmatter_split(F.col("content")).alias("s")).select("conv_id", "turn", "s.header", "s.body")


# checks

_KEYS = "select conv_id, list(distinct case turn % 4 when 0 then 'title' when 1 then 'category' when 2 then 'page' else 'exam_date' end) as present from conversations group by all"


@query(f"select conv_id, array_to_string(list_sort(list_filter(['category', 'exam_date', 'title'], lambda k: not list_contains(present, k))), ',') as missing from ({_KEYS}) k")
def missing_required_fields(spark, sf_dir):
    k = F.col("turn") % 4
    key = F.when(k == 0, "title").when(k == 1, "category").when(k == 2, "page").otherwise("exam_date")
    present = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(key).alias("present"))
    return present.select("conv_id", F.array_join(checks.missing_keys(F.col("present")), ",").alias("missing"))


def _outputs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("conv_id % 7 > 0").select(F.col("conv_id").alias("doc_stem"), "turn", "role")
    manifest = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_stem")).distinct()
    return manifest, turns.where("role = 'user' and doc_stem % 5 > 0"), turns.where("role = 'assistant'"), turns.where("turn = 4").select("doc_stem")


_OUT = """
m as (select distinct conv_id as doc_stem from conversations), t as (select conv_id as doc_stem, turn, role from conversations where conv_id % 7 > 0),
i as (select doc_stem, count(*) as images from t where role = 'user' and doc_stem % 5 > 0 group by all), p as (select doc_stem, count(*) as pages from t where role = 'assistant' group by all),
s as (select distinct doc_stem, true as summary from t where turn = 4)
"""


@query(f"""
with {_OUT}, j as (select * from m left join i using (doc_stem) left join p using (doc_stem) left join s using (doc_stem)),
k as (select *, images is null and pages is null and summary is null as none, coalesce(images, 0) as ni, coalesce(pages, 0) as np from j)
select doc_stem, 'missing_folder' as issue, '' as detail from k where none
union all select doc_stem, 'missing_images', '' from k where not none and ni = 0
union all select doc_stem, 'count_mismatch', cast(ni as string) || ' images, ' || cast(np as string) || ' transcriptions' from k where ni > 0 and ni <> np
union all select doc_stem, 'missing_summary', '' from k where not none and summary is null
""")
def reconcile_outputs(spark, sf_dir):
    return checks.reconcile(*_outputs(spark, sf_dir))


@query(f"with {_OUT} select doc_stem, images, coalesce(pages, 0) as pages from i left join p using (doc_stem) where images <> coalesce(pages, 0)")
def completeness_gate(spark, sf_dir):
    _, images, pages, _ = _outputs(spark, sf_dir)
    return checks.incomplete(images, pages)


# model-backed operators, with the stub; and what SQL cannot say


def _chat_images(spark, sf_dir):
    chats = view(spark, sf_dir, V.CHATS)
    refuse = F.when(F.col("page_number") % 3 == 1, F.concat(F.lit("REFUSE"), F.col("transcription"))).otherwise(F.col("transcription"))
    return chats.select(F.col("doc_stem").cast("string").alias("doc_stem"), "page_number", F.encode(refuse, "utf-8").alias("image"))


def yaml_line(key: str, value: str, given: str) -> str:
    return f"case when {given} then '{key}: ' || {value} || chr(10) else '' end"


_YAML = " || ".join(
    [yaml_line("exam_date", "chr(39) || exam_date || chr(39)", "coalesce(exam_date, '') <> ''")]
    + [yaml_line(k, f, f"coalesce({f}, '') <> ''") for f, k in frontmatter.FRONTMATTER_KEYS[1:]]
    + [yaml_line("page", "cast(page_number as varchar)", "page_number <> 0"), yaml_line("source", "source_file", "source_file <> ''"), yaml_line("prompt_variant", "prompt_variant", "coalesce(prompt_variant, '') <> ''")]
    + [yaml_line("confidence", "cast(transcription_confidence as varchar)", "transcription_confidence is not null"), yaml_line("retry_attempts", "cast(retry_attempts as varchar)", "retry_attempts > 1")]
)


@query(f"select doc_stem, page_number, '---' || chr(10) || {_YAML} || '---' || chr(10) || chr(10) || {strip_sql('transcription')} || chr(10) as file from ({V.CHATS}) c")
def yaml_render(spark, sf_dir):
    return view(spark, sf_dir, V.CHATS).select("doc_stem", "page_number", frontmatter.markdown(frontmatter.to_frontmatter(), F.array("transcription")).alias("file"))


@query("select conv_id, turn, " + ", ".join(f"nullif(regexp_extract(header, '(?m)^{k}: (.*)$', 1), '') as {k}" for k in ("title", "category", "exam_date")) + f", body from ({_SPLIT}) s")
def frontmatter_parse(spark, sf_dir):
    return frontmatter.parsed(view(spark, sf_dir, V.HEADED)).select("conv_id", "turn", "header.title", "header.category", "header.exam_date", "body")


_IMAGES = f"select cast(doc_stem as string) as doc_stem, page_number, case when page_number % 3 = 1 then 'REFUSE' else '' end || transcription as image, {strip_sql('transcription')} as t from ({V.CHATS}) c"
_WHOLE = f"select doc_stem, string_agg(image, chr(10) order by page_number) as t from ({_IMAGES}) i group by doc_stem"


@query(f"""
select doc_stem, not regexp_matches(lower(t), '\\b(invoice|fatura)\\b') as is_exam, left(list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')[1], 60) as exam_name_raw,
       nullif(regexp_extract(t, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') as exam_date, null as facility_name, null as physician_name, null as department from ({_WHOLE}) w
""")
def stub_classify(spark, sf_dir):
    return providers.classify(_chat_images(spark, sf_dir), providers.StubProvider)


@query(f"""
with p as (select doc_stem, page_number, t, length(t) >= 20 and not starts_with(lower(t), 'i cannot') as good, page_number % 3 = 1 as refused from ({_IMAGES}) i)
select doc_stem, page_number, t as transcription, cast(null as double) as transcription_confidence,
       case when not good then '{VARIANTS[3]}' when refused then '{VARIANTS[1]}' else '{VARIANTS[0]}' end as prompt_variant, case when not good then 4 when refused then 2 else 1 end as retry_attempts from p
""")
def stub_transcribe_retry(spark, sf_dir):
    return providers.transcribe(_chat_images(spark, sf_dir), providers.StubProvider)


@query(f"""
select doc_stem, page_number, case when page_number % 3 = 1 then 'I cannot help with this document, sorry.' else t end as transcription, 1.0 as transcription_confidence, '{VARIANTS[0]}' as prompt_variant, 1 as retry_attempts from ({_IMAGES}) i
""")
def stub_self_consistency(spark, sf_dir):
    return providers.self_consistent(providers.sample(_chat_images(spark, sf_dir), providers.StubProvider, 3), providers.StubProvider)


_KIND = f"case {' '.join(f'when list_has_any(w, {list(words)}) then {k!r}' for k, words in providers.KEYWORDS)} else 'other' end"
_TITLE = f"array_to_string(list_transform(string_split_regex({strip_sql('n')}, '\\s+'), lambda x: upper(x[1]) || lower(x[2:])), ' ')"


@query(f"""
with k as ({_KEYED}), c as ({V.NAME_CACHE}), asked as (select cache_key, max(exam_name_raw) as n from k where cache_key not in (select cache_key from c) group by all),
answers as (select cache_key, {_KIND} as exam_type, {_TITLE} as standardized_name from (select *, regexp_extract_all(lower(n), '[a-z-]+') as w from asked) a)
select exam_name_raw, coalesce(c.exam_type, a.exam_type) as exam_type, coalesce(c.standardized_name, a.standardized_name) as standardized_name from k left join c using (cache_key) left join answers a using (cache_key)
""")
def stub_standardize(spark, sf_dir):
    names, cache = _names(spark, sf_dir)
    return naming.look_up(names, naming.merge(cache, providers.standardize(naming.uncached(names, cache), providers.StubProvider)))


_FOLD_TOKENS = 3000
_FULL = f"select * from ({V.CHATS}) h where {strip_sql('transcription')} <> ''"


def _prompt_sql(name: str) -> str:
    """The template as a concatenation of its parts and columns."""
    parts = re.split(r"\{(\w+)\}", PROMPTS[name])
    return " || ".join((f"cast({p} as varchar)" if k % 2 else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") for k, p in enumerate(parts) if p)


@query(f"""
with recursive c as (select * from ({chunks_sql(_FULL, chunking.chunk_budget(_FOLD_TOKENS, PROMPTS['summary_system']))}) x),
g as (select h.*, c.chunk_idx, row_number() over (partition by h.doc_stem, c.chunk_idx order by h.page_number) as i from ({_FULL}) h join c on c.doc_stem = h.doc_stem and c.page_number = h.page_number),
t as (select doc_stem, chunk_idx, count(*) as n, string_agg({list_row_sql('cast(i as string)')}, chr(10) order by i) as exam_list, string_agg({text_row_sql('cast(i as string)')}, chr(10) || chr(10) order by i) as transcriptions from g group by all),
f as (select doc_stem, chunk_idx, 'Summary ' || left(sha256({_prompt_sql('summary_first')}), 16) as summary from t where chunk_idx = 0
  union all select t.doc_stem, t.chunk_idx, 'Summary ' || left(sha256({_prompt_sql('summary_next')}), 16) from f join t on t.doc_stem = f.doc_stem and t.chunk_idx = f.chunk_idx + 1)
select cast(doc_stem as string) as doc_stem, summary from f qualify row_number() over (partition by doc_stem order by chunk_idx desc) = 1
""")
def stub_summary_fold(spark, sf_dir):
    chats, folder = view(spark, sf_dir, V.CHATS).withColumn("doc_stem", F.col("doc_stem").cast("string")), scratch(spark, "fold")

    def stage(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return providers.summarize(chats, providers.StubProvider, stage, max_input_tokens=_FOLD_TOKENS)


@query("select conv_id as doc_stem, cast(turn as int) as page_number, case when turn = conv_id % 4 then 'again ' || role else role end as transcription from conversations")
def page_taken_again(spark, sf_dir):
    """One page of every document processed again takes its place among the stored ones."""
    stored = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_stem"), F.col("turn").cast("int").alias("page_number"), F.col("role").alias("transcription"))
    new = stored.where("page_number = doc_stem % 4").withColumn("transcription", F.concat(F.lit("again "), "transcription"))
    return records.replaced(stored, new)


@query(f"with {_OUT} select t.doc_stem, t.turn from t left join i using (doc_stem) left join p using (doc_stem) where t.role = 'assistant' and (i.images is null or i.images = p.pages)")
def pages_to_summarise_again(spark, sf_dir):
    """Stored pages of the documents that have one for each image."""
    _, images, pages, _ = _outputs(spark, sf_dir)
    return checks.whole(images, pages).select("doc_stem", "turn")


# files: written by tasks, listed and read again


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one that all machines share, as a URI; a temporary one where none is set, in local mode. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    folder = qualified(spark, f"{base.rstrip('/')}/folioflow-catalog/{name}-{uuid.uuid4().hex[:12]}")
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Best effort at the end of the driver; by then the JVM may be gone."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@query(f"select doc_stem, page_number, md5(image) as digest from ({_IMAGES}) i")
def images_round_trip(spark, sf_dir):
    """Page images written, listed and read back by their numbers."""
    folder = scratch(spark, "images")
    sinks.write_files(sinks.image_files(_chat_images(spark, sf_dir)), folder)
    listed = sources.output_files(spark, folder).where("kind = 'image'")
    return sources.stored_images(listed).select("doc_stem", "page_number", F.md5("image").alias("digest"))


@query(f"select doc_stem, page_number, md5(image) as digest from ({_IMAGES}) i where page_number % 2 = 0")
def stale_images_removed(spark, sf_dir):
    """Images of pages that a new rendering lacks are deleted, the others stay."""
    folder, pages = scratch(spark, "stale"), _chat_images(spark, sf_dir)
    sinks.write_files(sinks.image_files(pages), folder)
    sinks.remove_stale_images(sources.output_files(spark, folder), pages.where("page_number % 2 = 0"))
    return sources.stored_images(sources.output_files(spark, folder).where("kind = 'image'")).select("doc_stem", "page_number", F.md5("image").alias("digest"))


@query(f"select doc_stem, cast(row_number() over (partition by doc_stem order by page_number) as int) as page_number, md5(image) as digest from ({_IMAGES}) i")
def rendered_pages(spark, sf_dir):
    """Documents written as source files, read by their listing and rendered: pages parted by form feeds, numbered from 1."""
    folder = scratch(spark, "sources")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "image"))), lambda x: x["image"].cast("string"))
    docs = _chat_images(spark, sf_dir).groupBy("doc_stem").agg(F.array_join(ordered, "\f").alias("content"))
    sinks.write_files(docs.withColumn("file_name", F.concat("doc_stem", F.lit(".pdf"))), folder)
    return sources.render(sources.contents(sources.manifest(spark, folder))).select("doc_stem", "page_number", F.md5("image").alias("digest"))


@query(f"select doc_stem, cast(row_number() over (partition by doc_stem order by page_number) as int) as page_number, md5(image) as digest from ({_IMAGES}) i")
def pdf_pages(spark, sf_dir):
    """Documents written as PDF, every second with compressed cross-references, listed, read and exploded to the images of their pages."""
    folder = scratch(spark, "pdf")
    sinks.write_files(pdf.documents(_chat_images(spark, sf_dir), F.col("doc_stem").cast("long") % 2 == 0), folder)
    return sources.render(sources.contents(sources.manifest(spark, folder))).select("doc_stem", "page_number", F.md5("image").alias("digest"))


@query(f"select cast(doc_stem as string) as doc_stem, page_number, nullif(exam_name_raw, '') as exam_name_raw, nullif(exam_date, '') as exam_date, nullif(exam_type, '') as exam_type, transcription_confidence, {strip_sql('transcription')} as transcription, source_file from ({V.CHATS}) c")
def page_files_round_trip(spark, sf_dir):
    """Page files with YAML headers written, listed, and read back as records."""
    folder = scratch(spark, "pages")
    sinks.write_files(sinks.page_files(view(spark, sf_dir, V.CHATS).withColumn("doc_stem", F.col("doc_stem").cast("string"))), folder)
    found = sources.stored_records(sources.output_files(spark, folder).where("kind = 'page'"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return found.select("doc_stem", "page_number", blank("exam_name_raw"), blank("exam_date"), blank("exam_type"), "transcription_confidence", "transcription", "source_file")


@query("select doc_id, lang, source, n_chars from documents where doc_id not in (select doc_id from labels)")
def incremental_stream(spark, sf_dir):
    """Documents arriving as a stream; those with a label have output already, the others are handled."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), scratch(spark, "stream")
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*").select(*docs.columns)
    docs.limit(0).write.parquet(f"{folder}/new/batch=-1")
    incremental.run_once_each(stream, "doc_id", f"{folder}/checkpoint", f"{folder}/new", lambda: table(spark, sf_dir, "labels").select("doc_id"))
    return spark.read.schema(docs.schema).parquet(f"{folder}/new").select(*docs.columns)
