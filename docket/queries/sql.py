"""Oracle SQL (DuckDB dialect) per registered query key."""

from __future__ import annotations

from docket.config import FIXTURE_LEXICON as LEX
from docket.config import LEGAL_LEXICON as LEGAL
from docket.functions.extract import CITE_PLACEHOLDER
from docket.functions.text import term_pattern
from docket.operators.requests import PromptTemplate
from docket.queries.catalog import (
    BATCH_SIZE,
    DOCX_CORRUPT,
    LASTS,
    PLANT_ERR,
    PLANT_REL,
    PLANT_SUP,
    RENDER_MODELS,
    RETRY_CONFIG,
    SECOND_RUN,
    STARTS,
)
from docket.queries.oracle import (
    caption_sql,
    cases_source,
    clean,
    documents_source,
    features_sql,
    fields_sql,
    q,
    quote_rows_sql,
    sentences_sql,
)
from docket.queries.shapes import SHAPES, response_sql
from docket.sources.captions import expected_sql, references_sql
from docket.operators import boundaries as B
from docket.sources.lexical import ABRIDGED_DUCKDB_SQL, PLEADED_DUCKDB_SQL
from docket.schema import ANALYSIS_FIELDS, LIST_FIELDS, STRING_FIELDS

SPINE = """spine(relevance_level, support_level) as (
    select * from (values ('High'), ('Medium'), ('Low')) r(relevance_level),
                  (values ('Strongly Supports'), ('Supports'), ('Does not Support')) s(support_level))"""

RELEVANCE_SUPPORT_MATRIX = f"""
with {features_sql(documents_source())},
{SPINE},
counts as (select relevance_level, support_level, count(*) as n from feat group by all)
select spine.relevance_level, spine.support_level, coalesce(counts.n, 0)::bigint as n_cases
from spine left join counts using (relevance_level, support_level)
"""

CANDIDATE_FILTER = f"""
select doc_id, lpad(doc_id::varchar, 9, '0') || '.docx' as filename
from documents where regexp_matches(lower(text), {q(term_pattern(LEX.candidate_phrases))})
"""

CASE_CITATION = f"""
with c as ({cases_source()}),
{caption_sql('c', LEX)},
x as (select doc_id, cite from captioned)
select doc_id, cite as blue_book_citation,
       try_cast(nullif(regexp_extract(cite, '([0-9]{{4}})\\)$', 1), '') as bigint) as decision_year,
       try_cast(nullif(regexp_extract(cite, '([0-9]{{4}})\\)$', 1), '') as int) < {LEX.anchor_year} as predates
from x
"""

_FIELDS = fields_sql(cases_source())

CASE_SUMMARY = f"with {_FIELDS} select doc_id, summary from ana"

KEY_POINTS = f"""
with {_FIELDS}
select doc_id, (u.i - 1)::bigint as point_no, u.p as key_point
from (select doc_id, unnest(list_transform(key_points, lambda p, i: {{'p': p, 'i': i}})) as u from ana)
"""

CITED_CASES = f"with {_FIELDS} select doc_id, unnest(citations) as cited_case from ana"

QUOTES_WITH_PAGE = f"""
with c as ({cases_source()}),
{quote_rows_sql('c')}
select doc_id,
       (row_number() over (partition by doc_id order by opens) - 1)::bigint as quote_no,
       quote, page, quote_fmt as quote_text
from qrows
"""

RELEVANCE_REASONING = f"""
with {_FIELDS}
select doc_id, relevance_level, n_topic::bigint as n_topic, n_both::bigint as n_both, reasoning from ana
"""

SUPPORT_ARGUMENT = f"""
with {_FIELDS}
select doc_id, support_level, net::bigint as net_support, argument from ana
"""

ARGUMENT_CITATION_CHECK = f"""
with {_FIELDS},
s as (select doc_id,
        list_filter({sentences_sql(f"regexp_replace(argument, {q(LEX.citation_pattern)}, {q(CITE_PLACEHOLDER)}, 'g')")},
                    lambda x: {clean('x')} <> '') as sents
      from ana)
select doc_id, len(sents)::bigint as n_sentences,
       len(list_filter(sents, lambda x: strpos(x, {q(CITE_PLACEHOLDER)}) = 0))::bigint as n_uncited
from s
"""

_WORDED = r"trim(regexp_replace(lower(%s), '[^\p{L}\p{N}]+', ' ', 'g'))"
_RUNS = "list_distinct(list_transform(range(1, greatest(len(%s) - 3, 1) + 1), lambda k: array_to_string(%s[k:k + 3], ' ')))"

# The page in force where a quote begins, from the position of the quote in the words of the text.
QUOTE_GROUNDING = f"""
with c as ({cases_source()}),
{quote_rows_sql('c')},
numbered as (select *, row_number() over (partition by doc_id order by opens) - 1 as no from qrows),
asked as (select doc_id, no, case (doc_id + no) % 4 when 1 then 'zzzz ' || regexp_replace(quote, '^[^ ]* ?', '') when 3 then reverse(quote) else quote end as quote,
                 case when (doc_id + no) % 4 = 2 and page is not null then '9999' else page end as page, page as true_page from numbered),
source as (select doc_id, ' ' || {_WORDED % "regexp_replace(regexp_replace(text, '([^*]|^)[*][0-9]+', '\\1 ', 'g'), '([^*]|^)[*][0-9]+', '\\1 ', 'g')"} || ' ' as words,
           list_transform(regexp_extract_all(text, '(?:^|[^*])[*]([0-9]+)', 1), lambda p: p) as pages,
           list_transform(string_split(regexp_replace(text, '(^|[^*])[*][0-9]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_WORDED % 'x'}) as stretches from c),
worded as (select a.*, {_WORDED % 'quote'} as q, s.words, s.pages, s.stretches from asked a join source s using (doc_id)),
told as (select *, q <> '' and contains(words, ' ' || q || ' ') as found, string_split(q, ' ') as qs from worded),
shared as (
  select t.doc_id, t.no, len(list_intersect({_RUNS % ('t.qs', 't.qs')}, s.runs)) / len({_RUNS % ('t.qs', 't.qs')}) as share
  from told t join (select doc_id, {_RUNS % ("string_split(trim(words), ' ')", "string_split(trim(words), ' ')")} as runs from source
                    where doc_id in (select doc_id from told where not found)) s using (doc_id) where not t.found),
starts as (select doc_id, no, list_filter(list_transform(range(1, len(stretches) + 1), lambda k: {{'page': pages[k - 1],
             'here': stretches[k], 'at': strpos(' ' || array_to_string(list_filter(stretches[k:], lambda x: x <> ''), ' ') || ' ', ' ' || q || ' ')}}),
             lambda r: r.here <> '' and r.at between 1 and length(r.here) + 1) as places
           from told where found and page is not null)
select doc_id, no::bigint as quote_no, case when found then 'found' when share >= 0.5 and q <> '' then 'altered' else 'missing' end as status,
       case when page is null then 'none' when found and len(list_filter(places, lambda r: r.page = told.page)) > 0 then 'right' when found then 'wrong' end as page,
       round(case when found then 1.0 when q = '' then 0.0 else share end, 4)::double as coverage
from told left join shared using (doc_id, no) left join starts using (doc_id, no)
"""

# Idle time: the eighths of a second between a batch's first start and last end that no request covers.
BATCH_INTERVALS = f"""
with num as (select doc_id, row_number() over (order by lpad(doc_id::varchar, 9, '0')) - 1 as idx from documents),
stamped as (select idx // {BATCH_SIZE} + 1 as batch_no, {LASTS} as lasts, case when {LASTS} is not null then {STARTS.replace('div', '//')} end as starts from num),
spans as (select batch_no, count(*) as n, max(lasts) as most, min(starts) as lo, max(starts + lasts) as hi, sum(lasts) as work from stamped group by batch_no),
ticks as (select batch_no, unnest(range(lo, hi)) as tick from spans),
idle as (select t.batch_no, count(*) as ticks from ticks t where not exists (
           select 1 from stamped s where s.batch_no = t.batch_no and s.starts <= t.tick and t.tick < s.starts + s.lasts) group by t.batch_no)
select batch_no::bigint as batch_no, n as n_requests, (most / 8.0)::double as max_latency_s, ((hi - lo) / 8.0)::double as elapsed_s,
       case when hi is not null then (coalesce(ticks, 0) / 8.0)::double end as idle_s, work::double / (hi - lo - coalesce(ticks, 0)) as overlap
from spans left join idle using (batch_no)
"""

ORACLE = {
    "batch_intervals": BATCH_INTERVALS,
    "caption_forms": expected_sql(),
    "citation_references": references_sql(),
    "quote_grounding": QUOTE_GROUNDING,
    "relevance_support_matrix": RELEVANCE_SUPPORT_MATRIX,
    "candidate_filter": CANDIDATE_FILTER,
    "case_citation": CASE_CITATION,
    "case_summary": CASE_SUMMARY,
    "key_points": KEY_POINTS,
    "cited_cases": CITED_CASES,
    "quotes_with_page": QUOTES_WITH_PAGE,
    "relevance_reasoning": RELEVANCE_REASONING,
    "support_argument": SUPPORT_ARGUMENT,
    "argument_citation_check": ARGUMENT_CITATION_CHECK,
}


# -- results, routing and reports ------------------------------------------------------

_COL = {"blue_book_citation": "cite"}
_MISSING = "nullif(concat_ws(', ', " + ", ".join(
    f"case when {_COL.get(n, n)} is null then '{n}' end" for n, _ in ANALYSIS_FIELDS
) + "), '')"

RESULTS_CTES = f"""{_FIELDS},
planted as (select * replace ({PLANT_REL} as relevance_level, {PLANT_SUP} as support_level) from ana),
res as (select *, {_MISSING} as missing from planted),
env as (select *, missing is null as has_analysis,
               case when missing is not null then 'invalid analysis: missing ' || missing else {PLANT_ERR} end as error
        from res),
ok as (select * from env where has_analysis and coalesce(error, '') = ''),
routed as (
    select *, lower(relevance_level) || '_relevance/' || lower(relevance_level) || '_relevance_analysis' as report
    from ok where relevance_level in ('High', 'Medium', 'Low')
    union all
    select *, lower(relevance_level) || '_relevance/Relevance ' || relevance_level || ' - ' || support_level as report
    from ok where relevance_level in ('High', 'Medium', 'Low')
             and support_level in ('Strongly Supports', 'Supports', 'Does not Support'))"""

RESULT_SPLIT = f"""
with {RESULTS_CTES}
select doc_id, filename, (not has_analysis or coalesce(error, '') <> '') as failed, error from env
"""

LEVEL_FILTER = f"""
with {RESULTS_CTES}
select doc_id, relevance_level from ok where relevance_level = 'High'
union all select doc_id, relevance_level from ok where relevance_level = 'Medium'
union all select doc_id, relevance_level from ok where relevance_level = 'Low'
"""

DOMAIN_AUDIT = f"""
with {RESULTS_CTES},
a as (select count(*)::bigint as n_success,
             count(*) filter (where relevance_level in ('High', 'Medium', 'Low'))::bigint as n_in_level_reports,
             count(*) filter (where relevance_level not in ('High', 'Medium', 'Low'))::bigint
               as n_relevance_out_of_domain,
             count(*) filter (where relevance_level in ('High', 'Medium', 'Low')
                              and support_level in ('Strongly Supports', 'Supports', 'Does not Support'))::bigint
               as n_in_combo_reports,
             count(*) filter (where relevance_level in ('High', 'Medium', 'Low')
                              and support_level not in ('Strongly Supports', 'Supports', 'Does not Support'))::bigint
               as n_support_out_of_domain
      from ok)
select *, n_success = n_in_level_reports + n_relevance_out_of_domain as success_conserved,
       n_in_level_reports = n_in_combo_reports + n_support_out_of_domain as level_conserved
from a
"""

LEVEL_COMBO_COUNTS = f"""
with {RESULTS_CTES},
g as (select relevance_level, support_level, grouping(support_level) as gs, count(*)::bigint as n_cases
      from ok where relevance_level in ('High', 'Medium', 'Low')
      group by grouping sets ((relevance_level), (relevance_level, support_level)))
select case when gs = 1 then 'level' else 'combo' end as "grouping", relevance_level, support_level, n_cases
from g where gs = 1 or support_level in ('Strongly Supports', 'Supports', 'Does not Support')
"""

REPORT_SPINE = """spine as (
    select lower(r) || '_relevance/' || lower(r) || '_relevance_analysis' as report
    from (values ('High'), ('Medium'), ('Low')) v(r)
    union all
    select lower(r) || '_relevance/Relevance ' || r || ' - ' || s
    from (values ('High'), ('Medium'), ('Low')) v(r),
         (values ('Strongly Supports'), ('Supports'), ('Does not Support')) w(s))"""

REPORT_DESTINATIONS = f"""
with {RESULTS_CTES},
{REPORT_SPINE},
c as (select report, count(*) as n from routed group by report)
select report, coalesce(n, 0)::bigint as n_cases, coalesce(n, 0) > 0 as written
from spine left join c using (report)
"""


def _line(style: str, text: str) -> str:
    return f"{{'style': '{style}', 'text': {text}}}"


_CASE_LINES = (
    "["
    + ", ".join(
        [
            _line("Heading 1", "'Case Analysis: ' || cite"),
            _line("Rule", "'" + "_" * 50 + "'"),
            _line("Heading 2", "'SUMMARY'"),
            _line("Body", "summary"),
            _line("Heading 2", "'RELEVANCY'"),
            _line("Body", "'Relevance Level: ' || relevance_level || chr(10) || 'Reasoning: ' || reasoning || chr(10)"),
            _line("Heading 2", "'SUPPORT LEVEL'"),
            _line("Body", "'Support Level: ' || support_level || chr(10)"),
            _line("Heading 2", "'ARGUMENT'"),
            _line("Body", "argument"),
            _line("Heading 2", "'KEY POINTS RELATED TO SPOLIATION'"),
        ]
    )
    + "] || list_transform(key_points, lambda x: "
    + _line("List Bullet", "x")
    + ") || ["
    + _line("Heading 2", "'CITATIONS'")
    + "] || list_transform(citations, lambda x: "
    + _line("List Bullet", "x")
    + ") || ["
    + _line("Heading 2", "'QUOTES'")
    + "] || list_transform(quotes, lambda x: "
    + _line("List Bullet", "x")
    + ")"
)

REPORT_LINES = f"""
with {RESULTS_CTES},
b as (select report, filename,
             case when filename <> min(filename) over (partition by report)
                  then [{_line('Page Break', "''")}] else [] end || {_CASE_LINES} as lines
      from routed)
select report, filename, (u.i - 1)::bigint as line_no, u.l.style as style, u.l.text as text
from (select report, filename, unnest(list_transform(lines, lambda l, i: {{'l': l, 'i': i}})) as u from b)
"""


def _run_lines(routed: str) -> str:
    return f"""select report, filename, (u.i - 1)::bigint as line_no, u.l.style as style, u.l.text as text
from (select report, filename, unnest(list_transform(lines, lambda l, i: {{'l': l, 'i': i}})) as u
      from (select report, filename,
                   case when filename <> min(filename) over (partition by report)
                        then [{_line('Page Break', "''")}] else [] end || {_CASE_LINES} as lines
            from {routed}))"""


REPORT_OVERWRITE = f"""
with {RESULTS_CTES},
again as (select * from routed where {SECOND_RUN}),
first_lines as ({_run_lines('routed')}),
second_lines as ({_run_lines('again')})
select * from second_lines
union all
select * from first_lines where report not in (select report from again)
"""

REPORT_PUBLICATION = f"""
with {RESULTS_CTES},
again as (select * from routed where {SECOND_RUN}),
first_lines as ({_run_lines('routed')}),
second_lines as ({_run_lines('again')})
select *, 2::bigint as run from second_lines
union all
select *, 1::bigint as run from first_lines where report not in (select report from again)
"""

RUN_SUMMARY = f"""
with {RESULTS_CTES}
select count(*)::bigint as n_documents,
       count(*) filter (where has_analysis and coalesce(error, '') = '')::bigint as n_success,
       count(*) filter (where not (has_analysis and coalesce(error, '') = ''))::bigint as n_failed
from env
"""

FAILURE_LISTING = f"""
with {RESULTS_CTES}
select filename, coalesce(error, '') as error from env where not (has_analysis and coalesce(error, '') = '')
"""

ORACLE.update(
    {
        "result_split": RESULT_SPLIT,
        "level_filter": LEVEL_FILTER,
        "domain_audit": DOMAIN_AUDIT,
        "level_combo_counts": LEVEL_COMBO_COUNTS,
        "report_destinations": REPORT_DESTINATIONS,
        "report_lines": REPORT_LINES,
        "report_sink_roundtrip": REPORT_LINES,
        "report_overwrite": REPORT_OVERWRITE,
        "report_publication": REPORT_PUBLICATION,
        "run_summary": RUN_SUMMARY,
        "failure_listing": FAILURE_LISTING,
    }
)


# -- requests, inference, validation, ingest -------------------------------------------

_TPL = PromptTemplate()
_PRE, _POST = _TPL.user_parts()
_FILENAME = "lpad(doc_id::varchar, 9, '0') || '.docx'"

REQUEST_RENDER = f"""
with d as (select {_FILENAME} as filename, text, unnest([{', '.join(q(m) for m in RENDER_MODELS)}]) as model
           from documents),
m as (select *, {q(_TPL.developer)} as dev, {q(_PRE)} || text || {q(_POST)} as usr from d)
select filename, model, 2::bigint as n_messages, 'developer,user' as roles,
       length(dev)::bigint as developer_chars, length(usr)::bigint as user_chars, sha256(usr) as user_sha256,
       case when model = 'o1' then 'high' end as reasoning_effort,
       case when model <> 'o1' then 0.0::double end as temperature
from m
"""

REQUEST_BATCHES = f"""
select filename, ((row_number() over (order by filename) - 1) // {BATCH_SIZE} + 1)::bigint as batch_no,
       ceil(count(*) over () / {BATCH_SIZE})::bigint as n_batches
from (select {_FILENAME} as filename from documents)
"""

_M = RETRY_CONFIG.max_retries
_D = RETRY_CONFIG.retry_delay_ms
RETRY_OUTCOMES = f"""
select doc_id, least(doc_id % 5 + 1, {_M + 1})::bigint as attempts,
       ({_D} * (pow(2, least(doc_id % 5, {_M})) - 1))::bigint as waited_ms,
       doc_id % 5 <= {_M} as ok,
       case when doc_id % 5 <= {_M} then null
            else 'Failed after {_M} retries: injected failure on attempt ' || (doc_id % 5)::varchar end as error
from documents
"""

_CHECKS = " and ".join(
    [f"coalesce(json_type(r, '$.{f}') = 'VARCHAR', false)" for f in STRING_FIELDS]
    + [
        f"coalesce(json_type(r, '$.{f}') = 'ARRAY', false)"
        f" and coalesce(len(list_filter(json_extract(r, '$.{f}[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0, false)"
        for f in LIST_FIELDS
    ]
)
STRICT_VALIDATION = f"""
with d as (select doc_id, (doc_id % {len(SHAPES)})::bigint as shape, {response_sql('duckdb')} as r from documents),
v as (select *, case when coalesce(json_valid(r), false) then json_type(r) = 'OBJECT' and {_CHECKS} else false end as valid
      from d)
select doc_id, shape, valid,
       case when valid then json_extract_string(r, '$.blue_book_citation') end as blue_book_citation,
       case when valid then json_extract_string(r, '$.relevance_level') end as relevance_level,
       case when valid then json_array_length(r, '$.key_points')::bigint end as n_key_points
from v
"""

BATCH_STATS = f"""
select batch_no, count(*)::bigint as n_requests, true as seconds_recorded
from (select ((row_number() over (order by filename) - 1) // {BATCH_SIZE} + 1)::bigint as batch_no
      from (select {_FILENAME} as filename from documents))
group by batch_no
"""

DOCX_INGEST = f"""
select {_FILENAME} as filename, case when {DOCX_CORRUPT} then null else text end as text,
       not ({DOCX_CORRUPT}) as readable
from documents
"""

FOLDER_SCAN = f"""
with f as (select *, case when doc_id % 7 = 1 then '_' when doc_id % 7 = 2 then '.' when doc_id % 7 = 3 then '~$' else '' end
                     || doc_id::varchar
                     || case when doc_id % 11 = 4 then '.DOCX' when doc_id % 11 = 5 then '.txt'
                             when doc_id % 11 = 6 then '.docx.bak' else '.docx' end as filename,
                  not ({DOCX_CORRUPT}) and doc_id % 13 <> 0 as readable
           from documents)
select filename, case when readable then length(text) end::bigint as n_chars, readable
from f where filename like '%.docx'
"""

EMPTY_INPUT = """
select 'all' as run, count(*)::bigint as n_documents, true as summary_written, true as failures_written,
       true as reports_written from documents
union all
select 'none', 0::bigint, false, false, false
"""


def _times(terms) -> str:
    """Occurrences of each term in ``flat`` (lower case, single spaces): its text cut at the term, cuts inside words left out."""
    def one(t: str) -> str:
        parts = f"string_split(flat, {q(t)})"
        return (f"len(list_filter(range(1, len({parts})), lambda k: not regexp_matches({parts}[k], '[a-z]$')"
                f" and not regexp_matches({parts}[k + 1], '^[a-z]')))")
    return " + ".join(one(t) for t in terms)


LEGAL_LEXICON = f"""
with src as ({PLEADED_DUCKDB_SQL}),
flat as (select *, regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g') as flat, {sentences_sql('text')} as sents from src),
topic as (select *, list_filter(sents, lambda s: regexp_matches(lower(s), {q(term_pattern(LEGAL.topic_terms))})) as ts from flat),
counted as (select doc_id, regexp_matches(lower(text), {q(term_pattern(LEGAL.candidate_phrases))}) as candidate, len(ts)::bigint as n_topic,
              len(list_filter(ts, lambda s: regexp_matches(lower(s), {q(term_pattern(LEGAL.holding_terms))})))::bigint as n_both,
              ({_times(LEGAL.support_terms)} - ({_times(LEGAL.contra_terms)}))::bigint as net_support from topic)
select *, case when n_both > 0 then 'High' when n_topic > 0 then 'Medium' else 'Low' end as relevance_level,
       case when net_support >= 2 then 'Strongly Supports' when net_support = 1 then 'Supports' else 'Does not Support' end as support_level
from counted
"""

_SENTENCE_MODEL = f"""
with src as ({ABRIDGED_DUCKDB_SQL}),
cut as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') as ws from src),
each as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as word_no from cut),
seen as (select *, lag(word) over w as before, lead(word) over w as after, regexp_extract(word, {q(B.WORD)}, 1) as type,
                regexp_extract(word, {q(B.WORD)}, 2) = '.' as dot from each window w as (partition by doc_id order by word_no)),
types as (select type, count(*) filter (dot) as n_with, count(*) filter (not dot) as n_without,
                 count(*) filter (not regexp_matches(before, {q(B.PAUSE)})) as n_inside from seen where type <> '' group by type),
lows as (select lower(type) as low from types group by 1
         having sum(case when regexp_matches(type, '^\\p{{Ll}}') then n_with + n_without end)
             >= 4 * coalesce(sum(case when regexp_matches(type, '^\\p{{Lu}}') then n_inside end), 0)),
openers as (select type from types where regexp_matches(type, '^\\p{{Lu}}') and lower(type) in (select low from lows)),
share as (select least(greatest(sum(n_with) / sum(n_with + n_without), 1e-9), 0.98)::double as p from types),
rated as (select types.*, 2 * (n_with * ln({B.NEAR_ALWAYS} / p) + n_without * ln((1 - {B.NEAR_ALWAYS}) / (1 - p))) as ratio,
                 length(replace(type, '.', '')) as letters from types, share),
suspects as (select * from rated where ratio * exp(-letters) * (1 + length(type) - letters) >= {B.LEAST_SCORE} and n_with >= 4 * n_without),
stops as (select *, regexp_extract(after, {q(B.WORD)}, 1) as next_type from seen
          where regexp_matches(word, {q(B.STOP)}) and after is not null),
shares as (select type, count(*) as n_followed, count(*) filter (next_type in (select type from openers)) as n_starts from stops group by type),
abbreviations as (select suspects.*, coalesce(n_followed, 0) as n_followed, coalesce(n_starts, 0) as n_starts
                  from suspects left join shares using (type) where 2 * coalesce(n_starts, 0) <= coalesce(n_followed, 0))"""

LEARNED_ABBREVIATIONS = _SENTENCE_MODEL + """
select type, n_with, n_without, n_followed::bigint as n_followed, n_starts::bigint as n_starts, round(ratio, 2) as ratio from abbreviations
"""

SENTENCE_ENDS = _SENTENCE_MODEL + f""",
judged as (select *, not regexp_matches(word, {q(B.HARD_STOP)})
                     and (type in (select type from abbreviations) or regexp_matches(type, {q(B.INITIAL)})) as abbreviation from stops)
select doc_id, word_no::bigint as word_no, word, after, abbreviation,
       case when regexp_matches(word, {q(B.HARD_STOP)}) then true when abbreviation then next_type in (select type from openers)
            else not regexp_matches(after, {q(B.LOWER_NEXT)}) end as ends
from judged
"""

ORACLE.update(
    {
        "learned_abbreviations": LEARNED_ABBREVIATIONS,
        "sentence_ends": SENTENCE_ENDS,
        "legal_lexicon": LEGAL_LEXICON,
        "folder_scan": FOLDER_SCAN,
        "empty_input": EMPTY_INPUT,
        "request_render": REQUEST_RENDER,
        "request_batches": REQUEST_BATCHES,
        "retry_outcomes": RETRY_OUTCOMES,
        "strict_validation": STRICT_VALIDATION,
        "batch_stats": BATCH_STATS,
        "docx_ingest": DOCX_INGEST,
    }
)
