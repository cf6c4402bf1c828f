"""DuckDB oracle SQL for the registered queries.

The oracle is written independently of the Spark plans (list lambdas, window
functions, JSON functions) from the same lexicon values, so a wrong Spark plan
and a wrong oracle are unlikely to agree by accident.
"""

from __future__ import annotations

from docket.config import FIXTURE_LEXICON, Lexicon
from docket.functions.text import ABBREVIATIONS, term_pattern
from docket.sources.documents import CASES_DUCKDB_SQL


def q(s: str) -> str:
    """SQL string literal (no escape processing in DuckDB)."""
    return "'" + s.replace("'", "''") + "'"


def _words(terms) -> str:
    for t in terms:
        if not t.isalpha():
            raise ValueError("the oracle counts single-word terms only")
    return "(" + ", ".join(q(t.lower()) for t in terms) + ")"


def clean(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g'),"
        f" '[.!?]+$', '')"
    )


def sentences_sql(x: str) -> str:
    """Sentences: periods of abbreviations are masked, the text is split, the masks go."""
    words = "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS)
    masked = f"regexp_replace({x}, {q(f'''(^|[^A-Za-z.'])({words})[.]''')}, '\\1\\2' || chr(1), 'g')"
    return f"list_transform(regexp_split_to_array({masked}, '[.!?][ \\n]+'), lambda y: replace(y, chr(1), '.'))"


def caption_sql(source: str, lex: Lexicon) -> str:
    """CTEs ending in ``captioned``: line by line, the caption's citation and the other lines."""
    cite = lex.citation_pattern
    return f"""lined as (select *, string_split(text, chr(10)) as ls from {source}),
caption as (select *, list_min(list_filter(list_transform(ls, lambda x, i:
              case when (i = 1 and regexp_matches(x, {q(cite)})) or regexp_matches(x, {q(f'^[ {chr(9)}]*(?:{cite})')}) then i end),
              lambda i: i is not null)) as cap_no from lined),
captioned as (select * exclude (ls, cap_no), regexp_extract(ls[cap_no], {q(cite)}, 0) as cite,
                case when cap_no is null then text
                     else array_to_string(list_filter(ls, lambda x, i: i <> cap_no), chr(10)) end as body
              from caption)"""


def features_sql(source_sql: str, lex: Lexicon = FIXTURE_LEXICON) -> str:
    """CTE chain ending in ``feat``: citation, relevance, support and evidence per document."""
    topic = q(term_pattern(lex.topic_terms))
    hold = q(term_pattern(lex.holding_terms))
    return f"""
src as ({source_sql}),
{caption_sql('src', lex)},
fc as (select *, lower(body) as lt, {sentences_sql('body')} as sents from captioned),
fd as (select *,
         list_filter(sents, lambda s: regexp_matches(lower(s), {topic})) as topic_sents,
         len(list_filter(regexp_split_to_array(lt, '[^a-z]+'), lambda w: w in {_words(lex.support_terms)}))
       - len(list_filter(regexp_split_to_array(lt, '[^a-z]+'), lambda w: w in {_words(lex.contra_terms)})) as net
       from fc),
fe as (select *, len(topic_sents) as n_topic,
         len(list_filter(topic_sents, lambda s: regexp_matches(lower(s), {hold}))) as n_both from fd),
feat as (select *,
         case when n_both > 0 then 'High' when n_topic > 0 then 'Medium' else 'Low' end as relevance_level,
         case when net >= 2 then 'Strongly Supports' when net = 1 then 'Supports' else 'Does not Support' end
           as support_level
       from fe)"""


def fields_sql(source_sql: str, lex: Lexicon = FIXTURE_LEXICON) -> str:
    """CTE chain ending in ``ana``: all nine analysis fields (quotes via a window)."""
    n = lex.summary_sentences
    cite_re = q(lex.citation_pattern)
    return features_sql(source_sql, lex) + f""",
fs as (select *, list_filter(list_transform(sents, lambda s: {clean('s')}), lambda s: s <> '')[1:{n}] as sum_sents,
         list_transform(topic_sents, lambda s: {clean('s')}) as key_points
       from feat),
fr as (select *,
         array_to_string(sum_sents, '. ') || case when len(sum_sents) > 0 then '.' else '' end as summary,
         case relevance_level
           when 'High' then 'Relevance High: ' || n_both::varchar
                || ' sentence(s) pair a topic term with a holding term; ' || n_topic::varchar
                || ' sentence(s) mention the topic.'
           when 'Medium' then 'Relevance Medium: ' || n_topic::varchar
                || ' sentence(s) mention the topic; none pairs it with a holding term.'
           else 'Relevance Low: no sentence mentions the topic.' end as reasoning,
         list_filter(regexp_extract_all(text, {cite_re}, 0),
                     lambda c, i: list_position(regexp_extract_all(text, {cite_re}, 0), c) = i
                                  and (cite is null or c <> cite))
           as citations,
         cite || ' ' || case support_level when 'Strongly Supports' then {q(lex.lead_strong)}
                                           when 'Supports' then {q(lex.lead_support)}
                                           else {q(lex.lead_against)} end
              || {q(' ' + lex.position + '.')}
           || case when len(key_points) > 0
                   then ' ' || array_to_string(list_transform(key_points, lambda p: p || ', ' || cite || '.'), ' ')
                   else '' end as argument
       from fs),
{quote_rows_sql('src')},
qagg as (select doc_id, list(quote_fmt order by opens) as quotes from qrows group by doc_id),
ana as (select fr.*, coalesce(qagg.quotes, []::varchar[]) as quotes
        from fr left join qagg using (doc_id))"""


def quote_rows_sql(source: str) -> str:
    """CTEs ending in ``qrows``: one row per quote, its page the last one in the text before it.

    The text is cut at closing marks; a piece with an opening mark ends in a quote.
    """
    return f"""qcut as (
    select doc_id, text, unnest(list_transform(string_split(text, '”'),
                                               lambda x, i: {{'no': i, 'piece': x}}), recursive := true)
    from {source}),
qpieces as (
    select *, sum(length(piece) + 1) over (partition by doc_id order by no) - 1 as closes,
           max(no) over (partition by doc_id) as last_no, string_split(piece, '“')[-1] as quote
    from qcut),
qopen as (
    select doc_id, quote, closes - length(quote) as opens,
           regexp_extract_all(left(text, (closes - length(quote) - 1)::bigint), '(?:^|[^*])[*]([0-9]+)', 1)[-1] as page
    from qpieces where no < last_no and strpos(piece, '“') > 0 and quote <> ''),
qrows as (select *, '“' || quote || '”' || coalesce(', at *' || page, '') as quote_fmt from qopen)"""


def documents_source() -> str:
    return "select lpad(doc_id::varchar, 9, '0') || '.docx' as filename, doc_id, text from documents"


def cases_source() -> str:
    return CASES_DUCKDB_SQL
