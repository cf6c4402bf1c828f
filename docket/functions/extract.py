"""Extraction fields E01-E12 as column functions.

Each function takes already-derived columns (see ``RuleAnalyzer.features``) so that
the expensive pieces (lower-cased body, lexicon hits, topic sentences, summary
pieces, quote tokens, page-per-token array) are computed once per row; the
``with_*`` helpers add such pieces as their own projections. All of them are
narrow, per-row expressions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket.config import Lexicon
from docket.functions.captions import citation_year, without_signal
from docket.functions.text import (
    SENTENCE_SPLIT,
    STAR_PAGE,
    caption_pattern,
    clean,
    quote_pattern,
    sentences,
)
from docket.functions.trie import trie_pattern

CITE_PLACEHOLDER = "<cite>"
# A piece that :func:`clean` turns into '' (only whitespace and end punctuation).
_BLANK_PIECE = r"^[ \t\r\n]*[.!?]*[ \t\r\n]*$"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def citation(text: Column, lex: Lexicon) -> Column:
    """The Blue Book citation of the caption line (see ``caption_pattern``), or null."""
    found = F.regexp_extract(text, caption_pattern(lex.citation_pattern), 1)
    return F.nullif(without_signal(found) if lex.case_headers else found, F.lit(""))


def decision_year(cite: Column) -> Column:
    """E11 helper: the year closing the citation's parenthesis, or that of the full date in it."""
    return citation_year(cite)


def predates(cite: Column, lex: Lexicon) -> Column:
    """True when the decision year is before the anchor year."""
    return decision_year(cite) < F.lit(lex.anchor_year)


def is_candidate(lower_text: Column, lex: Lexicon) -> Column:
    """The text contains one of the candidate phrases."""
    return lower_text.rlike(trie_pattern(lex.candidate_phrases))


def topic_sentences(body: Column, has_topic: Column, lex: Lexicon) -> Column:
    """Sentences (original case) that mention a topic term, in document order.

    The body is split only when it mentions the topic at all.
    """
    pat = trie_pattern(lex.topic_terms)
    return F.when(has_topic, F.filter(sentences(body), lambda s: F.lower(s).rlike(pat))).otherwise(empty_strings())


def holding_count(topic_sents: Column, has_holding: Column, lex: Lexicon) -> Column:
    """Number of topic sentences that also contain a holding term."""
    pat = trie_pattern(lex.holding_terms)
    return F.when(
        has_holding & (F.size(topic_sents) > 0),
        F.size(F.filter(topic_sents, lambda s: F.lower(s).rlike(pat))),
    ).otherwise(F.lit(0))


def relevance_level(n_topic: Column, n_both: Column) -> Column:
    """High when a sentence pairs topic and holding, Medium on any topic sentence."""
    return F.when(n_both > 0, "High").when(n_topic > 0, "Medium").otherwise("Low")


def support_level(net: Column) -> Column:
    """Net support hits >= 2 strongly supports, exactly 1 supports."""
    return F.when(net >= 2, "Strongly Supports").when(net == 1, "Supports").otherwise("Does not Support")


def reasoning(level: Column, n_topic: Column, n_both: Column) -> Column:
    """The evidence counts that decided E03."""
    return (
        F.when(
            level == "High",
            F.concat(
                F.lit("Relevance High: "),
                n_both.cast("string"),
                F.lit(" sentence(s) pair a topic term with a holding term; "),
                n_topic.cast("string"),
                F.lit(" sentence(s) mention the topic."),
            ),
        )
        .when(
            level == "Medium",
            F.concat(
                F.lit("Relevance Medium: "),
                n_topic.cast("string"),
                F.lit(" sentence(s) mention the topic; none pairs it with a holding term."),
            ),
        )
        .otherwise(F.lit("Relevance Low: no sentence mentions the topic."))
    )


def _pick(arr: Column, n: int) -> Column:
    """First n pieces that are not blank after cleaning, cleaned (only those n are cleaned)."""
    return F.transform(F.slice(F.filter(arr, lambda s: ~s.rlike(_BLANK_PIECE)), 1, n), clean)


def with_summary(df, body: str = "_body", n: int = 3, out: str = "summary"):
    """The first ``n`` non-blank sentences, cleaned, joined as prose.

    Only the first 4n sentences are split off (a split with a limit leaves the
    rest of the text as one piece); the whole body is split only when those hold
    fewer than n non-blank sentences. Each intermediate is its own projection,
    so it is computed once per row.
    """
    df = df.withColumn("_lim", F.split(F.col(body), SENTENCE_SPLIT, 4 * n + 1))
    df = df.withColumn("_head", _pick(F.slice("_lim", 1, 4 * n), n))
    df = df.withColumn(
        "_chosen",
        F.when((F.size("_head") >= n) | (F.size("_lim") <= 4 * n), F.col("_head")).otherwise(
            _pick(sentences(F.col(body)), n)
        ),
    )
    df = df.withColumn(
        out,
        F.concat(F.array_join("_chosen", ". "), F.when(F.size("_chosen") > 0, F.lit(".")).otherwise(F.lit(""))),
    )
    return df.drop("_lim", "_head", "_chosen")


def key_points(topic_sents: Column) -> Column:
    """Every topic sentence, cleaned, in document order."""
    return F.transform(topic_sents, clean)


def cited_cases(text: Column, own: Column, lex: Lexicon) -> Column:
    """Distinct citations anywhere in the text except the case's own."""
    found = F.regexp_extract_all(text, F.lit(lex.citation_pattern), 0)
    found = F.array_distinct(F.transform(found, without_signal) if lex.case_headers else found)
    return F.when(own.isNull(), found).otherwise(F.array_remove(found, own))


def quote_tokens(text: Column, open_: str = "“", close: str = "”") -> Column:
    """Every star page and every quoted passage (delimiters included), in document order."""
    return F.regexp_extract_all(text, F.lit(f"{STAR_PAGE}|{quote_pattern(open_, close)}"), 0)


def page_markers(tokens: Column) -> Column:
    """(pos, page) of every token holding a star page: the token's last one."""
    marks = F.transform(
        tokens,
        lambda x, i: F.struct(
            i.alias("pos"),
            F.when(
                F.instr(x, "*") > 0,
                F.try_element_at(F.regexp_extract_all(x, F.lit(STAR_PAGE), 1), F.lit(-1)),
            ).alias("page"),
        ),
    )
    return F.filter(marks, lambda m: m["page"].isNotNull())


def page_after_token(markers: Column, n_tokens: Column) -> Column:
    """Dense array: the page in force after each token (null before the first marker).

    Built from runs (``array_repeat``) between consecutive markers, so it costs
    O(tokens) per document; a quote's page is then one array lookup.
    """
    first = F.try_element_at(markers, F.lit(1))["pos"]
    runs = F.flatten(
        F.transform(
            markers,
            lambda m, i: F.array_repeat(
                m["page"], F.coalesce(F.try_element_at(markers, i + 2)["pos"], n_tokens) - m["pos"]
            ),
        )
    )
    lead = F.array_repeat(F.lit(None).cast("string"), F.coalesce(first, n_tokens))
    return F.when(F.size(markers) > 0, F.concat(lead, runs))


def format_quote(q: Column, page: Column, open_: str = "“", close: str = "”") -> Column:
    return F.concat(F.lit(open_), q, F.lit(close), F.coalesce(F.concat(F.lit(", at *"), page), F.lit("")))


def quote_records(tokens: Column, pages: Column, open_: str = "“", close: str = "”") -> Column:
    """E07 as records: ``array<struct<quote, page>>`` in document order.

    ``tokens`` is :func:`quote_tokens` and ``pages`` :func:`page_after_token`, both
    already materialised as columns (an expression inside a lambda is evaluated
    per element). ``page`` is the last star page before the quote opens.
    """
    records = F.transform(
        tokens,
        lambda x, i: F.struct(
            F.when(
                x.startswith(open_), x.substr(F.lit(len(open_) + 1), F.length(x) - F.lit(len(open_) + len(close)))
            ).alias("quote"),
            F.get(pages, i - 1).alias("page"),
        ),
    )
    return F.filter(records, lambda r: r["quote"].isNotNull())


def with_quotes(df, text: str = "text", out: str = "_quote_records", open_: str = "“", close: str = "”"):
    """Add E07 records to ``df`` in stages, each intermediate computed once per row."""
    df = df.withColumn(
        "_tokens",
        F.when(F.instr(F.col(text), open_) > 0, quote_tokens(F.col(text), open_, close)).otherwise(empty_strings()),
    )
    df = df.withColumn("_markers", page_markers(F.col("_tokens")))
    df = df.withColumn("_pages", page_after_token(F.col("_markers"), F.size("_tokens")))
    df = df.withColumn(out, quote_records(F.col("_tokens"), F.col("_pages"), open_, close))
    return df.drop("_tokens", "_markers", "_pages")


def quotes(records: Column, open_: str = "“", close: str = "”") -> Column:
    """The formatted quotes of :func:`quote_records`."""
    return F.transform(records, lambda r: format_quote(r["quote"], r["page"], open_, close))


def argument(cite: Column, support: Column, kps: Column, lex: Lexicon) -> Column:
    """A lead sentence by support level, then each key point cited to the case."""
    phrase = (
        F.when(support == "Strongly Supports", F.lit(lex.lead_strong))
        .when(support == "Supports", F.lit(lex.lead_support))
        .otherwise(F.lit(lex.lead_against))
    )
    lead = F.concat(cite, F.lit(" "), phrase, F.lit(" " + lex.position + "."))
    body = F.array_join(F.transform(kps, lambda kp: F.concat(kp, F.lit(", "), cite, F.lit("."))), " ")
    return F.when(F.size(kps) > 0, F.concat(lead, F.lit(" "), body)).otherwise(lead)


def argument_sentences(arg: Column, lex: Lexicon) -> Column:
    """Non-blank sentences of an argument, with every citation masked first."""
    masked = F.regexp_replace(arg, lex.citation_pattern, CITE_PLACEHOLDER)
    return F.filter(F.split(masked, SENTENCE_SPLIT, -1), lambda s: ~s.rlike(_BLANK_PIECE))


def uncited_count(sents: Column) -> Column:
    """How many of the (masked) argument sentences carry no citation."""
    return F.size(F.filter(sents, lambda s: ~s.contains(CITE_PLACEHOLDER)))


def uncited_sentences(arg: Column, lex: Lexicon) -> Column:
    """E12 from the argument text."""
    return uncited_count(argument_sentences(arg, lex))


__all__ = [
    "citation",
    "decision_year",
    "predates",
    "is_candidate",
    "topic_sentences",
    "holding_count",
    "relevance_level",
    "support_level",
    "reasoning",
    "with_summary",
    "key_points",
    "cited_cases",
    "quote_records",
    "with_quotes",
    "quotes",
    "argument",
    "argument_sentences",
    "uncited_count",
    "uncited_sentences",
    "sentences",
]
