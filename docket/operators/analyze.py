"""Rule analyzer: the nine analysis fields as Spark expressions.

This is the offline, deterministic analyzer. It is a chain of narrow projections
over the document table, so Catalyst prunes whatever a query does not use (the
relevance/support matrix never builds quotes or summaries) and nothing shuffles.
Each intermediate that is used more than once (lower-cased body, sentence array,
topic sentences) gets its own projection so it is computed once per row.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.config import Lexicon
from docket.functions import extract as X
from docket.functions.captions import header_block, header_citation, header_lines, parse_header
from docket.functions.text import without_caption
from docket.functions.trie import Terms
from docket.schema import ANALYSIS_FIELDS


class Analyzer(Protocol):
    """What the run needs from an analyzer: documents in, result envelopes out.

    ``analyze(docs)`` maps ``(filename, text, ...)`` to ``(filename, analysis, error)``;
    :class:`RuleAnalyzer` and :class:`docket.plans.casework.ModelAnalyzer` both fit.
    """

    def analyze(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame: ...


class RuleAnalyzer:
    """Deterministic analyzer built from built-in functions and a :class:`Lexicon`."""

    def __init__(self, lexicon: Lexicon | None = None):
        self.lexicon = lexicon or Lexicon()

    # -- stages -------------------------------------------------------------
    def features(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add the per-document evidence columns (prefixed ``_``) and E01/E03/E09."""
        lex = self.lexicon
        t = F.col(text)
        df = df.withColumn("_cite", X.citation(t, lex))
        # The caption line is not prose.
        df = df.withColumn("_body", F.when(F.col("_cite").isNotNull(), without_caption(t, lex.citation_pattern)).otherwise(t))
        if lex.case_headers:  # a case without a citation line may name itself in a header block, which is not prose either
            block = F.when(F.col("_cite").isNull(), F.nullif(header_block(t), F.lit("")))
            df = df.withColumn("_block", block)
            df = df.withColumn("_header", F.when(F.col("_block").isNotNull(), parse_header(header_lines(F.col("_block")))))
            df = df.withColumn("_named", header_citation(F.col("_header")))
            rest = F.expr(f"substr(`{text}`, char_length(_block) + 1)")
            df = df.withColumn("_body", F.when(F.col("_named").isNotNull(), rest).otherwise(F.col("_body")))
            df = df.withColumn("_cite", F.coalesce("_cite", "_named"))
        df = df.withColumn("_lt", F.lower("_body"))
        df = self._evidence(df, F.col("_lt"))
        df = df.withColumn("_topic_sents", X.topic_sentences(F.col("_body"), F.col("_has_topic"), lex))
        df = df.select(
            "*",
            F.size("_topic_sents").alias("n_topic"),
            X.holding_count(F.col("_topic_sents"), F.col("_has_holding"), lex).alias("n_both"),
        )
        return df.select(
            "*",
            F.col("_cite").alias("blue_book_citation"),
            X.relevance_level(F.col("n_topic"), F.col("n_both")).alias("relevance_level"),
            X.support_level(F.col("net_support")).alias("support_level"),
        )

    def _evidence(self, df: DataFrame, lt: Column) -> DataFrame:
        """Add ``_has_topic``, ``_has_holding`` and ``net_support`` from the lower-cased body.

        One scan lists the hits of all groups, words and phrases alike (``_hits``, its own
        projection so it is computed once); the three values are read off that list.
        """
        lex = self.lexicon
        terms = Terms(topic=lex.topic_terms, holding=lex.holding_terms, support=lex.support_terms, contra=lex.contra_terms)
        df = df.withColumn("_hits", terms.hits(lt))
        hits = F.col("_hits")
        return df.select(
            "*",
            terms.any(hits, "topic").alias("_has_topic"),
            terms.any(hits, "holding").alias("_has_holding"),
            (terms.count(hits, "support") - terms.count(hits, "contra")).alias("net_support"),
        )

    def fields(self, df: DataFrame, text: str = "text", keep_private: bool = False) -> DataFrame:
        """All nine analysis fields as top-level columns (plus the evidence columns)."""
        lex = self.lexicon
        f = self.features(df, text)
        f = X.with_summary(f, "_body", lex.summary_sentences)
        f = f.select(
            "*",
            X.reasoning(F.col("relevance_level"), F.col("n_topic"), F.col("n_both")).alias("reasoning"),
            X.key_points(F.col("_topic_sents")).alias("key_points"),
            X.cited_cases(F.col(text), F.col("_cite"), lex).alias("citations"),
        )
        f = X.with_quotes(f, text, open_=lex.quote_open, close=lex.quote_close)
        f = f.withColumn("quotes", X.quotes(F.col("_quote_records"), lex.quote_open, lex.quote_close))
        f = f.withColumn(
            "argument", X.argument(F.col("_cite"), F.col("support_level"), F.col("key_points"), lex)
        )
        if keep_private:
            return f
        return f.drop(*[c for c in f.columns if c.startswith("_")])

    # -- public surface -------------------------------------------------------
    def analyze(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """Documents ``(filename, text, ...)`` -> results ``(filename, analysis, error, ...)``.

        A record with a missing field (no citation found) is a failure, as a
        response failing schema validation would be.
        """
        f = self.fields(docs, text)
        analysis = analysis_struct()
        missing = missing_fields()
        return f.select(
            "filename",
            *keep,
            F.when(missing.isNull(), analysis).alias("analysis"),
            F.when(missing.isNotNull(), F.concat(F.lit("invalid analysis: missing "), missing)).alias("error"),
        )


def analysis_struct() -> Column:
    return F.struct(*[F.col(n) for n, _ in ANALYSIS_FIELDS])


def missing_fields() -> Column:
    """Comma list of null analysis fields, or null when all are present."""
    names = F.concat_ws(", ", *[F.when(F.col(n).isNull(), F.lit(n)) for n, _ in ANALYSIS_FIELDS])
    return F.nullif(names, F.lit(""))


def missing_without(text: Column, citation: Column) -> Column:
    """What :func:`missing_fields` says of a rule analysis, told from the text and citation alone.

    The rules leave a field null only for want of these two, so a plan that needs few
    fields does not compute the rest to see whether they are there.
    """
    no_text = F.lit("blue_book_citation, summary, citations, argument")
    return F.when(text.isNull(), no_text).when(citation.isNull(), F.lit("blue_book_citation, argument"))
