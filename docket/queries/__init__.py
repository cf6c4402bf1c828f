"""Query registry: Spark callables and their DuckDB oracle SQL."""

from __future__ import annotations

from docket.queries import catalog
from docket.queries.sql import ORACLE

QUERIES = {
    "relevance_support_matrix": catalog.relevance_support_matrix,
    "candidate_filter": catalog.candidate_filter,
    "legal_lexicon": catalog.legal_lexicon,
    "learned_abbreviations": catalog.learned_abbreviations,
    "sentence_ends": catalog.sentence_ends,
    "case_citation": catalog.case_citation,
    "caption_forms": catalog.caption_forms,
    "citation_references": catalog.citation_references,
    "quote_grounding": catalog.quote_grounding,
    "case_summary": catalog.case_summary,
    "key_points": catalog.key_points,
    "cited_cases": catalog.cited_cases,
    "quotes_with_page": catalog.quotes_with_page,
    "relevance_reasoning": catalog.relevance_reasoning,
    "support_argument": catalog.support_argument,
    "argument_citation_check": catalog.argument_citation_check,
    "result_split": catalog.result_split,
    "level_filter": catalog.level_filter,
    "domain_audit": catalog.domain_audit,
    "level_combo_counts": catalog.level_combo_counts,
    "report_destinations": catalog.report_destinations,
    "report_lines": catalog.report_lines_query,
    "report_sink_roundtrip": catalog.report_sink_roundtrip,
    "report_overwrite": catalog.report_overwrite,
    "report_publication": catalog.report_publication,
    "run_summary": catalog.run_summary_query,
    "failure_listing": catalog.failure_listing_query,
    "request_render": catalog.request_render,
    "request_batches": catalog.request_batches,
    "retry_outcomes": catalog.retry_outcomes,
    "strict_validation": catalog.strict_validation,
    "batch_stats": catalog.batch_stats,
    "batch_intervals": catalog.batch_intervals,
    "docx_ingest": catalog.docx_ingest,
    "folder_scan": catalog.folder_scan,
    "empty_input": catalog.empty_input,
}

__all__ = ["QUERIES", "ORACLE"]
