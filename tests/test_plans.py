"""Plan-shape guards: the analysis is evaluated once per row and scans are pruned."""

import re

import __spark_entry__ as E
from docket.queries import catalog
from docket.testing import SF_SMALL


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_quote_pages_not_inlined_below_the_generator(spark):
    plan = _optimized(E.queries()["quotes_with_page"](spark, SF_SMALL))
    # the page-marker extraction appears once; a filter pushed below the explode
    # would inline it (and the cases view) again
    assert plan.count("regexp_extract_all") <= 2
    assert len(plan) < 20_000


def test_argument_check_computed_once(spark):
    plan = _optimized(E.queries()["argument_citation_check"](spark, SF_SMALL))
    assert plan.count("<cite>") <= 2
    assert len(plan) < 20_000


def test_flagship_reads_only_text_and_joins_the_spine(spark):
    df = E.queries()["relevance_support_matrix"](spark, SF_SMALL)
    phys = _physical(df)
    assert "ReadSchema: struct<text:string>" in phys
    assert "CartesianProduct" not in phys and "BroadcastNestedLoopJoin" not in phys
    opt = _optimized(df)
    # one lexicon pass per row: the closed domain is applied by the join with the
    # spine, so no filter re-evaluates the analysis below the aggregate
    assert opt.count("regexp_extract_all") == 1


def test_report_lines_first_cases_without_sorting(spark):
    df = E.queries()["report_lines"](spark, SF_SMALL)
    df._jdf.queryExecution().toRdd().count()
    phys = _physical(df)
    # the per-report minimum is a keyless aggregate of 12 conditional minimums:
    # no sort of the routed rows, and only its <= 12 rows are broadcast
    assert not re.search(r"Sort \[report#\d+", phys)
    assert re.search(r"BroadcastHashJoin \[report#\d+\]", phys)
    assert "CartesianProduct" not in phys


def test_narrow_results_compute_no_other_field(spark):
    full = _optimized(catalog.envelopes(spark, SF_SMALL))
    assert "quote" in full and "summary" in full
    for fields in (catalog.LEVELS, ("blue_book_citation",)):
        plan = _optimized(catalog.envelopes(spark, SF_SMALL, *fields))
        assert not re.search(r"quote|_body_sents|citations|key_points", plan.replace(", summary, citations, argument", ""))
        assert len(plan) < len(full) / 2
    assert "thtion" not in _optimized(E.queries()["run_summary"](spark, SF_SMALL))  # no term is sought


def test_documents_are_not_shuffled_by_default(spark):
    assert "Exchange" not in _physical(E.queries()["case_summary"](spark, SF_SMALL))
