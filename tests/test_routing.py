"""Routing laws (R14-R19) on the planted results."""

import pytest
from pyspark.sql import functions as F

from docket.operators.route import destinations, split_results
from docket.queries.catalog import results
from docket.schema import RELEVANCE_LEVELS, SUPPORT_LEVELS
from docket.testing import SF_MID


@pytest.fixture(scope="module")
def res(spark):
    return results(spark, SF_MID)


def test_total_is_success_plus_failed(res):
    ok, bad = split_results(res)
    assert res.count() == ok.count() + bad.count()


def test_empty_error_string_is_success(res):
    ok, _ = split_results(res)
    assert ok.where(F.col("error") == "").count() > 0


def test_conservation_laws(res):
    ok, _ = split_results(res)
    rows = ok.select("analysis.relevance_level", "analysis.support_level").collect()
    rel_in = [r for r in rows if r[0] in RELEVANCE_LEVELS]
    assert len(rows) == len(rel_in) + sum(1 for r in rows if r[0] not in RELEVANCE_LEVELS)
    both = [r for r in rel_in if r[1] in SUPPORT_LEVELS]
    assert 0 < len(both) < len(rel_in) < len(rows)  # the planted noise hits both domains
    for level in RELEVANCE_LEVELS:
        lvl = [r for r in rel_in if r[0] == level]
        combos = sum(1 for r in both if r[0] == level)
        assert len(lvl) == combos + sum(1 for r in lvl if r[1] not in SUPPORT_LEVELS)


def test_in_domain_case_in_exactly_two_reports(res):
    ok, _ = split_results(res)
    d = destinations(ok).groupBy("filename").agg(F.count("*").alias("n"), F.first("analysis").alias("a"))
    for r in d.collect():
        a = r["a"]
        expect = (a["relevance_level"] in RELEVANCE_LEVELS) + (
            a["relevance_level"] in RELEVANCE_LEVELS and a["support_level"] in SUPPORT_LEVELS
        )
        assert r["n"] == expect


def test_report_names(res):
    ok, _ = split_results(res)
    names = {r[0] for r in destinations(ok).select("report").distinct().collect()}
    assert "high_relevance/high_relevance_analysis" in names
    assert all(n.split("/")[0] in ("high_relevance", "medium_relevance", "low_relevance") for n in names)
    assert len(names) <= 12
