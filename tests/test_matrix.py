"""The 3 x 3 relevance/support matrix against the expected fixture counts."""

import pytest

from docket.config import FIXTURE_LEXICON
from docket.operators.analyze import RuleAnalyzer
from docket.operators.route import matrix
from docket.sources.documents import SCAN_TASKS, documents, spread, table
from docket.testing import SF_MID, SF_SMALL
from pyspark.sql import functions as F


SF_BIG = "/root/testdata/sf0.1"

# Expected counts from FIXTURES.md section 4 (rows High, Medium, Low; columns
# Strongly Supports, Supports, Does not Support).
EXPECTED = {
    SF_SMALL: [[3, 0, 0], [11, 7, 21], [10, 16, 132]],
    SF_MID: [[6, 4, 10], [62, 49, 93], [51, 68, 657]],
    SF_BIG: [[78, 27, 41], [693, 465, 816], [512, 796, 6572]],
}
LEVELS = ["High", "Medium", "Low"]
SUPPORT = ["Strongly Supports", "Supports", "Does not Support"]


def _matrix(spark, docs):
    feats = RuleAnalyzer(FIXTURE_LEXICON).features(docs).select(
        F.struct("relevance_level", "support_level").alias("analysis")
    )
    got = {(r["relevance_level"], r["support_level"]): r["n_cases"] for r in matrix(spark, feats).collect()}
    return [[got[(r, s)] for s in SUPPORT] for r in LEVELS]


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID, SF_BIG])
def test_expected_counts(spark, sf):
    assert _matrix(spark, documents(spark, sf)) == EXPECTED[sf]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partition_invariance(spark, parts):
    d = table(spark, SF_SMALL, "documents").select("doc_id", "text").repartition(parts)
    d = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("filename"), "doc_id", "text")
    assert _matrix(spark, d) == EXPECTED[SF_SMALL]


def test_spread_is_the_callers_choice(spark):
    d = table(spark, SF_SMALL, "documents")
    assert spread(d) is d
    assert spread(d, 4).rdd.getNumPartitions() == 4
    spark.conf.set(SCAN_TASKS, "6")
    try:
        assert spread(d).rdd.getNumPartitions() == 6
    finally:
        spark.conf.unset(SCAN_TASKS)
