"""Success/failure split, level filters, closed-domain grouping and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.schema import RELEVANCE_LEVELS, SUPPORT_LEVELS



def REL() -> Column:
    return F.col("analysis.relevance_level")


def SUP() -> Column:
    return F.col("analysis.support_level")


def is_failure() -> Column:
    """An envelope is a failure when it has no analysis or a non-empty error."""
    return F.col("analysis").isNull() | (F.coalesce(F.col("error"), F.lit("")) != "")


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successes, failures). Read a written results table, not a live inference plan."""
    return results.where(~is_failure()), results.where(is_failure())


def level_filter(successes: DataFrame, *levels: str) -> DataFrame:
    """Exact, case-sensitive match on the relevance level (any of the given ones, in one pass)."""
    return successes.where(REL().isin(*levels))


def in_domain(rel: Column | None = None, sup: Column | None = None) -> Column:
    """Both levels inside their closed domains."""
    rel = REL() if rel is None else rel
    sup = SUP() if sup is None else sup
    return rel.isin(*RELEVANCE_LEVELS) & sup.isin(*SUPPORT_LEVELS)


def _literal_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small literal table built inside the JVM (inline of an array of structs)."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def domain_spine(spark: SparkSession) -> DataFrame:
    """The 3 x 3 (relevance, support) spine with its display order."""
    rows = [
        {"relevance_level": r, "r_ord": i, "support_level": s, "s_ord": j}
        for i, r in enumerate(RELEVANCE_LEVELS)
        for j, s in enumerate(SUPPORT_LEVELS)
    ]
    return _literal_rows(spark, rows)


def matrix(spark: SparkSession, successes: DataFrame) -> DataFrame:
    """All nine combinations with their counts; empty ones get 0.

    Counts are grouped over every (relevance, support) pair and the closed
    domain is applied by the join with the nine-row spine, not by a filter: a
    filter on the analysis columns would be pushed below the analysis and
    inline it a second time. The counts side has one row per distinct label
    pair; AQE measures it at run time and broadcasts the smaller side.
    """
    counts = successes.groupBy(REL().alias("relevance_level"), SUP().alias("support_level")).agg(
        F.count(F.lit(1)).alias("n_cases")
    )
    spine = domain_spine(spark)
    return spine.join(counts, ["relevance_level", "support_level"], "left").select(
        "relevance_level", "support_level", F.coalesce(F.col("n_cases"), F.lit(0)).cast("bigint").alias("n_cases")
    )


def level_report(level: Column) -> Column:
    """Destination of the per-level report, or null when out of domain."""
    folder = F.concat(F.lower(level), F.lit("_relevance"))
    return F.when(level.isin(*RELEVANCE_LEVELS), F.concat(folder, F.lit("/"), folder, F.lit("_analysis")))


def combo_report(level: Column, support: Column) -> Column:
    """Destination of the (relevance, support) report, or null when out of domain."""
    folder = F.concat(F.lower(level), F.lit("_relevance"))
    return F.when(
        in_domain(level, support),
        F.concat(folder, F.lit("/Relevance "), level, F.lit(" - "), support),
    )


def destinations(successes: DataFrame) -> DataFrame:
    """Each success with the (up to two) reports it belongs to, one row per report.

    Both routings are built first and only non-null ones are kept, which keeps
    their unequal strictness: an out-of-domain support still reaches the level report.
    """
    return successes.select(
        "*",
        F.explode(
            F.filter(
                F.array(level_report(REL()), combo_report(REL(), SUP())),
                lambda x: x.isNotNull(),
            )
        ).alias("report"),
    )


def report_names() -> list[str]:
    """Names of all 12 possible reports (3 levels + 9 combinations), in display order."""
    names = []
    for r in RELEVANCE_LEVELS:
        folder = r.lower() + "_relevance"
        names.append(f"{folder}/{folder}_analysis")
        names += [f"{folder}/Relevance {r} - {s}" for s in SUPPORT_LEVELS]
    return names


def report_spine(spark: SparkSession) -> DataFrame:
    """All 12 possible reports as a literal table."""
    return _literal_rows(spark, [{"report": n} for n in report_names()])
