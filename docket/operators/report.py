"""Report projection (R20-R22): each case as ordered, styled report lines.

A case is rendered once into an ``array<struct<style, text>>`` and fanned out to
its (up to two) reports; ``posexplode`` turns it into rows. Line numbers are per
case, so ordering a report needs no global window: ``(report, filename, line_no)``
is the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.operators.route import destinations, report_names

# Headings, labels and rule of the case report layout (the order of
# sections is: title, rule, summary, relevancy, support level, argument, key
# points, citations, quotes).
TITLE_PREFIX = "Case Analysis: "
RULE_LINE = "_" * 50
HEADINGS = (
    "SUMMARY",
    "RELEVANCY",
    "SUPPORT LEVEL",
    "ARGUMENT",
    "KEY POINTS RELATED TO SPOLIATION",
    "CITATIONS",
    "QUOTES",
)
RELEVANCE_LABEL = "Relevance Level: "
REASONING_LABEL = "Reasoning: "
SUPPORT_LABEL = "Support Level: "

# Paragraph styles kept as data.
TITLE, HEADING, BODY, BULLET, RULE, PAGE_BREAK = "Heading 1", "Heading 2", "Body", "List Bullet", "Rule", "Page Break"

LINE_DDL = "array<struct<style:string,text:string>>"


def _line(style: str, text: Column) -> Column:
    return F.struct(F.lit(style).alias("style"), text.alias("text"))


def _heading(text: str) -> Column:
    return F.array(_line(HEADING, F.lit(text)))


def _bullets(items: Column) -> Column:
    return F.transform(items, lambda x: _line(BULLET, x))


def case_lines(a: str = "analysis") -> Column:
    """The styled paragraphs of one case, in report order."""
    f = lambda n: F.col(f"{a}.{n}")
    head = F.array(
        _line(TITLE, F.concat(F.lit(TITLE_PREFIX), f("blue_book_citation"))),
        _line(RULE, F.lit(RULE_LINE)),
        _line(HEADING, F.lit(HEADINGS[0])),
        _line(BODY, f("summary")),
        _line(HEADING, F.lit(HEADINGS[1])),
        _line(
            BODY,
            F.concat(F.lit(RELEVANCE_LABEL), f("relevance_level"), F.lit("\n"),
                     F.lit(REASONING_LABEL), f("reasoning"), F.lit("\n")),
        ),
        _line(HEADING, F.lit(HEADINGS[2])),
        _line(BODY, F.concat(F.lit(SUPPORT_LABEL), f("support_level"), F.lit("\n"))),
        _line(HEADING, F.lit(HEADINGS[3])),
        _line(BODY, f("argument")),
    )
    return F.concat(
        head,
        _heading(HEADINGS[4]),
        _bullets(f("key_points")),
        _heading(HEADINGS[5]),
        _bullets(f("citations")),
        _heading(HEADINGS[6]),
        _bullets(f("quotes")),
    )


def first_cases(routed: DataFrame) -> DataFrame:
    """``(report, _first)``: the smallest file name routed to each report (<= 12 rows).

    The report names form a closed set of 12, so this is one global aggregate of
    12 conditional minimums: each task keeps 12 strings and no row is sorted or
    shuffled, however large a report is.
    """
    names = report_names()
    mins = routed.agg(
        *[F.min(F.when(F.col("report") == F.lit(n), F.col("filename"))).alias(f"_m{i}") for i, n in enumerate(names)]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("report"), F.col(f"_m{i}").alias("_first")) for i, n in enumerate(names)])
    return mins.select(F.inline(rows)).where(F.col("_first").isNotNull())


def report_lines(successes: DataFrame, continued: DataFrame | None = None) -> DataFrame:
    """R20-R22 + R24: ``(report, filename, line_no, style, text)`` for every routed case.

    The first case of a report (smallest file name) has no page break; the
    per-report minimum (:func:`first_cases`, <= 12 rows) is broadcast. Reports
    listed in ``continued`` (a ``report`` column, <= 12 rows) already have
    earlier cases, so every case here gets a break (incremental appends).
    """
    rendered = successes.select("filename", "analysis", case_lines().alias("_lines"))
    routed = destinations(rendered).drop("analysis")
    firsts = first_cases(routed)
    if continued is not None:
        firsts = firsts.join(F.broadcast(continued.select("report").distinct()), "report", "left_anti")
    brk = F.array(_line(PAGE_BREAK, F.lit(""))).cast(LINE_DDL)
    empty = F.array().cast(LINE_DDL)
    first = F.coalesce(F.col("filename") == F.col("_first"), F.lit(False))
    with_break = routed.join(F.broadcast(firsts), "report", "left").select(
        "report",
        "filename",
        F.concat(F.when(first, empty).otherwise(brk), F.col("_lines")).alias("_l"),
    )
    return with_break.select("report", "filename", F.posexplode("_l").alias("line_no", "_x")).select(
        "report", "filename", F.col("line_no").cast("bigint").alias("line_no"), "_x.style", "_x.text"
    )
