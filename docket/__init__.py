"""docket: document -> validated case analysis -> routed reports, on Spark.

Public surface::

    analyze(docs, analyzer=None, config=None)   # (filename, text) -> (filename, analysis, error)
    route(results)                              # successes fanned out to their reports
    report_lines(successes)                     # (report, filename, line_no, style, text)
    write_reports(lines, path)                  # partitioned, ordered report sink
    run_summary(results)                        # documents, successes, failures
    run(spark, docs, out_dir, ...)              # the whole run, every stage written
    run_folder(spark, folder, out_dir, ...)     # the same from a folder of .docx files
"""

from __future__ import annotations

from docket.config import Config, Lexicon
from docket.operators.analyze import Analyzer, RuleAnalyzer
from docket.operators.metrics import batch_stats, failure_listing, run_summary
from docket.operators.report import report_lines
from docket.operators.route import destinations as route
from docket.operators.route import split_results
from docket.plans.casework import ModelAnalyzer, run, run_folder
from docket.sinks.reports import read_reports, write_reports


def analyze(docs, analyzer=None, config: Config | None = None):
    """Results envelopes for ``docs`` with the rule analyzer, or any analyzer given
    (``RuleAnalyzer`` or ``ModelAnalyzer``)."""
    config = config or Config()
    return (analyzer or RuleAnalyzer(config.lexicon)).analyze(docs)


__all__ = [
    "Config",
    "Lexicon",
    "Analyzer",
    "RuleAnalyzer",
    "ModelAnalyzer",
    "analyze",
    "route",
    "split_results",
    "report_lines",
    "write_reports",
    "read_reports",
    "run_summary",
    "failure_listing",
    "batch_stats",
    "run",
    "run_folder",
]
