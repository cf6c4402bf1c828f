"""Run metrics (R26-R28), each a single aggregate pass over a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.operators.route import is_failure


def run_summary(results: DataFrame) -> DataFrame:
    """Documents, successes and failures in one aggregate (partial per task)."""
    failed = is_failure()
    return results.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_documents"),
        F.count_if(~failed).cast("bigint").alias("n_success"),
        F.count_if(failed).cast("bigint").alias("n_failed"),
    )


def failure_listing(results: DataFrame) -> DataFrame:
    """``(filename, error)`` of every failed document."""
    return results.where(is_failure()).select("filename", F.coalesce(F.col("error"), F.lit("")).alias("error"))


def batch_intervals(responses: DataFrame) -> DataFrame:
    """When each batch ran, from the start and length of its requests (``batch_no, began_s, latency_s``).

    ``elapsed_s`` from the first start to the last end, ``idle_s`` of it without any request
    under way (gaps between the union of the intervals), ``overlap`` requests at once on
    average while any was. Requests without stamps count in ``n_requests`` alone.
    """
    ends = F.col("began_s") + F.col("latency_s")
    before = Window.partitionBy("batch_no").orderBy("began_s", ends).rowsBetween(Window.unboundedPreceding, -1)
    timed = responses.select("batch_no", "began_s", "latency_s", ends.alias("ends"),
                             F.greatest(F.col("began_s") - F.max(ends).over(before), F.lit(0.0)).alias("gap"))
    # the first request of a batch has none before it: greatest() skips its null and gives no gap
    found = timed.groupBy("batch_no").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_requests"), F.max("latency_s").alias("max_latency_s"),
        (F.max("ends") - F.min("began_s")).alias("elapsed_s"),
        F.when(F.max("ends").isNotNull(), F.sum(F.when(F.col("ends").isNotNull(), F.col("gap")))).alias("idle_s"),
        F.sum("latency_s").alias("work_s"))
    return found.select("batch_no", "n_requests", "max_latency_s", "elapsed_s", "idle_s",
                        F.try_divide("work_s", F.col("elapsed_s") - F.col("idle_s")).alias("overlap"))


def batch_stats(responses: DataFrame) -> DataFrame:
    """Requests per batch and the slowest call's seconds (``batch_no`` required)."""
    return responses.groupBy("batch_no").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_requests"),
        F.max("latency_s").alias("max_latency_s"),
    )
