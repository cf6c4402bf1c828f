"""Materialisation of intermediate tables in the shared checkpoint location."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docket.session import shared_dir


def materialize(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet",
                observation=None, *metrics) -> DataFrame:
    """Write ``df`` once and return a reader over the written table.

    Used after expensive or non-deterministic stages (analysis, model calls):
    every later filter, aggregate and report reads the files instead of
    re-running the stage, and the lineage is cut there, so a lost executor
    re-reads files rather than recomputing the stage. With an ``observation``,
    ``metrics`` are aggregated during the same write (no second pass).
    """
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    if observation is not None:
        # metrics gathered by the write itself (successful task attempts only)
        df = df.observe(observation, *metrics)
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)
