"""Report sink (R23-R25): ordered, partitioned report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reports(lines: DataFrame, path: str, partitions: int | None = None,
                  replace_all: bool = False, fmt: str = "parquet", batch_id: int | None = None) -> None:
    """Write ``report_lines`` as ``folder=<level folder>/name=<report>/part-*``.

    Rows are range-partitioned on (report, filename), so a large report spans
    many files (no single task per report) while every case stays in one file;
    each file is sorted by (report, filename, line_no) and part files follow the
    range order. Only the reports present in this run are replaced (dynamic
    partition overwrite), like saving only the non-empty reports; pass
    ``replace_all=True`` to drop stale reports as well. With ``batch_id`` the
    lines go to ``.../batch=<id>`` under their report (an incremental append that
    a re-run of the same batch replaces); read them in (batch, filename, line_no) order.
    """
    named = lines.withColumn("folder", F.substring_index("report", "/", 1)).withColumn(
        "name", F.substring_index("report", "/", -1)
    )
    # without an explicit count the session's shuffle partitions are the most; AQE merges small ones
    ranged = (
        named.repartitionByRange(partitions, "report", "filename")
        if partitions
        else named.repartitionByRange("report", "filename")
    )
    parts = ["folder", "name"]
    out = ranged.drop("report")
    if batch_id is not None:
        out = out.withColumn("batch", F.lit(int(batch_id)).cast("bigint"))
        parts.append("batch")
    # Sort by the partition columns first: the writer needs rows grouped by them, and
    # with this order it adds no sort of its own (a re-sort could reorder lines of
    # equal keys once it spills). (folder, name) orders exactly like the report name.
    out = out.sortWithinPartitions(*parts, "filename", "line_no")
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if replace_all else "dynamic")
        .partitionBy(*parts)
        .format(fmt)
        .save(path)
    )


def read_reports(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a report sink back as ``(report, filename, line_no, style, text)``."""
    df = spark.read.option("basePath", path).format(fmt).load(path)
    return df.select(
        F.concat(F.col("folder").cast("string"), F.lit("/"), F.col("name").cast("string")).alias("report"),
        "filename",
        "line_no",
        "style",
        "text",
    )
