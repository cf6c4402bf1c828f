"""Incremental folder ingest with Structured Streaming.

A ``binaryFile`` stream lists new ``*.docx`` files under a folder; each
micro-batch is extracted, analysed (rule analyzer or model) and appended to the
results table, and the report lines of its own cases are appended under
``batch=<id>`` in their reports, so a batch costs what it brings, not what came
before. Cases in a report are ordered by (batch, filename): only the first case
of a report's first batch has no page break. The stream's checkpoint records
which files were consumed, and every output of a micro-batch is written to a
folder named by its batch id with overwrite, so a re-run batch after a failure
replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docket.config import Config
from docket.operators.analyze import RuleAnalyzer
from docket.operators.report import report_lines
from docket.operators.requests import PromptTemplate, requests_table
from docket.operators.route import destinations, split_results
from docket.plans.casework import analyze_requests
from docket.sinks.reports import write_reports
from docket.session import ship_package
from docket.sources.docx import EXTRACT_DDL, _extract

BINARY_FILE_DDL = "path string, modificationTime timestamp, length bigint, content binary"


def process_batch(batch: DataFrame, batch_id: int, out_dir: str, config: Config,
                  analyzer: RuleAnalyzer | None = None, client_factory: Callable[[], object] | None = None,
                  template: PromptTemplate | None = None) -> None:
    """One micro-batch: extract, analyse, append results, rebuild the touched reports."""
    spark = batch.sparkSession
    out = out_dir.rstrip("/")
    extracted = batch.select("path", "content").mapInPandas(_extract, EXTRACT_DDL)
    extracted.write.mode("overwrite").parquet(f"{out}/extracted/batch={batch_id}")
    extracted = spark.read.parquet(f"{out}/extracted/batch={batch_id}")
    docs = extracted.where(F.col("error").isNull()).select("filename", "text")
    if docs.isEmpty():
        return
    requests = requests_table(docs, config, template)
    results, _ = analyze_requests(requests, config, analyzer, client_factory, f"{out}/responses", template)
    results.select("filename", "analysis", "error").write.mode("overwrite").parquet(f"{out}/results/batch={batch_id}")

    new = spark.read.parquet(f"{out}/results/batch={batch_id}")
    new_ok, _ = split_results(new)
    # Only this batch's cases are rendered and appended under batch=<id>; the
    # registry (<= 12 rows per batch) says which reports already have a first case.
    registry = f"{out}/report_registry"
    earlier = _read(spark, registry)
    continued = (
        earlier.where(F.col("batch") < batch_id).select("report").distinct()
        if earlier is not None
        else spark.range(0).select(F.lit("").alias("report"))
    )
    write_reports(report_lines(new_ok, continued=continued), f"{out}/reports", batch_id=batch_id)
    touched = destinations(new_ok).select("report").distinct()
    touched.write.mode("overwrite").parquet(f"{registry}/batch={batch_id}")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def watch_folder(spark: SparkSession, folder: str, out_dir: str, checkpoint: str, config: Config | None = None,
                 analyzer: RuleAnalyzer | None = None, client_factory: Callable[[], object] | None = None,
                 template: PromptTemplate | None = None, max_files_per_trigger: int | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Start the stream. ``available_now`` processes what is there and stops;
    otherwise it polls the folder every ten seconds."""
    config = config or Config()
    ship_package(spark)
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_DDL)
        .option("pathGlobFilter", "*.docx")
        .option("recursiveFileLookup", "false")
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = reader.load(folder)
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: process_batch(df, bid, out_dir, config, analyzer, client_factory, template)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
