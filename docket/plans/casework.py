"""End-to-end case analysis run.

    documents ─► analysis ─► results (written, with run counts observed)
        results ─► report lines ─► partitioned reports (written)
        results ─► failure listing, batch stats (written)

Two analysis paths share everything else:

* ``RuleAnalyzer`` (default): Spark expressions, no Python, no network.
* a model client factory: ``answer`` calls the model once per distinct request
  key, appends the answers to a response store and skips keys already answered
  successfully on a re-run; ``validate`` then checks each answer strictly.

Every stage that is expensive or non-deterministic is written before anything
reads it twice, so the lineage is cut at each write and a lost executor re-reads
files instead of re-calling the model.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docket.config import Config
from docket.operators.analyze import Analyzer, RuleAnalyzer
from docket.operators.infer import RESPONSE_DDL, ClientFactory, infer
from docket.operators.metrics import batch_intervals, failure_listing
from docket.operators.report import report_lines
from docket.operators.requests import PromptTemplate, batches, requests_table
from docket.operators.route import is_failure, split_results
from docket.operators.validate import validate
from docket.session import shared_dir
from docket.sinks.publish import publish_reports
from docket.sinks.reports import write_reports
from docket.sinks.tables import materialize


@dataclass
class RunResult:
    n_documents: int
    results: DataFrame | None = None
    summary: DataFrame | None = None
    failures: DataFrame | None = None
    batch_stats: DataFrame | None = None
    reports_path: str | None = None
    n_quarantined: int = 0
    elapsed_s: float = 0.0


def _read_store(spark: SparkSession, store: str, buckets: list[str] | None = None) -> DataFrame | None:
    """The answers of a response store, or of some of its buckets; None if there are none.

    Only the folders of these buckets are listed and read. Files beside them (of a store
    written before there were buckets) are always read; files written before a column was
    added have nulls there.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return None
    wanted = None if buckets is None else {f"bucket={b}" for b in buckets}
    paths = []
    for status in system.listStatus(place):  # one entry per bucket, and the files beside them
        name = status.getPath().getName()
        of_bucket = status.isDirectory() and name.startswith("bucket=")
        if (of_bucket and (wanted is None or name in wanted)) or (status.isFile() and not name.startswith(("_", "."))):
            paths.append(status.getPath().toString())
    return spark.read.schema(RESPONSE_DDL).parquet(*paths) if paths else None


def _bucket(digits: int) -> Column:
    """The bucket of a request key: its first hex digits, evenly spread since keys are SHA-256."""
    return F.substring("request_key", 1, digits)


def _write_store(answers: DataFrame, store: str, digits: int, mode: str) -> None:
    answers.withColumn("bucket", _bucket(digits)).write.mode(mode).partitionBy("bucket").parquet(store)


def _store_digits(spark: SparkSession, store: str, default: int) -> int:
    """Digits of the buckets that a store has; a store keeps the number it was begun with."""
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place):
        for status in system.listStatus(place):
            name = status.getPath().getName()
            if status.isDirectory() and name.startswith("bucket="):
                return len(name) - len("bucket=")
    return default


def _rank() -> Column:
    """Order among the answers to one key: a success first, then the content, so reads agree."""
    ok = F.when(F.col("error").isNull(), 1).otherwise(0)
    return F.struct(ok, F.coalesce("response", "error", F.lit("")), "attempts", "latency_s")


def best_answers(stored: DataFrame) -> DataFrame:
    """One row per request key, ``a`` = the best stored answer (a success beats a dead letter).

    A partial aggregate: every key's rows are combined map-side first.
    """
    return stored.groupBy("request_key").agg(
        F.max_by(
            F.struct(*[c for c in ("response", "error", "attempts", "waited_ms", "latency_s", "began_s") if c in stored.columns]),
            _rank(),
        ).alias("a")
    )


def compact_store(spark: SparkSession, store: str, target: str, digits: int = Config.store_digits) -> DataFrame:
    """Write the best answer per key of ``store`` to ``target`` and return it.

    Appends from many runs (and dead letters later answered) accumulate in a
    response store; the compacted copy has one row per key, in ``16 ** digits`` buckets of
    keys, one file or a few in each. Nothing is deleted: point later runs at ``target``.
    """
    stored = _read_store(spark, store)
    if stored is None:
        raise ValueError(f"no answers in {store}")
    others = [c for c in stored.columns if c != "request_key"]
    best = stored.groupBy("request_key").agg(
        F.max_by(F.struct(*others), _rank()).alias("a")
    )
    best = best.select("request_key", "a.*").select(*stored.columns)
    _write_store(best.repartitionByRange("request_key"), target, digits, "overwrite")
    compacted = _read_store(spark, target)
    return spark.createDataFrame([], RESPONSE_DDL) if compacted is None else compacted


def answer(requests: DataFrame, client_factory: ClientFactory, config: Config, store: str,
           template: PromptTemplate | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Model answers for every request, paying once per distinct, unanswered request key.

    Duplicate texts share one call (the partial aggregate collapses a hot key on
    the map side before the shuffle). Answers are appended to ``store``; a task
    retried after executor loss may repeat its calls, but the job commit keeps
    one copy of its rows. Failed keys are tried again on the next run. The store is cut into
    buckets by the first digits of the key, and only those of this run's keys are read: what a
    run of few requests reads does not grow with all that was ever asked.
    """
    spark = requests.sparkSession
    target = keys if keys is not None else requests
    digits = _store_digits(spark, store, config.store_digits)
    # at most 16 ** digits values, whatever the number of keys
    buckets = [r[0] for r in target.select(_bucket(digits)).distinct().collect()]
    # one file per key is picked on narrow rows, and only the texts to be asked about move
    wanted = target.groupBy("request_key").agg(F.min("filename").alias("filename"))
    stored = _read_store(spark, store, buckets)
    if stored is not None:
        done = stored.where(F.col("error").isNull()).select("request_key")
        wanted = wanted.join(done, "request_key", "left_anti")
    file = F.coalesce("filename", F.lit("")).alias("_file")
    # the keys to ask for are written: their number sets the waves and their tasks
    obs = Observation("wanted")
    wanted = materialize(wanted, "wanted", None, "parquet", obs, F.count(F.lit(1)).alias("n"))
    n_todo = int(obs.get["n"])
    if n_todo:
        todo = requests.select("filename", "text", "request_key", file).join(
            wanted.select("request_key", file), ["_file", "request_key"], "left_semi")
        todo = todo.dropDuplicates(["_file", "request_key"]).drop("_file")  # of repeated rows; dealt out as the join is
        ask_in_waves(todo, n_todo, client_factory, config, store, template)
        stored = _read_store(spark, store, buckets)
    if stored is None:  # nothing was asked, now or before
        stored = spark.createDataFrame([], RESPONSE_DDL)
    # of a store that grows with history only this run's keys are read on
    asked = target.select("request_key").distinct()
    best = best_answers(stored.join(asked, "request_key", "left_semi"))
    # answers go back to every file by key; ``keys`` (filename, request_key), when
    # given, spares a second read of the texts
    return join_answers(target, best)


def ask_in_waves(todo: DataFrame, n_todo: int, client_factory: ClientFactory, config: Config, store: str,
                 template: PromptTemplate | None = None) -> None:
    """Ask for ``n_todo`` requests, wave after wave, appending the answers to ``store``.

    The work queue is written first, by wave (a hash of the request key), so a retried task
    re-reads its slice. A wave is one job of about ``tasks_per_wave`` tasks; when its answers are
    committed, a record follows in ``<store>_waves``. A run that is killed has the answers of its
    finished waves in the store: the next run asks for the rest alone.
    """
    spark = todo.sparkSession
    n_waves = -(-n_todo // (config.requests_per_task * config.tasks_per_wave))
    queue = shared_dir(spark, "todo")
    digits = _store_digits(spark, store, config.store_digits)
    dealt = todo.withColumn("wave", F.pmod(F.xxhash64("request_key"), F.lit(n_waves)).cast("int"))
    if n_waves > 1:  # a wave's rows in few files, not in one per task of the join
        dealt = dealt.repartition("wave", F.pmod(F.xxhash64("filename"), F.lit(max(1, config.tasks_per_wave // 100))))
    dealt.write.mode("overwrite").partitionBy("wave").parquet(queue)
    for k in range(n_waves):
        began = time.time()
        mine = spark.read.parquet(queue).where(F.col("wave") == k).drop("wave")
        answers = infer(mine, client_factory, config, template, n_requests=-(-n_todo // n_waves))
        obs = Observation(f"wave {k}")
        _write_store(answers.observe(obs, F.count(F.lit(1)).alias("n")), store, digits, "append")
        record = spark.range(1).select(
            F.lit(k).alias("wave"), F.lit(n_waves).alias("n_waves"), F.lit(int(obs.get["n"])).alias("n_answers"),
            F.lit(began).alias("began_s"), F.lit(time.time() - began).alias("elapsed_s"))
        record.write.mode("append").parquet(store.rstrip("/") + "_waves")


def join_answers(target: DataFrame, best: DataFrame, unit: int = 10_000, most_hot: int = 10_000) -> DataFrame:
    """``target`` with the answer to each row's key; a key of many rows is split over several tasks.

    A row is narrow until its answer is joined on, so the skew is not seen in the
    bytes of the input. A key's rows are dealt over one place per ``unit`` rows and its
    answer is copied to each. ``unit`` is never below the rows / ``most_hot``: fewer than
    ``most_hot`` keys can hold more than that, which bounds the broadcast table of them
    and, with twice that, the copies.
    """
    unit = max(unit, -(-target.count() // most_hot))
    rows = target.groupBy("request_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > unit)
    hot = F.broadcast(rows.select("request_key", F.ceil(F.col("_n") / F.lit(unit)).alias("_ways")))
    ways = F.coalesce("_ways", F.lit(1))
    dealt = target.join(hot, "request_key", "left").withColumn("_place", F.pmod(F.xxhash64("filename"), ways))
    copies = best.join(hot, "request_key", "left").withColumn("_place", F.explode(F.sequence(F.lit(0), ways - 1)))
    joined = dealt.drop("_ways").join(copies.drop("_ways"), ["request_key", "_place"])
    return joined.select(*target.columns, "a.*")


def analyze_requests(requests: DataFrame, config: Config, analyzer: Analyzer | None = None,
                     client_factory: Callable[[], object] | None = None, store: str | None = None,
                     template: PromptTemplate | None = None,
                     keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Requests -> (results envelopes, model answers or None). Nothing is written here
    except the model's work queue and response store."""
    if client_factory is not None:
        if store is None:
            raise ValueError("a response store path is required with a model client")
        answered = answer(requests, client_factory, config, store, template, keys)
        return validate(answered.drop("text")), answered
    analyzer = analyzer or RuleAnalyzer(config.lexicon)
    return analyzer.analyze(requests), None


def run(
    spark: SparkSession,
    docs: DataFrame,
    out_dir: str,
    config: Config | None = None,
    analyzer: Analyzer | None = None,
    client_factory: Callable[[], object] | None = None,
    template: PromptTemplate | None = None,
    only_candidates: bool = False,
    replace_all: bool = False,
    publish: bool = False,
) -> RunResult:
    """Analyse ``docs`` ``(filename, text)`` and write results, reports and metrics under ``out_dir``.

    With ``publish`` the reports go to ``<out_dir>/published`` as one committed set
    (:mod:`docket.sinks.publish`), which readers see whole or not at all.

    ``docs`` should be a stable source (a table, or a written extraction): it is
    read by the analysis and, on the model path, again to join answers back.
    """
    config = config or Config()
    out = out_dir.rstrip("/")
    started = time.monotonic()
    if only_candidates:
        # E10 before any paid call: Catalyst cannot push a filter through a Python stage.
        from docket.functions.extract import is_candidate

        docs = docs.where(is_candidate(F.lower("text"), config.lexicon))
    docs = docs.select("filename", "text")
    # No copy of the corpus is written here: the source is re-read where needed
    # (run_folder passes its written extraction). The model path writes its own,
    # smaller work queue of distinct unanswered texts.
    keys = None
    requests = docs
    if client_factory is not None:
        requests = requests_table(docs, config, template)
        # (filename, request_key) only -- about a hundred bytes a file -- written once
        keys = materialize(requests.select("filename", "request_key"), "request_keys", f"{out}/request_keys")
        if keys.isEmpty():  # R05 on the model path: nothing to ask
            return RunResult(n_documents=0)

    stats = None
    results, answered = analyze_requests(requests, config, analyzer, client_factory, f"{out}/responses",
                                         template, keys)
    stats_src = None
    if answered is not None:
        numbered = batches(keys.select("filename"), config.max_concurrent_requests)
        stats_src = answered.select("filename", "latency_s", "began_s").join(numbered, "filename")
    obs = Observation("run_summary")
    failed = is_failure()
    results = materialize(
        results.select("filename", "analysis", "error"), "results", f"{out}/results", "parquet", obs,
        F.count(F.lit(1)).alias("n_documents"), F.count_if(~failed).alias("n_success"),
        F.count_if(failed).alias("n_failed"),
    )
    counts = obs.get  # R26 from the results write itself
    if int(counts["n_documents"]) == 0:
        # Empty input -- no model call was made, no report or summary is written
        return RunResult(n_documents=0)

    ok, _ = split_results(results)
    reports = f"{out}/published" if publish else f"{out}/reports"
    if publish:
        publish_reports(report_lines(ok), reports, replace_all=replace_all)
    else:
        write_reports(report_lines(ok), reports, replace_all=replace_all)
    elapsed = round(time.monotonic() - started, 3)
    summary = spark.range(1).select(
        *[F.lit(int(counts[k])).alias(k) for k in ("n_documents", "n_success", "n_failed")],
        F.lit(elapsed).alias("elapsed_s"),
    )
    summary = materialize(summary, "summary", path=f"{out}/summary")
    failures = materialize(failure_listing(results), "failures", path=f"{out}/failures")
    if stats_src is not None:
        stats = materialize(batch_intervals(stats_src), "batch_stats", path=f"{out}/batch_stats")
    return RunResult(n_documents=int(counts["n_documents"]), results=results, summary=summary, failures=failures,
                     batch_stats=stats, reports_path=reports, elapsed_s=elapsed)


def run_folder(spark: SparkSession, folder: str, out_dir: str,
               reader: Callable[[SparkSession, str], DataFrame] | None = None, **kwargs) -> RunResult:
    """The whole flow from a folder of ``.docx`` files (R01-R05 then :func:`run`).

    ``reader`` lists and extracts: ``sources.folder.read_docx_files`` unless given, which tries
    every entry whose name ends so; ``sources.docx.read_docx_folder`` is Spark's own listing.
    Extraction runs once and is written; unreadable files go to
    ``<out_dir>/quarantine`` and are counted in neither total nor failures. The
    quarantine count comes from an ``Observation`` on the extraction write.
    """
    from docket.sources.docx import quarantine, readable
    from docket.sources.folder import read_docx_files

    out = out_dir.rstrip("/")
    obs = Observation("ingest")
    extracted = materialize(
        (reader or read_docx_files)(spark, folder), "extracted", f"{out}/extracted", "parquet", obs,
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("error").isNotNull()).alias("n_quarantined"),
    )
    quarantine(extracted).write.mode("overwrite").parquet(f"{out}/quarantine")
    result = run(spark, readable(extracted), out_dir, **kwargs)
    result.n_quarantined = int(obs.get["n_quarantined"])
    return result


class ModelAnalyzer:
    """A model behind the same ``analyze(docs)`` interface as :class:`RuleAnalyzer`.

    ``client_factory`` builds one client per task; answers are appended to
    ``store`` (and reused by later calls), each validated strictly.
    """

    def __init__(self, client_factory: ClientFactory, store: str, config: Config | None = None,
                 template: PromptTemplate | None = None):
        self.client_factory = client_factory
        self.store = store
        self.config = config or Config()
        self.template = template

    def analyze(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        src = docs.select("filename", F.col(text).alias("text"), *keep)
        requests = requests_table(src, self.config, self.template)
        answered = answer(requests, self.client_factory, self.config, self.store, self.template)
        return validate(answered.drop("text", "request_key")).select("filename", *keep, "analysis", "error")
