"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

All of them read the driver's tables (``documents``, or the ``cases`` view derived
from it) in full. Oracle SQL for each is in :mod:`docket.queries.sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.config import FIXTURE_LEXICON, LEGAL_LEXICON, Config
from docket.functions import extract as X
from docket.functions.captions import with_caption
from docket.operators.boundaries import learn
from docket.operators.boundaries import sentence_ends as ends_of
from docket.operators.analyze import RuleAnalyzer, analysis_struct, missing_fields, missing_without
from docket.operators import route
from docket.operators.grounding import ground
from docket.operators.infer import FaultInjectingClient, StubClient, infer
from docket.operators.metrics import batch_intervals as metric_batch_intervals
from docket.operators.metrics import batch_stats as metric_batch_stats
from docket.operators.metrics import failure_listing, run_summary
from docket.operators.requests import PromptTemplate, batches, model_params, numbered, render, requests_table
from docket.operators.references import references
from docket.operators.validate import validate
from docket.queries.shapes import SHAPES, response_sql
from docket.operators.report import report_lines
from docket.operators.route import destinations, is_failure, matrix, report_spine, split_results
from docket.schema import RELEVANCE_LEVELS, SUPPORT_LEVELS
from docket.session import shared_dir
from docket.plans.casework import run
from docket.sinks.publish import publish_reports, read_published, stage_reports
from docket.sinks.reports import read_reports, write_reports
from docket.sinks.tables import materialize
from docket.sources.captions import captioned, referenced
from docket.sources.documents import cases, documents
from docket.sources.docx import read_docx_folder, write_docx_corpus
from docket.sources.folder import read_docx_files
from docket.sources.lexical import abridged, pleaded

ANALYZER = RuleAnalyzer(FIXTURE_LEXICON)


def relevance_support_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E03 + E09 -> R16-R18: the 3 x 3 case counts over every document."""
    docs = documents(spark, sf_dir)
    feats = ANALYZER.features(docs).select(
        F.struct(F.col("relevance_level"), F.col("support_level")).alias("analysis")
    )
    return matrix(spark, feats)


def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents containing a candidate phrase (filter before any paid call)."""
    docs = documents(spark, sf_dir)
    return docs.where(X.is_candidate(F.lower("text"), FIXTURE_LEXICON)).select("doc_id", "filename")


def legal_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E03 + E09 + E10 with the default lexicon, whose terms are phrases: candidates, evidence and levels."""
    docs = pleaded(spark, sf_dir)
    f = RuleAnalyzer(LEGAL_LEXICON).features(docs)
    return f.select(
        "doc_id",
        X.is_candidate(F.col("_lt"), LEGAL_LEXICON).alias("candidate"),
        F.col("n_topic").cast("bigint").alias("n_topic"),
        F.col("n_both").cast("bigint").alias("n_both"),
        F.col("net_support").cast("bigint").alias("net_support"),
        "relevance_level",
        "support_level",
    )


def learned_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E02 + E05: the abbreviations that the texts themselves show, with the figures that show them."""
    a = learn(abridged(spark, sf_dir)).abbreviations
    return a.select("type", "n_with", "n_without", "n_followed", "n_starts", F.round("ratio", 2).alias("ratio"))


def sentence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E02 + E05: every stop that a word follows, and whether the sentence ends there."""
    docs = abridged(spark, sf_dir)
    return ends_of(docs, learn(docs))


def case_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01 + E11: citation, decision year and whether it predates the anchor year."""
    c = cases(spark, sf_dir)
    cite = X.citation(F.col("text"), FIXTURE_LEXICON)
    return c.select("doc_id", cite.alias("blue_book_citation")).select(
        "doc_id",
        "blue_book_citation",
        X.decision_year(F.col("blue_book_citation")).cast("bigint").alias("decision_year"),
        X.predates(F.col("blue_book_citation"), FIXTURE_LEXICON).alias("predates"),
    )


def caption_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation, docket, court and year under some fifty forms of citation lines and header blocks."""
    return with_caption(captioned(spark, sf_dir)).select(
        "doc_id", "caption.form", F.col("caption.citation").alias("blue_book_citation"), "caption.docket", "caption.court",
        F.col("caption.year").cast("bigint").alias("decision_year"))


def citation_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference to a case, back-references resolved to the full citation, with the page pointed at."""
    return references(referenced(spark, sf_dir))


# What a model may do to a quote: leave it, change its first word, give another page, make it up.
def _planted_answer(q, i):
    kind = F.pmod(F.col("doc_id") + i, F.lit(4))
    words = F.when(kind == 1, F.concat(F.lit("zzzz "), F.regexp_replace(q["quote"], r"^[^ ]* ?", ""))).when(
        kind == 3, F.reverse(q["quote"])).otherwise(q["quote"])
    return F.struct(words.alias("quote"), F.when((kind == 2) & q["page"].isNotNull(), "9999").otherwise(q["page"]).alias("page"))


def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E07 + E12: the quotes of answers (true, altered, on a wrong page, made up) against the text."""
    c = X.with_quotes(cases(spark, sf_dir), "text", "records")
    answers = c.select("doc_id", "text", F.transform("records", _planted_answer).alias("quotes"))
    g = ground(answers).select("doc_id", F.posexplode_outer("grounding").alias("quote_no", "g")).where(F.col("quote_no").isNotNull())
    return g.select("doc_id", F.col("quote_no").cast("bigint").alias("quote_no"), "g.status", "g.page", F.round("g.coverage", 4).alias("coverage"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ANALYZER.fields(cases(spark, sf_dir), keep_private=True)


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of every case."""
    return _fields(spark, sf_dir).select("doc_id", "summary")


def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key points, one row each, numbered in document order."""
    f = _fields(spark, sf_dir)
    return (
        f.select("doc_id", F.posexplode_outer("key_points").alias("point_no", "key_point"))
        .where(F.col("point_no").isNotNull())
        .select("doc_id", F.col("point_no").cast("bigint").alias("point_no"), "key_point")
    )


def cited_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cases cited by each case (its own caption excluded)."""
    f = _fields(spark, sf_dir)
    return (
        f.select("doc_id", F.posexplode_outer("citations").alias("_i", "cited_case"))
        .where(F.col("_i").isNotNull())
        .select("doc_id", "cited_case")
    )


def quotes_with_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every curly-quoted passage, over lines too, with the star page in force where it opens."""
    f = _fields(spark, sf_dir)
    # outer explode + a filter on the generated column: the filter stays above the
    # generator instead of being pushed (and the analysis inlined) below it
    r = f.select("doc_id", F.posexplode_outer("_quote_records").alias("quote_no", "r")).where(
        F.col("quote_no").isNotNull()
    )
    return r.select(
        "doc_id",
        F.col("quote_no").cast("bigint").alias("quote_no"),
        F.col("r.quote").alias("quote"),
        F.col("r.page").alias("page"),
        X.format_quote(F.col("r.quote"), F.col("r.page")).alias("quote_text"),
    )


def relevance_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E03 + E04: relevance level with the evidence counts behind it."""
    f = _fields(spark, sf_dir)
    return f.select(
        "doc_id",
        "relevance_level",
        F.col("n_topic").cast("bigint").alias("n_topic"),
        F.col("n_both").cast("bigint").alias("n_both"),
        "reasoning",
    )


def support_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E08 + E09: support level, net term hits and the argument text."""
    f = _fields(spark, sf_dir)
    return f.select(
        "doc_id", "support_level", F.col("net_support").cast("bigint").alias("net_support"), "argument"
    )


def argument_citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument sentences, and how many carry no citation (null without an argument)."""
    f = _fields(spark, sf_dir).select("doc_id", "argument")
    f = f.withColumn("_s", X.argument_sentences(F.col("argument"), FIXTURE_LEXICON))
    has = F.col("_s").isNotNull()  # size(null) is -1 when ANSI mode is off
    return f.select(
        "doc_id",
        F.when(has, F.size("_s")).cast("bigint").alias("n_sentences"),
        F.when(has, X.uncited_count(F.col("_s"))).cast("bigint").alias("n_uncited"),
    )


# -- results, routing and reports ------------------------------------------------------

# Planted label noise, as a model would produce it: lower-cased or padded levels are
# outside the closed domains, and an empty error string next to an analysis is a success.
PLANT_REL = "case when doc_id % 13 = 5 then lower(relevance_level) when doc_id % 29 = 3 then relevance_level || ' ' else relevance_level end"
PLANT_SUP = "case when doc_id % 11 = 7 then upper(support_level) else support_level end"
PLANT_ERR = "case when doc_id % 19 = 4 then '' end"


LEVELS = ("relevance_level", "support_level")


def results(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Rule-analyzer results over every case, with the planted label noise, written once.

    With ``fields`` the analysis holds these alone, and no other field is computed.
    """
    return materialize(envelopes(spark, sf_dir, *fields), "results")


def envelopes(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The plan of :func:`results`."""
    f = ANALYZER.fields(cases(spark, sf_dir), keep_private=True)
    f = f.withColumn("relevance_level", F.expr(PLANT_REL)).withColumn("support_level", F.expr(PLANT_SUP))
    missing = missing_without(F.col("text"), F.col("blue_book_citation")) if fields else missing_fields()
    return f.select(
        "filename",
        "doc_id",
        F.when(missing.isNull(), F.struct(*fields) if fields else analysis_struct()).alias("analysis"),
        F.when(missing.isNotNull(), F.concat(F.lit("invalid analysis: missing "), missing))
        .otherwise(F.expr(PLANT_ERR))
        .alias("error"),
    )


def result_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13 + R14: every envelope tagged success or failure."""
    r = envelopes(spark, sf_dir, "blue_book_citation")
    return r.select("doc_id", "filename", is_failure().alias("failed"), "error")


def level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of each exact relevance level, in one pass over the successes."""
    ok, _ = split_results(results(spark, sf_dir, *LEVELS))
    return route.level_filter(ok, *RELEVANCE_LEVELS).select(
        "doc_id", F.col("analysis.relevance_level").alias("relevance_level")
    )


def domain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R15 + R16: in/out-of-domain counts and the conservation laws they obey."""
    ok, _ = split_results(results(spark, sf_dir, *LEVELS))
    rel_in = F.col("analysis.relevance_level").isin(*RELEVANCE_LEVELS)
    sup_in = F.col("analysis.support_level").isin(*SUPPORT_LEVELS)
    a = ok.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_success"),
        F.count_if(rel_in).cast("bigint").alias("n_in_level_reports"),
        F.count_if(~rel_in).cast("bigint").alias("n_relevance_out_of_domain"),
        F.count_if(rel_in & sup_in).cast("bigint").alias("n_in_combo_reports"),
        F.count_if(rel_in & ~sup_in).cast("bigint").alias("n_support_out_of_domain"),
    )
    return a.select(
        "*",
        (F.col("n_success") == F.col("n_in_level_reports") + F.col("n_relevance_out_of_domain")).alias(
            "success_conserved"
        ),
        (F.col("n_in_level_reports") == F.col("n_in_combo_reports") + F.col("n_support_out_of_domain")).alias(
            "level_conserved"
        ),
    )


def level_combo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and combination counts in one GROUPING SETS pass."""
    ok, _ = split_results(results(spark, sf_dir, *LEVELS))
    rs = ok.select(
        F.col("analysis.relevance_level").alias("relevance_level"),
        F.col("analysis.support_level").alias("support_level"),
    ).where(F.col("relevance_level").isin(*RELEVANCE_LEVELS))
    g = rs.groupingSets(
        [["relevance_level"], ["relevance_level", "support_level"]], "relevance_level", "support_level"
    ).agg(F.count(F.lit(1)).cast("bigint").alias("n_cases"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 1, F.lit("level")).otherwise(F.lit("combo"))
    return g.where((F.col("gid") == 1) | F.col("support_level").isin(*SUPPORT_LEVELS)).select(
        level.alias("grouping"), "relevance_level", "support_level", "n_cases"
    )


def report_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R18 + R19: all 12 possible reports with their case count and whether one is written."""
    ok, _ = split_results(results(spark, sf_dir, *LEVELS))
    counts = destinations(ok).groupBy("report").agg(F.count(F.lit(1)).alias("n"))
    spine = report_spine(spark)
    return spine.join(F.broadcast(counts), "report", "left").select(
        "report",
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_cases"),
        (F.coalesce(F.col("n"), F.lit(0)) > 0).alias("written"),
    )


def report_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R20-R22 + R24: every line of every report."""
    ok, _ = split_results(results(spark, sf_dir))
    return report_lines(ok)


def report_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R23 + R25: report lines written as a partitioned table and read back."""
    ok, _ = split_results(results(spark, sf_dir))
    path = shared_dir(spark, "reports")
    write_reports(report_lines(ok), path)
    return read_reports(spark, path)


SECOND_RUN = "doc_id % 2 = 0 and relevance_level <> 'Low'"


def report_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run replaces the reports it produces; those it leaves empty keep the first run's lines."""
    ok, _ = split_results(results(spark, sf_dir))
    path = shared_dir(spark, "reports")
    write_reports(report_lines(ok), path)
    again = ok.withColumn("relevance_level", F.col("analysis.relevance_level")).where(SECOND_RUN)
    write_reports(report_lines(again.drop("relevance_level")), path)
    return read_reports(spark, path)


def report_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs published, then one that ends before its commit: what a reader sees, and of which run."""
    ok, _ = split_results(results(spark, sf_dir))
    ok = materialize(ok, "published-cases")
    path = shared_dir(spark, "published")
    first = publish_reports(report_lines(ok), path)
    again = ok.withColumn("relevance_level", F.col("analysis.relevance_level")).where(SECOND_RUN)
    publish_reports(report_lines(again.drop("relevance_level")), path)
    stage_reports(report_lines(ok), path)  # a third run ends before its commit: nothing of it may be seen
    of_first = F.col("version").isin(sorted(set(first["reports"].values())))
    return read_published(spark, path).select("report", "filename", "line_no", "style", "text",
                                              F.when(of_first, 1).otherwise(2).cast("bigint").alias("run"))


def run_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, successes, failures."""
    return run_summary(envelopes(spark, sf_dir, "blue_book_citation"))


def failure_listing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed documents with their error."""
    return failure_listing(envelopes(spark, sf_dir, "blue_book_citation"))


# -- requests, inference, validation, ingest -------------------------------------------

RENDER_MODELS = ("o1", "gpt-4o")
BATCH_SIZE = 10
RETRY_CONFIG = Config(max_retries=3, retry_delay_s=0.001, threads_per_task=8)


def request_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R06 + R07: both messages of every request, under a reasoning and a plain model."""
    tpl = PromptTemplate()
    docs = documents(spark, sf_dir).select("filename", "text", F.explode(F.array(*map(F.lit, RENDER_MODELS))).alias("model"))
    r = render(docs, tpl).withColumn("params", model_params(F.col("model")))
    user = F.col("messages")[1]["content"]
    return r.select(
        "filename",
        "model",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.length(F.col("messages")[0]["content"]).cast("bigint").alias("developer_chars"),
        F.length(user).cast("bigint").alias("user_chars"),
        F.sha2(user, 256).alias("user_sha256"),
        F.col("params.reasoning_effort").alias("reasoning_effort"),
        F.col("params.temperature").alias("temperature"),
    )


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in file-name order, cut into numbered batches of 10."""
    return batches(documents(spark, sf_dir).select("filename"), BATCH_SIZE).select(
        "filename", "batch_no", "n_batches"
    )


def _doc_id_of(filename: str) -> int:
    return int(filename.split(".", 1)[0])


def _faulty_client():
    return FaultInjectingClient(StubClient(), lambda fn: _doc_id_of(fn) % 5)


def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, backoff and dead letters when document k fails k % 5 times."""
    reqs = requests_table(documents(spark, sf_dir), RETRY_CONFIG)
    resp = materialize(infer(reqs, _faulty_client, RETRY_CONFIG), "responses")
    return resp.select(
        F.split_part(F.col("filename"), F.lit("."), F.lit(1)).cast("bigint").alias("doc_id"),
        F.col("attempts").cast("bigint").alias("attempts"),
        "waited_ms",
        F.col("error").isNull().alias("ok"),
        "error",
    )


def strict_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and extracted fields for 17 response shapes, one per document."""
    d = documents(spark, sf_dir).selectExpr(
        "doc_id", "filename", f"cast(doc_id % {len(SHAPES)} as bigint) as shape", f"{response_sql('spark')} as response"
    )
    v = validate(d.withColumn("error", F.lit(None).cast("string")))
    return v.select(
        "doc_id",
        "shape",
        F.col("analysis").isNotNull().alias("valid"),
        F.col("analysis.blue_book_citation").alias("blue_book_citation"),
        F.col("analysis.relevance_level").alias("relevance_level"),
        F.size("analysis.key_points").cast("bigint").alias("n_key_points"),
    ).withColumn("n_key_points", F.when(F.col("valid"), F.col("n_key_points")))


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per batch and whether its seconds were recorded, from the written response table."""
    cfg = Config(max_retries=0, threads_per_task=8)
    reqs = requests_table(documents(spark, sf_dir), cfg)
    numbered_reqs = batches(reqs.select("filename", "request_key"), BATCH_SIZE)
    resp = materialize(infer(reqs, StubClient, cfg), "responses")
    joined = resp.join(numbered_reqs.select("filename", "batch_no"), "filename")
    timed = F.coalesce(F.col("max_latency_s") >= 0, F.lit(False))
    return metric_batch_stats(joined).select("batch_no", "n_requests", timed.alias("seconds_recorded"))


# A scripted clock: request idx of the run starts and lasts by closed forms (in eighths of a second, exact in binary).
STARTS = "(idx div 10) * 40 + (idx % 10) * ((idx div 10) % 7)"
LASTS = "case when doc_id % 31 = 30 then null else 1 + doc_id % 13 end"


def batch_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed, idle and overlapping time of every batch from stamps of a scripted clock."""
    num = numbered(documents(spark, sf_dir).select("filename", "doc_id"), "filename")
    stamped = num.selectExpr(f"idx div {BATCH_SIZE} + 1 as batch_no", f"case when {LASTS} is not null then ({STARTS}) / 8D end as began_s",
                             f"({LASTS}) / 8D as latency_s")
    return metric_batch_intervals(stamped)


DOCX_CORRUPT = "doc_id % 23 = 0"


# Names of the scanned files by document: some begin like hidden files, some end otherwise.
SCAN_NAME = ("concat(case doc_id % 7 when 1 then '_' when 2 then '.' when 3 then '~$' else '' end, cast(doc_id as string),"
             " case doc_id % 11 when 4 then '.DOCX' when 5 then '.txt' when 6 then '.docx.bak' else '.docx' end)")
SCAN_EMPTY = "doc_id % 13 = 0"


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all sorts of names listed in tasks; every one that ends in .docx is tried."""
    folder = shared_dir(spark, "scan")
    docs = documents(spark, sf_dir).select("doc_id", "text", F.expr(SCAN_NAME).alias("filename"))
    write_docx_corpus(docs, folder, corrupt=DOCX_CORRUPT, empty=SCAN_EMPTY)
    files = materialize(read_docx_files(spark, folder), "scanned")
    return files.select("filename", F.length("text").cast("bigint").alias("n_chars"),
                        F.col("error").isNull().alias("readable"))


def empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all cases and one over none of them: documents, and whether anything was written."""
    rows = []
    src = cases(spark, sf_dir).select("filename", "text")
    for name, docs in (("all", src), ("none", src.where(F.col("filename").isNull()))):
        done = run(spark, docs, shared_dir(spark, "run"), config=Config(lexicon=FIXTURE_LEXICON))
        n = done.summary.select("n_documents").first()[0] if done.summary is not None else 0
        rows.append((name, int(n), done.summary is not None, done.failures is not None, done.reports_path is not None))
    return spark.createDataFrame(
        rows, "run string, n_documents bigint, summary_written boolean, failures_written boolean, reports_written boolean")


def docx_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as .docx files, listed, extracted and quarantined."""
    folder = shared_dir(spark, "docx")
    docs = documents(spark, sf_dir)
    write_docx_corpus(docs, folder, corrupt=DOCX_CORRUPT)
    ex = read_docx_folder(spark, folder)
    return ex.select("filename", "text", F.col("error").isNull().alias("readable"))
