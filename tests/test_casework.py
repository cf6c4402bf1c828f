"""End-to-end runs (R04, R05, R26-R28) with the rule analyzer and with a stub model."""

import os

import pandas as pd
from pyspark.sql import functions as F

from docket.config import FIXTURE_LEXICON, Config
from docket.operators.infer import StubClient
from docket.operators.requests import PromptTemplate, requests_table
from docket.plans.casework import answer, join_answers, run
from docket.sinks.reports import read_reports
from docket.sources.documents import cases
from docket.testing import SF_SMALL


def test_rule_run(spark, tmp_dir):
    docs = cases(spark, SF_SMALL).select("filename", "text")
    res = run(spark, docs, os.path.join(tmp_dir, "out"), config=Config(lexicon=FIXTURE_LEXICON))
    s = res.summary.first()
    assert s["n_documents"] == 200 == s["n_success"] + s["n_failed"]
    assert s["elapsed_s"] > 0 and res.elapsed_s == s["elapsed_s"]
    assert s["n_failed"] == len([i for i in range(200) if i % 17 == 0])  # no citation, no record
    lines = read_reports(spark, res.reports_path)
    assert lines.select("report").distinct().count() <= 12
    assert lines.where("style = 'Heading 1'").count() > s["n_success"]  # cases in two reports


def test_rerun_skips_answered_requests(spark, tmp_dir):
    calls = spark.sparkContext.accumulator(0)

    class Counting(StubClient):
        def complete(self, request):
            calls.add(1)
            return super().complete(request)

    docs = cases(spark, SF_SMALL).select("filename", "text")
    out = os.path.join(tmp_dir, "out")
    cfg = Config(threads_per_task=4, max_retries=0, lexicon=FIXTURE_LEXICON)
    res = run(spark, docs, out, config=cfg, client_factory=Counting)
    distinct_texts = docs.select("text").distinct().count()
    assert calls.value == distinct_texts  # one paid call per distinct request, not per file
    assert res.summary.first()["n_success"] == 200
    assert res.batch_stats.agg(F.sum("n_requests")).first()[0] == 200
    run(spark, docs, out, config=cfg, client_factory=Counting)
    assert calls.value == distinct_texts  # nothing asked twice


def test_empty_input_short_circuits(spark, tmp_dir):
    docs = spark.createDataFrame([], "filename string, text string")
    res = run(spark, docs, os.path.join(tmp_dir, "out"))
    assert res.n_documents == 0 and res.reports_path is None
    assert not os.path.exists(os.path.join(tmp_dir, "out", "reports"))


def test_empty_input_short_circuits_with_a_model(spark, tmp_dir):
    docs = spark.createDataFrame([], "filename string, text string")
    res = run(spark, docs, os.path.join(tmp_dir, "a"), client_factory=StubClient)
    assert res.n_documents == 0 and res.reports_path is None
    docs = spark.createDataFrame([("a.docx", "nothing here")], "filename string, text string")
    res = run(spark, docs, os.path.join(tmp_dir, "b"), client_factory=StubClient, only_candidates=True)
    assert res.n_documents == 0


def test_changed_template_is_asked_again(spark, tmp_dir):
    calls = spark.sparkContext.accumulator(0)

    class Counting(StubClient):
        def complete(self, request):
            calls.add(1)
            return super().complete(request)

    docs = spark.createDataFrame([("a.docx", "text one"), ("b.docx", "text two")], "filename string, text string")
    out, cfg = os.path.join(tmp_dir, "out"), Config(max_retries=0)
    for template, asked in ((None, 2), (None, 2), (PromptTemplate(user="Other words:\n\n{text}"), 4)):
        run(spark, docs, out, config=cfg, client_factory=Counting, template=template)
        assert calls.value == asked


def test_rejected_answer_is_asked_again(spark, tmp_dir):
    calls = spark.sparkContext.accumulator(0)

    class Twice(StubClient):
        """The same key twice: the strict check rejects it."""

        def complete(self, request):
            calls.add(1)
            return super().complete(request)[:-1] + ', "summary": "again"}'

    docs = spark.createDataFrame([("a.docx", "text one")], "filename string, text string")
    out, cfg = os.path.join(tmp_dir, "out"), Config(max_retries=1, retry_delay_s=0)
    for asked in (2, 4):
        assert run(spark, docs, out, config=cfg, client_factory=Twice).summary.first()["n_failed"] == 1
        assert calls.value == asked


def test_one_slow_call_does_not_hold_the_others(spark):
    import time

    from docket.operators.infer import _partition_fn

    class Slow(StubClient):
        def complete(self, request):
            time.sleep(1.0 if int(request["filename"]) % 64 == 0 else 0.02)
            return super().complete(request)

    frame = pd.DataFrame({"filename": [str(i) for i in range(256)], "text": "t", "request_key": [str(i) for i in range(256)]})
    work = _partition_fn(Slow, Config(threads_per_task=8, max_retries=0), PromptTemplate())
    began = time.monotonic()
    rows = pd.concat(list(work(iter([frame]))))
    bound = (4 * 1.0 + 252 * 0.02) / 8 + 1.0  # all threads busy, and the last slow call
    assert len(rows) == 256 and time.monotonic() - began < 1.5 * bound


def test_hot_duplicate_text_costs_one_call(spark, tmp_dir):
    """A third of the rows share one text: one call for it, every row answered."""
    calls = spark.sparkContext.accumulator(0)

    class Counting(StubClient):
        def complete(self, request):
            calls.add(1)
            return super().complete(request)

    rows = [(f"{i:09d}.docx", "Doe v. Roe, 1 So. 3d 2 (La. 2001)\nsame text" if i % 3 == 0 else f"text {i}")
            for i in range(300)]
    docs = spark.createDataFrame(rows, "filename string, text string").repartition(6)
    res = run(spark, docs, os.path.join(tmp_dir, "out"), config=Config(threads_per_task=4, max_retries=0),
              client_factory=Counting)
    assert calls.value == 1 + 200
    s = res.summary.first()
    assert (s["n_documents"], s["n_success"], s["n_failed"]) == (300, 300, 0)


def test_rerun_writes_identical_report_lines(spark, tmp_dir):
    docs = cases(spark, SF_SMALL).select("filename", "text")
    cfg = Config(lexicon=FIXTURE_LEXICON)
    a = run(spark, docs, os.path.join(tmp_dir, "a"), config=cfg)
    b = run(spark, docs.repartition(5), os.path.join(tmp_dir, "b"), config=cfg)
    la = read_reports(spark, a.reports_path)
    lb = read_reports(spark, b.reports_path)
    assert la.count() == lb.count() > 0
    assert la.exceptAll(lb).isEmpty() and lb.exceptAll(la).isEmpty()


def test_run_folder(spark, tmp_dir):
    from docket.plans.casework import run_folder
    from docket.sources.docx import docx_bytes

    inbox = os.path.join(tmp_dir, "inbox")
    os.makedirs(inbox)
    for i, body in enumerate(["worthless thble. thing erble.", "nothing at all.", "worthless claim."]):
        with open(os.path.join(inbox, f"{i:03d}.docx"), "wb") as fh:
            fh.write(docx_bytes(f"Doe{i} v. Roe, 1{i} So. 3d 2 (La. 2001)\n" + body))
    with open(os.path.join(inbox, "bad.docx"), "wb") as fh:
        fh.write(b"not a zip")
    res = run_folder(spark, inbox, os.path.join(tmp_dir, "out"), config=Config(lexicon=FIXTURE_LEXICON))
    s = res.summary.first()
    assert (s["n_documents"], s["n_success"], s["n_failed"], res.n_quarantined) == (3, 3, 0, 1)
    reports = {r[0] for r in read_reports(spark, res.reports_path).select("report").distinct().collect()}
    assert reports == {
        "high_relevance/high_relevance_analysis", "high_relevance/Relevance High - Strongly Supports",
        "medium_relevance/medium_relevance_analysis", "medium_relevance/Relevance Medium - Does not Support",
        "low_relevance/low_relevance_analysis", "low_relevance/Relevance Low - Does not Support",
    }


def test_model_analyzer_interface(spark, tmp_dir):
    import docket

    rows = [(f"{i:09d}.docx", f"text {i % 4}", i) for i in range(20)]
    docs = spark.createDataFrame(rows, "filename string, text string, doc_id long")
    ma = docket.ModelAnalyzer(StubClient, os.path.join(tmp_dir, "store"), Config(max_retries=0))
    res = docket.analyze(docs, analyzer=ma).collect()
    assert len(res) == 20 and all(r["analysis"] is not None and r["error"] is None for r in res)
    assert {r["analysis"]["relevance_level"] for r in res} == {"Low"}
    rule = docket.analyze(docs.select("filename", "text"), config=Config(lexicon=FIXTURE_LEXICON)).collect()
    assert sorted(r["filename"] for r in rule) == sorted(r[0] for r in rows)


def test_only_candidates_are_sent_to_the_model(spark, tmp_dir):
    calls = spark.sparkContext.accumulator(0)

    class Counting(StubClient):
        def complete(self, request):
            calls.add(1)
            return super().complete(request)

    rows = [("a.docx", "a worthless claim"), ("b.docx", "nothing here"), ("c.docx", "thtion and more")]
    docs = spark.createDataFrame(rows, "filename string, text string")
    cfg = Config(max_retries=0, lexicon=FIXTURE_LEXICON)
    res = run(spark, docs, os.path.join(tmp_dir, "out"), config=cfg, client_factory=Counting, only_candidates=True)
    assert calls.value == 2
    assert res.summary.first()["n_documents"] == 2


def test_compact_store_keeps_best_answer_per_key(spark, tmp_dir):
    from docket.plans.casework import compact_store

    store = os.path.join(tmp_dir, "store")
    ddl = "filename string, request_key string, response string, error string, attempts int, waited_ms bigint, latency_s double"
    spark.createDataFrame([("a", "k1", None, "Failed after 0 retries: x", 1, 0, 0.1),
                           ("b", "k2", '{"x": 1}', None, 1, 0, 0.1)], ddl).write.mode("append").parquet(store)
    spark.createDataFrame([("a", "k1", '{"y": 2}', None, 1, 0, 0.2),
                           ("c", "k3", None, "Failed after 0 retries: y", 1, 0, 0.1)], ddl).write.mode("append").parquet(store)
    out = {r["request_key"]: r for r in compact_store(spark, store, os.path.join(tmp_dir, "compact")).collect()}
    assert set(out) == {"k1", "k2", "k3"}
    assert out["k1"]["error"] is None and out["k1"]["response"] == '{"y": 2}'
    assert out["k1"]["filename"] == "a" and out["k2"]["filename"] == "b"
    assert out["k3"]["error"].startswith("Failed")


def test_answers_of_a_hot_key_are_split(spark):
    rows = [(f"f{i}", "hot" if i % 3 == 0 else f"k{i}") for i in range(3000)] + [(None, "hot"), ("lost", "unanswered")]
    target = spark.createDataFrame(rows, "filename string, request_key string")
    best = target.where("request_key <> 'unanswered'").select("request_key").distinct().selectExpr(
        "request_key", "struct(concat('to ', request_key) as response, cast(null as string) as error) as a")
    got = join_answers(target, best, unit=100)
    assert got.columns == ["filename", "request_key", "response", "error"]
    assert sorted(map(str, got.select("filename", "response").collect())) == sorted(
        map(str, target.where("request_key <> 'unanswered'").selectExpr(
            "filename", "concat('to ', request_key) as response").collect()))


def test_only_this_runs_keys_are_answered(spark, tmp_dir):
    cfg, store = Config(max_retries=0), os.path.join(tmp_dir, "store")
    def ask(*texts):
        docs = spark.createDataFrame([(f"{i}.docx", t) for i, t in enumerate(texts)], "filename string, text string")
        return answer(requests_table(docs, cfg), StubClient, cfg, store)
    assert ask("one", "two", "two").count() == 3
    assert sorted(r["filename"] for r in ask("two", "three").collect()) == ["0.docx", "1.docx"]
    assert spark.read.parquet(store).count() == 3
