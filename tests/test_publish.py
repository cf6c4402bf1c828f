"""Publication of report sets: whole or not at all."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from docket.operators.report import report_lines
from docket.plans.casework import run
from docket.schema import RESULT_SCHEMA
from docket.sinks import publish
from docket.sinks.publish import drop_unread, publish_reports, read_manifest, read_published


def lines(spark, *cases):
    rows = [(fn, ("Doe v. Roe, 1 So. 3d 2 (La. 2001)", "S.", rel, "R.", ["k"], [], [], "A.", "Supports"), None) for fn, rel in cases]
    return report_lines(spark.createDataFrame(rows, RESULT_SCHEMA))


def files_by_report(df):
    out = {}
    for r in df.select("report", "filename").distinct().collect():
        out.setdefault(r.report.split("/")[0], set()).add(r.filename)
    return out


def test_sets_follow_each_other(spark, tmp_dir):
    assert read_published(spark, tmp_dir).collect() == [] and read_manifest(spark, tmp_dir)["number"] == 0
    one = lines(spark, ("a", "High"), ("b", "Low"))
    publish_reports(one, tmp_dir)
    held = read_published(spark, tmp_dir)
    assert sorted(map(tuple, held.drop("version").collect())) == sorted(map(tuple, one.select(*held.drop("version").columns).collect()))
    publish_reports(lines(spark, ("c", "High")), tmp_dir)
    assert files_by_report(read_published(spark, tmp_dir)) == {"high_relevance": {"c"}, "low_relevance": {"b"}}
    assert files_by_report(held) == {"high_relevance": {"a"}, "low_relevance": {"b"}}  # a reader keeps its set
    assert files_by_report(read_published(spark, tmp_dir, 1)) == files_by_report(held)
    publish_reports(lines(spark, ("d", "Medium")), tmp_dir, replace_all=True)
    assert files_by_report(read_published(spark, tmp_dir)) == {"medium_relevance": {"d"}}


def test_a_run_that_fails_midway_is_not_seen(spark, tmp_dir, monkeypatch):
    publish_reports(lines(spark, ("a", "High")), tmp_dir)
    before, whole = read_manifest(spark, tmp_dir), publish.write_reports

    def half(df, folder, *args, **kwargs):  # the high reports are written, the low ones are not
        whole(df.where("filename = 'b'"), folder, *args, **kwargs)
        raise RuntimeError("midway")

    with monkeypatch.context() as m:
        m.setattr(publish, "write_reports", half)
        with pytest.raises(RuntimeError, match="midway"):
            publish_reports(lines(spark, ("b", "High"), ("c", "Low")), tmp_dir)
    assert len(os.listdir(f"{tmp_dir}/versions")) == 2 and read_manifest(spark, tmp_dir) == before
    assert files_by_report(read_published(spark, tmp_dir)) == {"high_relevance": {"a"}}
    publish.stage_reports(lines(spark, ("b", "High"), ("c", "Low")), tmp_dir)  # and one that ends before its commit
    assert files_by_report(read_published(spark, tmp_dir)) == {"high_relevance": {"a"}}
    assert len(drop_unread(spark, tmp_dir)) == 2 and read_published(spark, tmp_dir).count() > 0


def test_writers_at_once_keep_each_others_reports(spark, tmp_dir):
    levels, failures = ("High", "Medium", "Low"), []

    def write(level):
        try:
            publish_reports(lines(spark, (level, level)), tmp_dir)
        except Exception as e:
            failures.append(e)

    threads = [threading.Thread(target=write, args=(x,)) for x in levels]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failures and read_manifest(spark, tmp_dir)["number"] == 3
    assert files_by_report(read_published(spark, tmp_dir)) == {f"{x.lower()}_relevance": {x} for x in levels}


def test_a_taken_number_is_not_overwritten(spark, tmp_dir, monkeypatch):
    first = publish_reports(lines(spark, ("a", "High")), tmp_dir)
    assert not publish._commit(spark, tmp_dir, {"number": 1, "reports": {}})
    assert read_manifest(spark, tmp_dir) == first
    assert [n for n in os.listdir(f"{tmp_dir}/manifests") if not n.endswith(".crc")] == ["000000000001.json"]
    monkeypatch.setattr(publish, "_commit", lambda *a: False)
    with pytest.raises(publish.Conflict):
        publish.commit_reports(spark, tmp_dir, first["reports"], attempts=2)


def test_run_publishes(spark, tmp_dir):
    docs = spark.createDataFrame([("a.docx", "Doe v. Roe, 1 So. 3d 2 (La. 2001)\nText.")], "filename string, text string")
    done = run(spark, docs, tmp_dir, publish=True)
    assert done.reports_path == f"{tmp_dir}/published" and not os.path.exists(f"{tmp_dir}/reports")
    assert read_published(spark, done.reports_path).where("filename = 'a.docx'").count() > 0
