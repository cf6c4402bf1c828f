"""Incremental folder ingest: two triggers over a growing folder."""

import os

from docket.config import FIXTURE_LEXICON, Config
from docket.sinks.reports import read_reports
from docket.sources.docx import docx_bytes
from docket.streaming.folder import watch_folder

HEAD = "Doe{} v. Roe, 1{} So. 3d 2 (La. 2001)\n"


def _write(folder, i, body):
    with open(os.path.join(folder, f"{i:09d}.docx"), "wb") as fh:
        fh.write(docx_bytes(HEAD.format(i, i) + body))


def test_two_triggers(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    os.makedirs(inbox)
    out = os.path.join(tmp_dir, "out")
    ck = os.path.join(tmp_dir, "ck")
    cfg = Config(lexicon=FIXTURE_LEXICON)
    _write(inbox, 1, "A worthless thble claim. Thing erble.")
    _write(inbox, 2, "Nothing here.")
    with open(os.path.join(inbox, "3.docx"), "wb") as fh:
        fh.write(b"broken")
    q = watch_folder(spark, inbox, out, ck, cfg)
    q.awaitTermination(120)
    res = spark.read.parquet(os.path.join(out, "results"))
    assert res.count() == 2
    assert spark.read.parquet(os.path.join(out, "extracted")).where("error is not null").count() == 1
    reports = {r[0] for r in read_reports(spark, os.path.join(out, "reports")).select("report").distinct().collect()}
    assert "high_relevance/high_relevance_analysis" in reports

    _write(inbox, 4, "Another worthless thing. Thing erble ering.")
    _write(inbox, 5, "Worthless thble again.")
    q = watch_folder(spark, inbox, out, ck, cfg)
    q.awaitTermination(120)
    res = spark.read.parquet(os.path.join(out, "results"))
    assert res.count() == 4  # the first files are not read again
    lines = read_reports(spark, os.path.join(out, "reports"))
    names = {r[0] for r in lines.where("report = 'medium_relevance/medium_relevance_analysis'")
             .select("filename").distinct().collect()}
    assert names == {"000000004.docx"}
    # the high report continued in the second batch: its new case starts with a break
    high = lines.where("report = 'high_relevance/high_relevance_analysis' and line_no = 0")
    first_styles = {r["filename"]: r["style"] for r in high.collect()}
    assert first_styles == {"000000001.docx": "Heading 1", "000000005.docx": "Page Break"}
    raw = spark.read.parquet(os.path.join(out, "reports"))
    assert {r[0] for r in raw.select("batch").distinct().collect()} == {0, 1}


def test_rerun_of_a_batch_is_idempotent(spark, tmp_dir):
    from docket.streaming.folder import process_batch

    rows = [(f"/in/{i:09d}.docx", bytearray(docx_bytes(HEAD.format(i, i) + "worthless thble. thing erble.")))
            for i in range(1, 4)]
    batch = spark.createDataFrame(rows, "path string, content binary")
    out = os.path.join(tmp_dir, "out")
    cfg = Config(lexicon=FIXTURE_LEXICON)
    process_batch(batch, 0, out, cfg)
    process_batch(batch, 0, out, cfg)  # the same batch again, as after a failure
    assert spark.read.parquet(os.path.join(out, "results")).count() == 3
    lines = read_reports(spark, os.path.join(out, "reports"))
    titles = lines.where("style = 'Heading 1'").groupBy("report").count().collect()
    assert titles and all(r["count"] == 3 for r in titles)
